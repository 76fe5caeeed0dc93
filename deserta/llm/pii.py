"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds email, ip, card and phone follow fixed rules and always stay. The scored kinds are added where they touch none of
those: iban (mod-97 must hold; of the proposed groups those that do), national_id and local_phone (only with a fitting word within ``CONTEXT`` code points).
Only built-in functions, one projection per kind, no shuffle; every span list belongs to one row.

Patterns use possessive runs and look-behinds so that each text is read in linear time, however long its runs are.

Defined cases: a null text is empty and has no spans; texts are read whole; equal rows get equal results; spans of equal
start are ordered by kind; an empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import spans as S

_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A match is the head; group 1, looked ahead at, is the longest proposal, so that a proposal hides no head inside it.
IBAN = (r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])))"
        r"[A-Z]{2}[0-9]{2}")
IBAN_LEAST = 12
#: Characters of an IBAN by country. A part of that length goes before any other that passes mod-97.
IBAN_LENGTHS = dict((x[:2], int(x[2:])) for x in """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18
FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20
LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24
SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split())
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

CONTEXT = 40
#: Prior score of a kind, gain for a passed checksum, gain for a nearby word, and those words.
SCORED = {
    "iban": (0.3, 0.5, 0.1, "iban|account|konto|cuenta|compte|bank"),
    "national_id": (0.3, 0.0, 0.5, "ssn|social security|national id|identity"),
    "local_phone": (0.3, 0.0, 0.5, "phone|telephone|tel|call|fax|mobile|telefon|teléfono"),
}
MIN_SCORE = 0.6
BASE = ("email", "ip", "card", "phone")
KINDS = BASE + tuple(SCORED)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(a, i):
        d = digits.substr(F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return a + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def flat(iban: Column) -> Column:
    return F.replace(iban, F.lit(" "), F.lit(""))


def mod97(iban: Column) -> Column:
    bare = flat(iban)
    turned = F.concat(bare.substr(F.lit(5), F.length(bare)), bare.substr(F.lit(1), F.lit(4)))

    def step(a, i):
        code = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def of_its_country(iban: Column) -> Column:
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    return F.coalesce(F.element_at(lengths, F.left(iban, F.lit(2))) == F.length(flat(iban)), F.lit(False))


def longest_iban(proposal: Column) -> Column:
    """The part of the proposal, cut at blanks, whose checksum holds: that of its country's length, else the longest,
    else null."""
    words = F.split(proposal, " ")
    ends = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    hold = F.filter(ends, lambda x: (F.length(flat(x)) >= IBAN_LEAST) & mod97(x))
    return F.coalesce(F.get(F.filter(hold, of_its_country), 0), F.get(hold, 0))


def with_ibans(df: DataFrame, text_col: str, only_if: Column) -> DataFrame:
    """Add ``iban``: from each head the best part of its proposal."""
    df = S.with_matches(df, "iban", text_col, IBAN, only_if)
    proposals = F.when(F.size("iban") > 0, F.regexp_extract_all(F.col(text_col), F.lit(IBAN), F.lit(1)))
    df = df.withColumn("iban", F.when(F.size("iban") > 0, F.zip_with("iban", proposals, lambda x, p: F.struct(
        x["s"].alias("s"), longest_iban(p).alias("m")))))
    return df.withColumn("iban", F.expr(f"""coalesce(transform(filter(iban, x -> x.m is not null),
        x -> named_struct('s', x.s, 'e', x.s + char_length(x.m), 'm', x.m)), cast(array() AS {S.SPAN}))"""))


def ibans_apart(df: DataFrame) -> DataFrame:
    """Of overlapping ones keep the leftmost, those of their country's length first."""
    df = (df.withColumn("__own", F.filter("iban", lambda x: of_its_country(x["m"])))
          .withColumn("__other", F.filter("iban", lambda x: ~of_its_country(x["m"])))
          .withColumn("__own", S.leftmost("__own")).withColumn("__other", S.apart("__other", "__own")))
    return df.withColumn("iban", F.array_sort(F.concat("__own", S.leftmost("__other")))).drop("__own", "__other")


def small_parts(ip: Column) -> Column:
    def fits(p):
        bare = F.ltrim(p, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
    return F.forall(F.split(ip, r"\.", -1), fits)


def between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def enough(kind: str, text: Column):
    """Test of a span's score: prior, plus the checksum's part (a failed one rejects), plus the nearby word's part."""
    prior, checked, near, words = SCORED[kind]

    def test(x):
        around = F.lower(text.substr(F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, x["e"] - x["s"] + 2 * CONTEXT))
        score = F.lit(prior) + F.when(around.rlike(rf"(?<![a-z])(?:{words})(?![a-z])"), near).otherwise(0.0)
        if checked:
            score = score + F.when(mod97(x["m"]), checked).otherwise(-1.0)
        return score >= MIN_SCORE
    return test


def with_personal_data(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one span column (start, end, match) per kind."""
    t = F.col(text_col)
    df = df.select(*[c for c in df.columns if c not in KINDS])
    digit = F.coalesce(t.rlike("[0-9]"), F.lit(False))
    df = df.withColumn("__digit", digit)
    has = F.col("__digit")
    df = S.with_matches(df, "email", text_col, EMAIL, F.contains(t, F.lit("@")))
    df = S.with_matches(df, "ip", text_col, IP, has)
    df = S.with_matches(df, "card", text_col, CARD, has)
    df = S.with_matches(df, "phone", text_col, PHONE, has & F.contains(t, F.lit("+")))
    df = with_ibans(df, text_col, has)
    df = S.with_matches(df, "national_id", text_col, NATIONAL_ID, has)
    df = S.with_matches(df, "local_phone", text_col, LOCAL_PHONE, has)
    n = lambda x: F.length(digits_of(x["m"]))
    df = (df.withColumn("ip", F.filter("ip", lambda x: small_parts(x["m"])))
          .withColumn("card", F.filter("card", lambda x: between(n(x), 12, 19) & luhn(digits_of(x["m"]))))
          .withColumn("phone", F.filter("phone", lambda x: between(n(x), 9, 15))))
    for kind in SCORED:
        df = df.withColumn(kind, F.filter(kind, enough(kind, t)))
        df = df.withColumn(kind, S.apart(kind, *KINDS[:KINDS.index(kind)]))
        if kind == "iban":
            df = ibans_apart(df)
    return df.drop("__digit")


def pii_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    found = with_personal_data(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    base = S.joined(*[(k, i, k) for i, k in enumerate(BASE)])
    return found.select(F.col("__id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(base, 256).alias("base_sha256"),
                        S.joined(*[(k, i, k) for i, k in enumerate(KINDS)]).alias("spans"))
