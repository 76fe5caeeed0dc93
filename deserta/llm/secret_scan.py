"""Secrets: fixed patterns, plus strings that a character Markov model of random strings explains better than one of
ordinary identifiers.

Two first-order Markov models over characters are trained from labelled samples of all documents: the values of pattern
matches are random strings; runs of the candidates' alphabet made of words, numbers and separators alone (``ORDINARY``:
names in any case, slugs, paths, dates, versions) are ordinary identifiers. The ordinary model falls back from characters
to their classes, whose order comes half from the documents and half from ``SHAPES``, so an alphabet that the documents
hardly show is not taken for random. A candidate, a run of 16 or more characters of the base64 alphabets with a letter that
touches no pattern match and is no UUID, is added as kind ``random`` if its log-likelihood ratio per character exceeds the
margin. The margin is ``MARGIN``, raised where more than ``FALSE_ALARMS`` of the ordinary runs in the held-out half of the
documents would exceed it under a model of the other half.

Only DataFrame operations on the main path: the model is one literal array of ``SIDE`` squared numbers whatever the
input, every row is scored by itself, and only the training counts (at most ``SIDE`` squared rows per class and half) and
the held-out histogram (one row per 1/``BINS``) are shuffled, summed in each task before, and collected.

Defined cases: a null text is empty and has no spans; texts are read whole; equal rows get equal results; spans of equal
start are ordered by kind; with no training rows both models are uniform and nothing is added; an empty table gives an
empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from . import spans as S

ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)")
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9+/_-])"
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])(?!{UUID})[A-Za-z0-9+/_-]{{16,}}+"
#: At most 64 parts: a longer run is no label (the regex engine's stack grows with the parts).
ORDINARY = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9/_-]{8})"
            r"(?![0-9a-f]{24})(?!AKIA[A-Z0-9]{16})"
            r"(?:[a-z]{3,}+|[A-Z][a-z]++|[A-Z]{2,}+(?![a-z])|[0-9]++|[/_-]){1,64}+(?![A-Za-z0-9+/_=-])")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

#: Characters from "+" to "z" have a row and a column each.
FIRST, SIDE = 43, 80
ALPHABET = 64
MARGIN = 1.0
FALSE_ALARMS = 0.001
#: So many held-out runs more may exceed the margin before it is raised, as a few rare names say little.
SLACK = 10
BINS = 64
#: Weight of the character classes in the ordinary model.
BACK_OFF = 0.2
#: Ordinary identifiers of usual shapes, from which the order of character classes is counted.
SHAPES = ("getElementById", "HttpRequestHandler", "parseJson2Xml", "toUtf8String", "sha256Digest", "MAX_BUFFER_SIZE",
          "user_account_id", "column_12_name", "x86_64-linux-gnu", "2024-01-31", "release-2-4-1", "how-to-write-a-letter",
          "blog/2021/03/our-new-office", "usr/local/lib/python3", "docs/v2/api/index", "invoice-000123-2022",
          "ISO-8859-1", "covid-19-report", "area51_map", "page/12/section/4")


def _class_of(cell: int) -> int:
    c = chr(cell + FIRST)
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def with_patterns(df: DataFrame, text_col: str) -> DataFrame:
    t = F.col(text_col)
    df = S.with_matches(df, "assign", text_col, ASSIGN)
    df = S.with_matches(df, "access", text_col, ACCESS, F.contains(t, F.lit("AKIA")))
    df = S.with_matches(df, "hex", text_col, HEX)
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 1)
    return (df.withColumn("assign", F.filter("assign", lambda x: F.length(value(x)) >= 6))
            .withColumn("access", F.filter("access", lambda x: F.length(x["m"]) >= 20)))


def halved(df: DataFrame, text_col: str) -> DataFrame:
    """t, half (0 or 1): equal texts are of one half."""
    t = F.col(text_col)
    return df.select(t.alias("t"), F.pmod(F.xxhash64(t), F.lit(2)).cast("int").alias("half"))


def ordinary_runs() -> Column:
    return F.coalesce(F.regexp_extract_all("t", F.lit(ORDINARY), F.lit(0)), F.array().cast("array<string>"))


def transition_counts(df: DataFrame, text_col: str) -> DataFrame:
    """kind (random or ordinary), half, cell (row * SIDE + column), n over all documents."""
    found = with_patterns(halved(df, text_col), "t")
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 1)
    secrets = F.concat(F.transform("assign", value), F.transform("access", lambda x: x["m"]),
                       F.transform("hex", lambda x: x["m"]))
    chars = (found.select("half", F.explode(F.array(F.struct(F.lit("random").alias("kind"), secrets.alias("all")),
                                                    F.struct(F.lit("ordinary").alias("kind"), ordinary_runs().alias("all")))).alias("x"))
             .select("half", "x.kind", F.explode("x.all").alias("w")).where(F.length("w") > 1)
             .select("half", "kind", F.split("w", "").alias("c")))
    at = lambda i: F.ascii(F.get("c", i)) - FIRST
    cells = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: at(i) * SIDE + at(i + 1))
    return (chars.select("kind", "half", F.explode(cells).alias("cell")).groupBy("kind", "half", "cell")
            .agg(F.count("*").alias("n")))


def class_order(plain: list[float]) -> list[list[float]]:
    """P(class of the next character | class of this one), half from the counted cells and half from ``SHAPES``."""
    counted, shapes = ([[0.0] * 4 for _ in range(4)] for _ in range(2))
    for cell, n in enumerate(plain):
        counted[_class_of(cell // SIDE)][_class_of(cell % SIDE)] += n
    for w in SHAPES:
        for a, b in zip(w, w[1:]):
            shapes[_class_of(ord(a) - FIRST)][_class_of(ord(b) - FIRST)] += 1
    out = []
    for x, y in zip(counted, shapes):
        prior = [(n + 0.5) / (sum(y) + 2) for n in y]
        out.append([0.5 * p + 0.5 * (n / sum(x) if sum(x) else p) for n, p in zip(x, prior)])
    return out


def ratio_table(counts: list) -> list[float]:
    """log P(next | this; random) - log P(next | this; ordinary) for each cell.

    The random model is an even mixture of the counted transitions and a uniform choice, as secrets of other alphabets
    must not look ordinary; the ordinary model mixes the counted transitions with those of character classes.
    """
    n = {"random": [0.0] * (SIDE * SIDE), "ordinary": [0.0] * (SIDE * SIDE)}
    for r in counts:
        n[r["kind"]][r["cell"]] += float(r["n"])
    if not any(n["random"]) and not any(n["ordinary"]):
        return [0.0] * (SIDE * SIDE)
    order, every = class_order(n["ordinary"]), [sum(n["ordinary"][b::SIDE]) + 0.5 for b in range(SIDE)]
    members = [[b for b in range(SIDE) if _class_of(b) == k] for k in range(4)]
    within = [0.0] * SIDE
    for m in members:
        for b in m:
            within[b] = 0.5 * every[b] / sum(every[x] for x in m) + 0.5 / len(m)
    out = []
    for a in range(SIDE):
        row = slice(a * SIDE, (a + 1) * SIDE)
        rnd, plain = n["random"][row], n["ordinary"][row]
        seen, total = sum(rnd), sum(plain)
        for b in range(SIDE):
            p = 0.5 / ALPHABET + (0.5 * rnd[b] / seen if seen else 0.5 / ALPHABET)
            classes = order[_class_of(a)][_class_of(b)] * within[b]
            q = (1 - BACK_OFF) * plain[b] / total + BACK_OFF * classes if total else classes
            out.append(round(math.log(p) - math.log(q), 5))
    return out


def score(word: str, table: list[float]) -> str:
    """SQL text: the summed log-likelihood ratio of the transitions of ``word`` (an SQL expression)."""
    return (f"aggregate(sequence(1, char_length({word}) - 1), 0D, (a, i) -> a + element_at("
            f"from_json('{json.dumps(table)}', 'array<double>'), "
            f"(ascii(substr({word}, i, 1)) - {FIRST}) * {SIDE} + ascii(substr({word}, i + 1, 1)) - {FIRST - 1}))")


def calibrated(df: DataFrame, text_col: str, counts: list) -> float:
    """The margin: ``MARGIN``, or the least 1/``BINS`` that at most ``FALSE_ALARMS`` of the ordinary runs of 16 or more
    characters in half 1, and ``SLACK`` more, exceed under the model of half 0."""
    table = ratio_table([r for r in counts if r["half"] == 0])
    runs = (halved(df, text_col).where("half = 1").select(F.explode(ordinary_runs()).alias("w"))
            .where((F.length("w") >= 16) & F.col("w").rlike("[A-Za-z]")))
    bins = F.ceil(F.expr(score("w", table)) / (F.length("w") - 1) * BINS)
    over = sorted(((r["bin"], r["n"]) for r in runs.groupBy(bins.alias("bin")).agg(F.count("*").alias("n")).collect()),
                  reverse=True)
    allowed = FALSE_ALARMS * sum(n for _, n in over) + SLACK
    for b, n in over:
        allowed -= n
        if allowed < 0:
            return max(MARGIN, b / BINS)
    return MARGIN


def with_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one span column (start, end, match) per kind."""
    df = df.select(*[c for c in df.columns if c not in KINDS])
    counts = transition_counts(df, text_col).collect()
    margin = calibrated(df, text_col, counts)
    found = S.with_matches(with_patterns(df, text_col), "random", text_col, CANDIDATE)
    found = found.withColumn("random", S.apart("random", *BASE))
    return found.withColumn("random", F.expr(
        f"filter(random, x -> {score('x.m', ratio_table(counts))} > {margin}D * (char_length(x.m) - 1))"))


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = with_secrets(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
    base = S.joined(*[(k, i, k) for i, k in enumerate(BASE)])
    return found.select(F.col("__id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(base, 256).alias("base_sha256"),
                        S.joined(*[(k, i, k) for i, k in enumerate(KINDS)]).alias("spans"))


def without_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """All rows of ``df`` with its columns; every span in the text is replaced by ``mask``."""
    found = with_secrets(df, id_col, text_col).withColumn("__all", F.concat(*map(F.col, KINDS)))
    return found.withColumn(text_col, S.masked(text_col, "__all", mask)).select(*df.columns)
