"""Positions of all matches of a pattern, with built-in functions only.

``regexp_extract_all`` gives the matches and ``split`` the pieces between them; running sums of their lengths are the
offsets, in code points. The sums run in chunks of 256 matches, so a text with very many matches stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"
_CHUNK = 256


def with_matches(df: DataFrame, name: str, text_col: str, pattern: str, only_if: Column | None = None) -> DataFrame:
    """Add ``name``: start, end (exclusive) and text of the leftmost non-overlapping matches. Null text: no match.

    ``only_if`` may name a cheap condition without which the pattern cannot match.
    """
    t, p, found = F.col(text_col), F.lit(pattern), f"__{name}"
    none = F.array().cast("array<string>")
    m = F.coalesce(F.regexp_extract_all(t, p, F.lit(0)), none)
    df = df.withColumn(found, m if only_if is None else F.when(only_if, m).otherwise(none))
    pieces = f"__{name}_parts"
    df = df.withColumn(pieces, F.when(F.size(found) > 0, F.split(t, pattern, -1)))
    return df.withColumn(name, F.expr(f"""
        CASE WHEN size({found}) > 0 THEN
          aggregate(array(zip_with(slice({pieces}, 1, size({found})), {found},
                    (a, b) -> named_struct('gap', char_length(a), 'len', char_length(b), 'm', b))), cast(array() AS {SPAN}),
            (none, steps) -> aggregate(array(transform(sequence(0, (size(steps) - 1) div {_CHUNK}),
                                                       c -> slice(steps, c * {_CHUNK} + 1, {_CHUNK}))), none,
              (none2, chunks) -> flatten(zip_with(chunks,
                aggregate(transform(chunks, c -> aggregate(c, 0, (s, x) -> s + x.gap + x.len)),
                          named_struct('at', 0, 'all', cast(array() AS array<int>)),
                          (s, x) -> named_struct('at', s.at + x, 'all', concat(s.all, array(s.at)))).all,
                (c, base) -> aggregate(c, named_struct('at', base, 'all', cast(array() AS {SPAN})),
                  (s, x) -> named_struct('at', s.at + x.gap + x.len, 'all', concat(s.all, array(
                    named_struct('s', s.at + x.gap, 'e', s.at + x.gap + x.len, 'm', x.m))))).all))))
        ELSE cast(array() AS {SPAN}) END""")).drop(found, pieces)


def joined(*kinds: tuple[str, int, str]) -> Column:
    """``kind:start:end`` of all spans by start, then kind rank, comma-joined; kinds: (column, rank, label)."""
    def labelled(rank, label):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("r"), x["e"].alias("e"), F.lit(label).alias("k"))
    parts = [F.transform(F.col(c), labelled(r, k)) for c, r, k in kinds]
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*parts)), lambda x: F.concat_ws(
        ":", x["k"], x["s"].cast("string"), x["e"].cast("string"))))


def apart(added: str, *others: str) -> Column:
    """The spans of ``added`` that overlap no span of the other columns."""
    return F.filter(F.col(added), lambda x: ~F.exists(F.concat(*map(F.col, others)),
                                                      lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))


def leftmost(name: str) -> Column:
    """The spans of ``name``, ordered by start, without those that begin inside the one kept before."""
    return F.expr(f"""aggregate({name}, cast(array() AS {SPAN}), (a, x) ->
        CASE WHEN size(a) = 0 OR element_at(a, -1).e <= x.s THEN concat(a, array(x)) ELSE a END)""")


def masked(text_col: str, spans: str, mask: str) -> Column:
    """The text with every span of the column replaced by ``mask`` (overlapping spans are replaced as one)."""
    return F.expr(f"""
        CASE WHEN size({spans}) = 0 THEN {text_col} ELSE
          aggregate(array_sort(transform({spans}, x -> named_struct('s', x.s, 'e', x.e))),
            named_struct('at', 0, 'out', cast(array() AS array<string>)),
            (a, x) -> CASE WHEN x.s < a.at THEN named_struct('at', greatest(a.at, x.e), 'out', a.out)
                      ELSE named_struct('at', x.e, 'out', concat(a.out, array(
                        substring({text_col}, a.at + 1, x.s - a.at), '{mask}'))) END,
            a -> concat_ws('', concat(a.out, array(substring({text_col}, a.at + 1, char_length({text_col})))))) END""")
