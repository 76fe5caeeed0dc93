"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of ``window`` consecutive words of the test items (an item of fewer words is one
window). Texts are normalised byte for byte (A-Z lower-cased, every separator a blank), so an offset in the normalised
text is an offset in the original; words are then joined by single blanks and scanned once.

The test set is a stated query set. It is read in blocks of at most ``block_bytes`` characters of items, one automaton
(and one scan) per block, so neither the driver nor an executor ever holds more than one bounded block. A test set within
one block, the usual case, needs one automaton and one scan.

Defined cases: null or empty texts have no words, no hits and no items; null items and items without words give no
window; a null item_id counts as a hit and is listed as ``null``; repeated items are listed once; ties do not arise.
Texts of any length are scanned whole; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

WINDOW = 10
_NORMAL = bytes(C.LOWER[b] if C.ALNUM_WORDS[b] else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def item_windows(text: str | None, window: int = WINDOW) -> set[bytes]:
    w = words_of(text)
    if not w:
        return set()
    return {b" ".join(w[i:i + window]) for i in range(max(1, len(w) - window + 1))}


def automaton_of(patterns: dict[bytes, set[str]]) -> ahocorasick.Automaton:
    """Automaton over the windows, each between blanks; its values are (number of words, item ids)."""
    a = ahocorasick.Automaton()
    for p, items in patterns.items():
        a.add_word(f" {p.decode('latin-1')} ", (p.count(b" ") + 1, tuple(sorted(items))))
    if len(a):
        a.make_automaton()
    return a


_NOT_BLANK = np.arange(256) != 0x20


def scan(raw: bytes, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(number of words, word ranges of all occurring windows, ids of their items) of one text."""
    words = raw.translate(_NORMAL).split()
    hits, items = [], set()
    if words and len(automaton):
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(automaton.iter(line))
        if found:
            blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
            ends = np.searchsorted(blanks, [e for e, _ in found])
            for to, (_, (n, ids)) in zip(ends.tolist(), found):
                hits.append((to - n, to))
                items.update(ids)
    return len(words), hits, items


def union(ranges) -> list[tuple[int, int]]:
    """Sorted disjoint ranges that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(ranges)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_spans(raw: bytes, word_hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original text, from the first to the last word of each hit range."""
    flat = np.frombuffer(raw.translate(_NORMAL), np.uint8)
    starts, ends, _ = C.word_ranges(flat, np.array([0, len(flat)]), _NOT_BLANK)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in word_hits]


def pattern_blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
    """The items' windows in blocks of at most ``block_bytes`` characters of item text (a longer item stands alone)."""
    patterns: dict[bytes, set[str]] = {}
    held = 0
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for r in rows.toLocalIterator():
        size = len(r["t"] or "")
        if patterns and held + size > block_bytes:
            yield patterns
            patterns, held = {}, 0
        for w in item_windows(r["t"], window):
            patterns.setdefault(w, set()).add("null" if r["i"] is None else r["i"])
        held += size
    yield patterns


_PAIRS = "array<struct<a:bigint,b:bigint>>"
_PAIR_TYPE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def hit_words(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
              block_bytes: int = 16 << 20) -> DataFrame:
    """All columns of ``docs`` and: n_words, hits (word ranges, end exclusive), spans (byte ranges of the original text)
    and items (sorted ids of the test items with an occurring window)."""
    out = ("n_words", "hits", "spans", "items")
    keep = [c for c in docs.columns if c not in out]
    schema = docs.select(*keep).withColumns({
        "n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast(_PAIRS), "spans": F.lit(None).cast(_PAIRS),
        "items": F.lit(None).cast("array<string>")}).schema
    df = docs.select(*keep)
    for i, patterns in enumerate(pattern_blocks(items, item_col, item_text, window, block_bytes)):
        df = (C.written(df, "decontaminate") if i else df).mapInArrow(
            _scanner(docs.sparkSession.sparkContext.broadcast(patterns), keep, text_col), schema)
    return df


def _scanner(sent, keep: list[str], text_col: str):
    def run(batches):
        automaton = automaton_of(sent.value)
        for batch in batches:
            for part in C.slices(batch, text_col):
                before = [part.column(part.schema.get_field_index(c)).to_pylist() if c in part.schema.names else None
                          for c in ("hits", "items")]
                counts, hits, spans, ids = [], [], [], []
                texts = part.column(part.schema.get_field_index(text_col)).cast(pa.binary())
                for i, raw in enumerate(texts.to_pylist()):
                    n, found, items = scan(raw or b"", automaton)
                    if before[0] is not None:
                        found += [(h["a"], h["b"]) for h in before[0][i]]
                        items.update(before[1][i])
                    found = union(found)
                    counts.append(n)
                    hits.append([{"a": a, "b": b} for a, b in found])
                    spans.append([{"a": a, "b": b} for a, b in byte_spans(raw, found)] if found else [])
                    ids.append(sorted(items))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(counts, pa.int64()),
                     pa.array(hits, _PAIR_TYPE), pa.array(spans, _PAIR_TYPE), pa.array(ids, pa.list_(pa.string()))],
                    names=[*keep, "n_words", "hits", "spans", "items"])

    return run


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    hit = hit_words(docs.select(F.col(id_col), F.col(text_col)), items, id_col, text_col)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["b"] - h["a"])
    return hit.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      (F.size("hits") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any occurring window, with their columns."""
    hit = hit_words(docs, items, id_col, text_col)
    return hit.where(F.size("hits") == 0).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT id, n, list_slice(ws, i, i + n - 1) AS x
       FROM (SELECT id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, list_slice(ws, i, i + n - 1) AS x
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.id FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
hw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(DISTINCT id) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""
