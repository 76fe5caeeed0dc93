"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds per MB of text) and selectivity (share of documents it rejects) are measured on a sample;
the rules then run in falling order of rejection per cost, each only on the documents that all earlier ones kept. The
order changes the time, never the verdict: a document stays if no rule rejects it.

Defined cases: a null or empty text has no words and every count 0; a text of any length is judged whole; equal rows get
equal verdicts; an empty table gives an empty result; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Texts:
    """A run of texts with the pieces that the rules share, each computed on first use."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self._kept = buf, offsets, {}

    def _once(self, key: str, make: Callable):
        if key not in self._kept:
            self._kept[key] = make()
        return self._kept[key]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def subset(self, alive: np.ndarray) -> "Texts":
        lens = np.diff(self.offsets)
        offsets = np.concatenate(([0], np.cumsum(lens[alive])))
        return Texts(self.buf[np.repeat(alive, lens)], offsets)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self):
        return self._once("words", lambda: C.word_ranges(self.buf, self.offsets, C.BLANK_WORDS))

    def n_words(self) -> np.ndarray:
        return np.diff(self.words()[2])

    def word_chars(self) -> np.ndarray:
        return self._once("chars", lambda: self.per_text(C.BLANK_WORDS[self.buf] & ((self.buf & 0xC0) != 0x80)))

    def n_symbols(self) -> np.ndarray:
        return self._once("symbols", lambda: self.per_text(SYMBOLS[self.buf]))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of lines with a word, how many of them equal an earlier one) of each text."""
        return self._once("lines", self._lines)

    def _lines(self):
        starts, ends, bounds = C.word_ranges(self.buf, self.offsets, np.arange(256) != 10)
        ok = np.concatenate(([0], np.cumsum(C.BLANK_WORDS[self.buf], dtype=np.int64)))
        wordy = ok[ends] > ok[starts]
        text_of = np.repeat(np.arange(len(self)), np.diff(bounds))[wordy]
        keys = C.range_hashes(self.buf, starts[wordy], ends[wordy])
        _, distinct = C.distinct_per_text(keys, text_of)
        n = np.bincount(text_of, minlength=len(self))
        return n, n - np.bincount(distinct, minlength=len(self))

    def n_dup_lines(self) -> np.ndarray:
        return self.lines()[1]

    def n_repeat_words(self) -> np.ndarray:
        return self._once("repeat", self._repeat)

    def _repeat(self):
        starts, ends, bounds = self.words()
        keys, at = C.window_hashes(C.range_hashes(self.buf, starts, ends), bounds, 3)
        covered = np.zeros(len(starts), bool)
        if len(keys):
            text_of = np.repeat(np.arange(len(self)), np.diff(bounds))[at]
            order = np.lexsort((keys, text_of))
            k, t = keys[order], text_of[order]
            same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
            twice = np.zeros(len(k), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hits = at[order[twice]]
            for j in range(3):
                covered[hits + j] = True
        total = np.concatenate(([0], np.cumsum(covered, dtype=np.int64)))
        return total[bounds[1:]] - total[bounds[:-1]]

    def upper_lower(self) -> tuple[np.ndarray, np.ndarray]:
        def make():
            b = self.buf
            return self.per_text((b >= 65) & (b <= 90)), self.per_text((b >= 97) & (b <= 122))
        return self._once("case", make)


@dataclass(frozen=True)
class Rule:
    """``rejects(texts)`` gives a boolean per text."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


#: Limits are far from prose: three symbols in ten words, half of the lines repeated, half of the letters upper case.
DEFAULT_RULES = (
    Rule("few_words", lambda t: t.n_words() < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words() > 50 * t.n_words()),
    Rule("symbols", lambda t: 100 * t.n_symbols() > 30 * t.n_words()),
    Rule("repeated_lines", lambda t: 100 * t.lines()[1] > 50 * t.lines()[0]),
    Rule("word_length", lambda t: (t.word_chars() < 2 * t.n_words()) | (t.word_chars() > 20 * t.n_words())),
    Rule("shouting", lambda t: t.upper_lower()[0] > t.upper_lower()[1]),
)


def measured_order(df: DataFrame, rules=DEFAULT_RULES, text_col: str = "text", sample_rows: int = 2000,
                   seed: int = 7) -> list[Rule]:
    """Rules by falling rejection per cost, from at most ``sample_rows`` sampled rows (sampling is this step's purpose).

    Runs as one small job; only one line per rule and sample partition returns to the driver.
    """
    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                t = C.column_bytes(batch.column(0))
                rows = []
                for i, r in enumerate(rules):
                    began = time.perf_counter()
                    n = int(np.count_nonzero(r.rejects(Texts(*t))))
                    rows.append((i, time.perf_counter() - began, n, batch.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)],
                                                 names=["rule", "secs", "rejected", "rows"])

    sample = df.select(F.col(text_col).alias("t")).sample(fraction=0.05, seed=seed).limit(sample_rows)
    got = (sample.mapInArrow(probe, "rule long, secs double, rejected long, rows long")
           .groupBy("rule").agg(F.sum("secs").alias("secs"), F.sum("rejected").alias("rejected")).collect())
    gain = {r["rule"]: (r["rejected"] + 0.5) / max(r["secs"], 1e-9) for r in got}
    return sorted(rules, key=lambda r: -gain.get(rules.index(r), 0.0))


def cascade(texts: Texts, rules: list[Rule]) -> np.ndarray:
    """True for the texts that every rule keeps; a rule only sees what the rules before it kept."""
    kept = np.ones(len(texts), bool)
    here = texts
    for r in rules:
        out = r.rejects(here)
        if out.any():
            kept[np.flatnonzero(kept)[out]] = False
            here = here.subset(~out)
        if not len(here):
            break
    return kept


def quality_filter(df: DataFrame, text_col: str = "text", rules=DEFAULT_RULES, order: list[Rule] | None = None) -> DataFrame:
    """The rows of ``df`` that the cascade keeps, with all their columns."""
    order = order if order is not None else measured_order(df, rules, text_col)

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, text_col):
                col = part.column(part.schema.get_field_index(text_col))
                yield part.filter(pa.array(cascade(Texts(*C.column_bytes(col)), order)))

    return df.mapInArrow(run, df.schema)


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=DEFAULT_RULES) -> DataFrame:
    """Counts of every document and its verdict: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (under 50 words, or over half of them in repeated 3-word windows), kept."""
    order = measured_order(df, rules, text_col)

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, "__t"):
                t = Texts(*C.column_bytes(part.column(1)))
                stats = [getattr(t, s)().astype(np.int64) for s in STATS]
                failed = (stats[0] < 50) | (100 * stats[4] > 50 * stats[0])
                kept = ~failed
                if kept.any():
                    kept[np.flatnonzero(kept)] = cascade(t.subset(~failed), order)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (*stats, failed, kept))],
                                                 names=["id", *STATS, "base_failed", "kept"])

    idf = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t"))
    schema = (f"id {idf.schema['id'].dataType.simpleString()}, " + ", ".join(f"{s} long" for s in STATS)
              + ", base_failed boolean, kept boolean")
    return idf.mapInArrow(run, schema).withColumnRenamed("id", id_col)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, list_slice(ws, i, i + 2) AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) o(j) GROUP BY r),
ln AS (SELECT r, l FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY r),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, coalesce(dup.n_lines, 0) AS n_lines,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
      FROM w LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR n_upper > n_lower) AS kept
FROM f
"""
