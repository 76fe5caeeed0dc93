"""URL filter: rules first, then a character language-model ratio.

Two variable-order Markov models over characters, one of accepted and one of rejected URLs, are counted from all URLs
that a rule decides. Contexts of up to three characters are interpolated by Witten-Bell smoothing, so an unseen context
backs off to a shorter one. A URL's score is the difference of the two log-likelihoods over its length; it is accepted
if the score reaches a threshold calibrated on held-out URLs (each half of the labelled URLs is scored by models of the
other half, and the threshold with the best balanced accuracy is taken).

Scale: the counts are summed per batch and per task before one shuffle, over all rows. A model has at most
``SYMBOLS`` ** 4 cells whatever the input, which bounds what is collected and sent to executors (29 MB as 4-byte
numbers). Scoring reads each URL once, without a shuffle. Only the URL column is read.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and is judged by the model as the
text that it is (null as empty); repeated rows are judged alike; without accepted or without rejected URLs everything
undecided is allowed; an empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

# Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))

_PUNCTUATION = b"./-_:?=&#%~+@,"
#: Letters (either case) 0-25, digits 26-35, punctuation 36-49, all other bytes 50, the text's edge 51.
SYMBOLS = 52
EDGE = 51
ORDER = 3
CODES = np.full(256, 50, np.int64)
for _i in range(26):
    CODES[65 + _i] = CODES[97 + _i] = _i
for _i in range(10):
    CODES[48 + _i] = 26 + _i
for _i, _b in enumerate(_PUNCTUATION):
    CODES[_b] = 36 + _i
BINS = 2000
SPAN = 10.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each character with the three before it, text of each); a text ends with the edge symbol."""
    n, lens = len(offsets) - 1, np.diff(offsets)
    starts = offsets[:-1] + np.arange(n) * (ORDER + 1)
    seq = np.full(len(buf) + n * (ORDER + 1), EDGE, np.int64)
    text_of = np.repeat(np.arange(n), lens)
    seq[np.arange(len(buf)) + (text_of + 1) * (ORDER + 1) - 1] = CODES[buf]
    code = ((seq[:-3] * SYMBOLS + seq[1:-2]) * SYMBOLS + seq[2:-1]) * SYMBOLS + seq[3:] if len(seq) > 3 else seq[:0]
    at = np.repeat(starts, lens + 1) + np.concatenate([np.arange(k + 1) for k in lens]) if n else seq[:0]
    return code[at], np.repeat(np.arange(n), lens + 1)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """accepted, half, code, n from rows of (url, accepted, half)."""
    def run(batches):
        for batch in batches:
            codes, text_of = grams(*C.column_bytes(batch.column(0)))
            if len(codes):
                group = (np.asarray(batch.column(1)).astype(np.int64) * 2 + np.asarray(batch.column(2)))[text_of]
                keys, n = np.unique(group * SYMBOLS ** 4 + codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys // SYMBOLS ** 4 // 2 == 1), pa.array(keys // SYMBOLS ** 4 % 2),
                     pa.array(keys % SYMBOLS ** 4), pa.array(n.astype(np.int64))], names=["accepted", "half", "code", "n"])

    counted = labelled.select("url", F.col("accepted").cast("int"), F.col("half").cast("int"))
    return (counted.mapInArrow(run, "accepted boolean, half long, code long, n long")
            .groupBy("accepted", "half", "code").agg(F.sum("n").alias("n")))


def witten_bell(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-probability of each (three characters before, character) cell."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        cells = np.bincount(codes % SYMBOLS ** (order + 1), weights=n, minlength=SYMBOLS ** (order + 1))
        cells = cells.reshape(-1, SYMBOLS)
        total, kinds = cells.sum(axis=1, keepdims=True), (cells > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if order else 1, 1)) if order else p.reshape(1, SYMBOLS)
        p = np.where(total > 0, (cells + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
    return np.log(p).astype(np.float32).ravel()


def ratio(rows: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """log P(accepted) - log P(rejected) per cell from count rows (accepted, half, code, n)."""
    model = [witten_bell(rows[keep & (rows[:, 0] == a), 2], rows[keep & (rows[:, 0] == a), 3].astype(float)) for a in (1, 0)]
    return model[0] - model[1]


def packed(table: np.ndarray) -> tuple[int, bytes]:
    """Most contexts are unseen and repeat the numbers of a shorter one, which compresses well."""
    return table.nbytes, pa.Codec("zstd", compression_level=3).compress(table.tobytes(), asbytes=True)


def unpacked(sent: tuple[int, bytes]) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(sent[1], sent[0], asbytes=True), np.float32)


def scores(buf, offsets, table: np.ndarray) -> np.ndarray:
    """Length-normalised score of each text (its edge counts as a character)."""
    codes, text_of = grams(buf, offsets)
    n = len(offsets) - 1
    return np.bincount(text_of, weights=table[codes], minlength=n) / (np.diff(offsets) + 1)


def calibrated(labelled: DataFrame, tables: list[np.ndarray]) -> float:
    """Threshold with the best balanced accuracy on held-out scores, from a histogram of ``BINS`` bins per class."""
    sent = labelled.sparkSession.sparkContext.broadcast([packed(t) for t in tables])

    def run(batches):
        table = [unpacked(t) for t in sent.value]
        for batch in batches:
            half = np.asarray(batch.column(2))
            url = batch.column(0)
            for h in (0, 1):
                pick = half == h
                if pick.any():
                    s = scores(*C.column_bytes(url.filter(pa.array(pick))), table[h])
                    b = np.clip(((s + SPAN) / (2 * SPAN) * BINS).astype(np.int64), 0, BINS - 1)
                    yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(pick)), pa.array(b)],
                                                     names=["accepted", "bin"])

    hist = (labelled.select("url", "accepted", F.col("half").cast("int")).mapInArrow(run, "accepted boolean, bin long")
            .groupBy("accepted", "bin").count().collect())
    n = np.zeros((2, BINS))
    for r in hist:
        n[int(r["accepted"]), r["bin"]] += r["count"]
    below = np.cumsum(n, axis=1) / np.maximum(n.sum(axis=1, keepdims=True), 1)
    gain = np.concatenate(([0.0], below[0] - below[1]))  # rejected below the threshold less accepted below it
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2]) / BINS * 2 * SPAN - SPAN


def with_verdicts(df: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``df`` with host, path, rule (null if none fits), score (of the models) and verdict (allow or block)."""
    made = ("host", "path", "rule", "score", "verdict")
    base = df.select(*[c for c in df.columns if c not in made])
    host, path = host_and_path(F.col(url_col))
    base = base.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "__by_rule": verdict})
    labelled = base.where(F.col("rule").isNotNull()).select(
        F.col(url_col).alias("url"), (F.col("__by_rule") == "allow").alias("accepted"),
        F.pmod(F.xxhash64(url_col), F.lit(2)).alias("half"))
    found = gram_counts(labelled).toPandas()  # at most 4 * SYMBOLS ** 4 cells
    rows = found.astype({"accepted": "int64"}).to_numpy(dtype=np.int64).reshape(-1, 4)
    table, threshold = np.zeros(1, np.float32), 0.0
    trained = len(set(rows[:, 0])) == 2
    if trained:
        threshold = calibrated(labelled, [ratio(rows, rows[:, 1] != h) for h in (0, 1)])
        table = ratio(rows, np.ones(len(rows), bool))
    sent = df.sparkSession.sparkContext.broadcast(packed(table))

    def run(batches):
        table = unpacked(sent.value)
        for batch in batches:
            for part in C.slices(batch, url_col, 1 << 20):
                t = C.column_bytes(part.column(part.schema.get_field_index(url_col)))
                s = scores(*t, table) if trained else np.zeros(part.num_rows)
                by_rule = part.column(part.schema.get_field_index("__by_rule")).to_pylist()
                said = [v or ("allow" if x >= threshold else "block") for v, x in zip(by_rule, s.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array(said, pa.string())],
                                                 names=[*part.schema.names, "score", "verdict"])

    schema = base.withColumns({"score": F.lit(0.0), "verdict": F.lit("")}).schema
    return base.mapInArrow(run, schema).drop("__by_rule")


def url_report(df: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score of every URL."""
    return with_verdicts(df.select(id_col, url_col), url_col).select(id_col, "host", "path", "rule", "verdict", "score")
