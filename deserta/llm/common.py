"""Shared folder tables, Arrow text buffers and vectorised word hashing used by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new folder below ``spark.checkpoint.dir`` and read it back (cuts lineage)."""
    from deserta.session import ensure_checkpoint_dir  # here, as this module travels to executors by value

    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of the whole column; sizes the number of buckets so that one bucket stays small at any input size."""
    from pyspark.sql import functions as F

    return df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def buckets_for(spark: SparkSession, total_bytes: int, per_bucket: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // per_bucket))


# ---- Arrow columns -------------------------------------------------------------------------------------------

def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values one after the other, offsets of n + 1 values) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset:col.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return buf, offsets - first


def slices(batch: pa.RecordBatch, text_col: str, max_bytes: int = 4 << 20):
    """Cut a batch into runs of rows holding at most ``max_bytes`` of text (a longer text stands alone, whole)."""
    _, offsets = column_bytes(batch.column(batch.schema.get_field_index(text_col)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def long_ids(col) -> pa.Array:
    return col.cast(pa.int64())


# ---- words ---------------------------------------------------------------------------------------------------

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of bytes outside the six ASCII blanks.
BLANK_WORDS = ~SPACES
#: Words are runs of ASCII letters and digits and of all bytes of longer UTF-8 sequences.
ALNUM_WORDS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

#: Byte ranges are hashed in pieces of a text of about this size, so that the tables of powers and sums stay small.
SLICE = 1 << 18
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for pieces of the usual size, made anew for longer ones."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE)
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 2 * SLICE:
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, equal for equal bytes wherever they stand."""
    out, at = np.empty(len(starts), np.uint64), 0
    if (starts[1:] < starts[:-1]).any():
        order = np.argsort(starts, kind="stable")
        out[order] = range_hashes(buf, starts[order], ends[order])
        return out
    while at < len(starts):
        first = int(starts[at])
        to = int(np.searchsorted(starts, first + SLICE))
        s, e = starts[at:to] - first, ends[at:to] - first
        piece = buf[first:first + int(e.max())]
        up, down = powers(len(piece) + 1)
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        np.cumsum((piece.astype(np.uint64) + U64(1)) * up[:len(piece)], out=total[1:])
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
        at = to
    return out


def word_ranges(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text + total) of the runs of bytes with ``inside[byte]``; texts stay apart."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = inside[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1] | edge[1:n]
    last[:-1] &= ~m[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of k consecutive words inside one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(bounds)
    text_of = np.repeat(np.arange(len(counts)), counts)
    h = words[:n].copy()
    for j in range(1, k):
        h = mix(h + U64(j)) + words[j:j + n] * U64(0x9FB21C651E98DF25)
    at = np.flatnonzero(text_of[:n] == text_of[k - 1:k - 1 + n])
    return mix(h[at]), at


def distinct_per_text(keys: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, key) pairs, sorted by text and then key."""
    if not len(keys):
        return keys, text_of
    order = np.lexsort((keys, text_of))
    k, t = keys[order], text_of[order]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return k[keep], t[keep]


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    at = np.cumsum(lens) - lens
    return np.repeat(starts - at, lens) + np.arange(int(lens.sum()))


def sequence_hashes(values: np.ndarray, k: int, prime: int) -> np.ndarray:
    """Hash of the k values from each position, by doubling the hashed length; empty when there are fewer than k."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    h, length, out, left = values.astype(np.uint64), 1, None, k
    while True:
        if left & 1:
            out = h if out is None else out[:len(out) - length] * U64(pow(prime, length, 1 << 64)) + h[-(len(out) - length):]
        left >>= 1
        if not left:
            return mix(out)
        h = h[:len(h) - length] * U64(pow(prime, length, 1 << 64)) + h[length:]
        length *= 2
