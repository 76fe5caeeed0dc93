"""Blocks of texts, and the exchange that tells every block which of its keys occur elsewhere.

``write_blocks`` packs the rows of a table into blocks of a few MB, one row per block, in a written table. A block's
content never changes afterwards, so several passes may compute the same keys from it.

``shared_keys`` sends each block's distinct keys (48-bit hashes), packed by hash range, to the range's bucket, where the
blocks' counts are summed, and returns to each block those of its keys that occur at least twice. A key that a third of
all rows hold is sent once per block, with its count: neither a bucket nor a reply grows with the rows of one key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common as C

#: Stands for a null id in packed ids; sorts after every other id.
NULL_ID = np.iinfo(np.int64).max
MAX_TEXTS = 1 << 15
KEY_BITS = 48
BLOCK_BYTES = 4 << 20


def ids_array(col) -> np.ndarray:
    col = C.long_ids(col)
    return np.asarray(col.fill_null(NULL_ID) if col.null_count else col).astype(np.int64)


def ids_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def squeeze(buf: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(buf.tobytes(), asbytes=True)


def expand(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(raw, size, asbytes=True), np.uint8)


def write_blocks(df: DataFrame, id_col: str, text_col: str, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written rows of (block, n_bytes, ids, lens, text): packed ids and lengths, compressed bytes of all texts."""
    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def pack():
            buf = np.concatenate([b for b, _, _ in held])
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "n_bytes": pa.array([len(buf)], pa.int64()),
                "ids": [np.concatenate([i for _, _, i in held]).tobytes()],
                "lens": [np.concatenate([n for _, n, _ in held]).tobytes()], "text": [squeeze(buf)]})

        for batch in batches:
            for part in C.slices(batch, "t", block_bytes):
                for at in range(0, part.num_rows, MAX_TEXTS):
                    cut = part.slice(at, MAX_TEXTS)
                    buf, offsets = C.column_bytes(cut.column(1))
                    rows = sum(len(i) for _, _, i in held) + cut.num_rows
                    if held and (size + len(buf) > block_bytes or rows > MAX_TEXTS):
                        yield pack()
                        block, held, size = block + 1, [], 0
                    held.append((buf, np.diff(offsets), ids_array(cut.column(0))))
                    size += len(buf)
        if held:
            yield pack()

    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return C.written(rows.mapInArrow(run, "block long, n_bytes long, ids binary, lens binary, text binary"), name)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, ids) of one block."""
    lens = np.frombuffer(row["lens"], np.int64)
    return (expand(row["text"], int(lens.sum())), np.concatenate(([0], np.cumsum(lens))),
            np.frombuffer(row["ids"], np.int64))


def pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def by_range(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys' runs of one bucket each (``buckets`` equal hash ranges): bucket numbers, first positions and end.

    The work grows with the keys, not with the buckets, of which a large table has millions.
    """
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    half, n = C.U64(KEY_BITS // 2), C.U64(buckets)
    high, low = keys >> half, keys & C.U64((1 << KEY_BITS // 2) - 1)
    number = ((high * n + (low * n >> half)) >> half).astype(np.int64)  # key * buckets >> KEY_BITS, within 64 bits
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    return number[first], np.append(first, len(keys))


def shared_keys(blocks: DataFrame, keys_of, buckets: int) -> DataFrame:
    """(block, keys, counts): each block's packed keys that occur in two texts at least, with 2-byte counts (saturated).

    ``keys_of(buf, offsets, ids)`` gives the block's sorted distinct keys and the number of its texts with each.
    """
    def emit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = keys_of(*unpack(row))
                full, at = by_range(keys, buckets)
                packed, n = pack_keys(keys), np.minimum(n, 65535).astype(np.uint16)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(full, pa.int64()), "block": pa.array([row["block"]] * len(full), pa.int64()),
                    "keys": pa.array([packed[6 * a:6 * z] for a, z in zip(at[:-1], at[1:])], pa.binary()),
                    "counts": pa.array([n[a:z].tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        raw = table.column("keys").to_pylist()
        keys = unpack_keys(b"".join(raw))
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16).astype(np.int64)
        order = np.argsort(keys)
        first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if len(keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(n[order], first) if len(keys) else n
        each = np.empty(len(keys), np.int64)
        each[order] = np.repeat(total, np.diff(np.append(first, len(keys))))
        at, out = np.concatenate(([0], np.cumsum([len(r) // 6 for r in raw]))), []
        for i, block in enumerate(table.column("block").to_pylist()):
            own = slice(at[i], at[i + 1])
            twice = each[own] > 1
            if twice.any():
                out.append((block, pack_keys(keys[own][twice]), np.minimum(each[own][twice], 65535).astype(np.uint16).tobytes()))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary()),
                         "counts": pa.array([x[2] for x in out], pa.binary())})

    sent = blocks.select("block", "ids", "lens", "text").mapInArrow(emit, "bucket long, block long, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(count, "block long, keys binary, counts binary")


def reply(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, their counts) from a block's replies."""
    keys = unpack_keys(b"".join(x for x in table.column("keys").to_pylist() if x))
    n = np.frombuffer(b"".join(x for x in table.column("counts").to_pylist() if x), np.uint16)
    order = np.argsort(keys)
    return keys[order], n[order]
