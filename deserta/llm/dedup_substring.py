"""Exact substring deduplication over words, with a count-min sketch before the exact grouping.

Every word that lies in a window of ``WINDOW`` consecutive words whose word sequence also starts in a document of smaller
id is removed. Two passes find those windows:

1. Prefilter. Every block of texts counts its windows in count-min sketches: a window's hash names a segment of the key
   space and, in each of ``DEPTH`` rows of ``WIDTH`` counters there, a counter. A block sends only the counters that are
   not zero, as gaps between them. Per segment the blocks' sketches are added up, and each block gets back which of its
   counters stand at two or more. The smallest of a window's counters is never below its count, so a window that
   occurs twice is always estimated to be repeated, and none is lost; of the others few are, as a segment's counters
   outnumber its windows four times.
2. Exact grouping. The windows estimated to be repeated are grouped by 96 bits of hash (two independent ones over 64-bit
   hashes of words). A block sends each of its distinct windows once, with its smallest document, and gets back one
   bit: whether a smaller document elsewhere has it. Windows of one block are told apart in the block itself.

Scale: segments number in proportion to the text (``SEGMENT_BYTES``), so a segment's sketch, of fixed size, is as full at
any input size. A window that a third of all documents hold is one counter and one entry per block. No bucket, reply or
block grows with a window's count; nothing but a byte count reaches the driver. The passes recompute the same windows from
written blocks, in the same order, so a lost executor's work is done again.

Defined cases: a null or empty text has no words and nothing is removed (the digest is that of no bytes); a text of
fewer words than a window loses nothing; repeats within one document, and rows of equal id, do not remove each other; a
null id is larger than any other; an empty table gives an empty result; input columns named like an output column are
replaced. A text of any length is one block and judged whole, at about 30 times its size in one task.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks as B, common as C

WINDOW = 13
DEPTH = 2
WIDTH_BITS = 22
#: A segment has the windows of about this many bytes of text, a million: a quarter of a row's counters.
SEGMENT_BYTES = 5 << 20
BLOCK_BYTES = 8 << 20
_PRIMES = (0x100000001B3, 0xD6E8FEB86659FD93)


class Windows:
    """The windows of one block's texts: the word each begins with, its text and its two hashes."""

    def __init__(self, row: dict, window: int):
        self.buf, self.offsets, self.ids = B.unpack(row)
        starts, ends, self.bounds = C.word_ranges(self.buf, self.offsets, C.BLANK_WORDS)
        words = C.range_hashes(self.buf, starts, ends)
        counts = np.diff(self.bounds)
        inside = np.maximum(counts - window + 1, 0)
        self.at = C.ranges(self.bounds[:-1], inside)
        self.text = np.repeat(np.arange(len(counts)), inside)
        self.first = C.sequence_hashes(words, window, _PRIMES[0])[self.at]
        self.second = (C.sequence_hashes(words, window, _PRIMES[1])[self.at] >> C.U64(32)).astype(np.uint32)


# ---- segments and packed columns -------------------------------------------------------------------------------------

def segment_runs(hashes: np.ndarray, segments: int):
    """(segment, begin, end) of each run of one segment in sorted hashes; segments are equal ranges of the high bits."""
    if not len(hashes):
        return
    number = (hashes >> C.U64(32)) * C.U64(segments) >> C.U64(32)
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    yield from zip(number[first].tolist(), first.tolist(), np.append(first[1:], len(hashes)).tolist())


def counters(hashes: np.ndarray, row: int) -> np.ndarray:
    """The counter of each window in one row of its segment's sketch, from bits that do not name the segment."""
    mixed = hashes << C.U64(32) if row == 0 else C.mix(hashes + C.U64(row * 0x51ED270B))
    return (mixed >> C.U64(64 - WIDTH_BITS)).astype(np.uint32)


def planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, all first bytes before all second ones, so that the alike high bytes compress."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return B.squeeze(np.ascontiguousarray(raw.T))


def from_planes(raw: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(B.expand(raw, n * size).reshape(size, n).T).view(dtype).ravel()


# ---- first pass: sketches --------------------------------------------------------------------------------------------

def sketch_messages(row: dict, window: int, segments: int):
    """The block's sketch: per segment and row, the counters in use and their counts (255 stands for more)."""
    hashes = np.sort(Windows(row, window).first)
    for segment, a, z in segment_runs(hashes, segments):
        for depth in range(DEPTH):
            used, n = np.unique(counters(hashes[a:z], depth), return_counts=True)
            yield {"segment": segment, "block": row["block"], "depth": depth, "n": len(used),
                   "gaps": planes(np.diff(used, prepend=np.uint32(0))),
                   "counts": B.squeeze(np.minimum(n, 255).astype(np.uint8))}


SKETCH = "segment long, block long, depth long, n long, gaps binary, counts binary"
FLAGS = "block long, segment long, depth long, bits binary"


def merged(table: pa.Table) -> pa.Table:
    """Adds up the blocks' sketches of one segment and tells each block which of its counters stand at two or more."""
    rows = table.to_pylist()
    total = np.zeros((DEPTH, 1 << WIDTH_BITS), np.uint8)
    used = [np.cumsum(from_planes(r["gaps"], r["n"], np.uint32), dtype=np.uint32) for r in rows]
    for r, at in zip(rows, used):
        row = total[r["depth"]]
        row[at] = np.minimum(row[at].astype(np.uint16) + B.expand(r["counts"], r["n"]), 255)
    out = []
    for r, at in zip(rows, used):
        twice = total[r["depth"]][at] > 1
        if twice.any():
            out.append({"block": r["block"], "segment": r["segment"], "depth": r["depth"],
                        "bits": np.packbits(twice).tobytes()})
    return as_table(out, FLAGS)


def as_table(rows: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary())
                                                 for c in schema.split(", ")]))


def estimated_repeated(w: Windows, segments: int, flags: list[dict]) -> np.ndarray:
    """Positions of the windows all of whose counters stand at two or more."""
    told = {(r["segment"], r["depth"]): r["bits"] for r in flags}
    order = np.argsort(w.first)
    hashes, found = w.first[order], []
    for segment, a, z in segment_runs(hashes, segments):
        if any((segment, depth) not in told for depth in range(DEPTH)):
            continue
        twice = np.ones(z - a, bool)
        for depth in range(DEPTH):
            used, which = np.unique(counters(hashes[a:z], depth), return_inverse=True)
            bits = np.frombuffer(told[segment, depth], np.uint8)
            twice &= np.unpackbits(bits, count=len(used)).astype(bool)[which]
        found.append(order[a:z][twice])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


# ---- second pass: exact grouping -------------------------------------------------------------------------------------

class Repeated:
    """The block's windows estimated to be repeated, in order of their hashes, with the heads of equal ones."""

    def __init__(self, w: Windows, segments: int, flags: list[dict]):
        at = estimated_repeated(w, segments, flags)
        ids = w.ids[w.text[at]]
        order = np.lexsort((ids, w.second[at], w.first[at]))
        self.at, self.ids = at[order], ids[order]
        self.first, self.second = w.first[self.at], w.second[self.at]
        new = np.ones(len(at), bool)
        new[1:] = (self.first[1:] != self.first[:-1]) | (self.second[1:] != self.second[:-1])
        self.head = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.low = self.ids[self.head]


def window_messages(row: dict, window: int, segments: int, flags: list[dict]):
    r = Repeated(Windows(row, window), segments, flags)
    first, second = r.first[r.head], r.second[r.head]
    for segment, a, z in segment_runs(first, segments):
        yield {"segment": segment, "block": row["block"], "n": z - a, "first": planes(first[a:z]),
               "second": second[a:z].tobytes(), "low": planes(r.low[a:z])}


SENT = "segment long, block long, n long, first binary, second binary, low binary"


def grouped(table: pa.Table) -> pa.Table:
    """Groups one segment's windows exactly; a block is told which of its windows a smaller document elsewhere has."""
    rows = table.to_pylist()
    first = np.concatenate([from_planes(r["first"], r["n"], np.uint64) for r in rows])
    second = np.concatenate([np.frombuffer(r["second"], np.uint32) for r in rows])
    low = np.concatenate([from_planes(r["low"], r["n"], np.int64) for r in rows])
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    least = np.repeat(np.minimum.reduceat(low[order], head), np.diff(np.append(head, len(order))))
    smaller = np.empty(len(low), bool)
    smaller[order] = least < low[order]
    out, at = [], 0
    for r in rows:
        bits = smaller[at:at + r["n"]]
        if bits.any():
            out.append({"block": r["block"], "segment": r["segment"], "depth": -1, "bits": np.packbits(bits).tobytes()})
        at += r["n"]
    return as_table(out, FLAGS)


def removed_words(row: dict, window: int, segments: int, flags: list[dict]) -> tuple[Windows, np.ndarray]:
    """The block's windows and a flag per word: covered by a window that a document of smaller id has as well."""
    w = Windows(row, window)
    r = Repeated(w, segments, [f for f in flags if f["depth"] >= 0])
    told = {f["segment"]: f["bits"] for f in flags if f["depth"] < 0}
    elsewhere = np.zeros(len(r.head), bool)
    for segment, a, z in segment_runs(r.first[r.head], segments):
        if segment in told:
            elsewhere[a:z] = np.unpackbits(np.frombuffer(told[segment], np.uint8), count=z - a).astype(bool)
    begin = w.at[r.at[elsewhere[r.of] | (r.ids > r.low[r.of])]]
    turn = np.zeros(int(w.bounds[-1]) + 1, np.int32)
    np.add.at(turn, begin, 1)
    np.add.at(turn, begin + window, -1)
    return w, np.cumsum(turn[:-1], dtype=np.int32) > 0


def with_removed(df: DataFrame, finish, schema: str, id_col: str, text_col: str, window: int) -> DataFrame:
    """Rows that ``finish(windows, removed)`` makes of each block, as a dict of columns."""
    blocks = B.write_blocks(df, id_col, text_col, "words", BLOCK_BYTES)
    segments = -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 1) // SEGMENT_BYTES)
    packed = blocks.select("block", "ids", "lens", "text")

    def sketch(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from as_table(list(sketch_messages(row, window, segments)), SKETCH).to_batches()

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.to_pylist()
        return as_table([x for row in left.to_pylist() for x in window_messages(row, window, segments, told)], SENT)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.to_pylist()
        parts = [pa.table(finish(*removed_words(row, window, segments, told))) for row in left.to_pylist()]
        return pa.concat_tables(parts) if parts else none

    empty = {"block": 0, "ids": b"", "lens": b"", "text": B.squeeze(np.zeros(0, np.uint8))}
    none = pa.table(finish(Windows(empty, window), np.zeros(0, bool)))
    flags = C.written(packed.mapInArrow(sketch, SKETCH).groupBy("segment").applyInArrow(merged, FLAGS), "sketch")
    sent = packed.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(send, SENT)
    flags = flags.unionByName(sent.groupBy("segment").applyInArrow(grouped, FLAGS))
    return packed.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(remove, schema)


def kept_words(w: Windows, removed: np.ndarray):
    """The kept words of each text, joined by one space."""
    for i, j, a, z in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        words = w.buf[i:j].tobytes().split()  # at the same six blanks
        gone = removed[a:z]
        yield b" ".join(compress(words, ~gone) if gone.any() else words)


def summary(w: Windows, removed: np.ndarray) -> dict:
    total = np.concatenate(([0], np.cumsum(removed, dtype=np.int64)))
    return {"id": B.ids_column(w.ids), "n_words": pa.array(np.diff(w.bounds), pa.int64()),
            "n_removed": pa.array(total[w.bounds[1:]] - total[w.bounds[:-1]], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept_words(w, removed)], pa.string())}


def kept_texts(w: Windows, removed: np.ndarray) -> dict:
    return {"id": B.ids_column(w.ids), "kept": pa.array(list(kept_words(w, removed)), pa.binary())}


def dedup_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every document."""
    schema = "id long, n_words long, n_removed long, kept_sha256 string"
    return with_removed(df, summary, schema, id_col, text_col, window).withColumnRenamed("id", id_col)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id and kept, the remaining words of every document joined by one space, as bytes."""
    return with_removed(df, kept_texts, "id long, kept binary", id_col, text_col, window).withColumnRenamed("id", id_col)
