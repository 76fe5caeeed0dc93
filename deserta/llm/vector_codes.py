"""Product codes of vectors, with distances shared along a lexicographic trie of the distinct parts.

Each vector is cut into ``parts`` pieces, and each piece is coded by the nearest of its position's ``entries`` codebook
entries. The codebooks start as the pieces of the first vectors by id and are moved ``rounds`` times to the means of the
pieces nearest to them. All arithmetic is on integers, so results do not depend on the order of sums.

The nearest entries come from a trie: the distinct pieces of a position, sorted, share their first dimensions. A node of
depth d stands for a common prefix of d + 1 dimensions and holds the vector of that prefix's squared distances to all
entries, its parent's plus one dimension's. The trie is walked depth first, a run of up to ``RUN`` sibling nodes at a
time, so that a prefix's distances are computed once for all pieces below it and at most ``RUN`` vectors are held per
depth. At the leaves the smallest distance is taken, and the pieces of an entry are added up with the number of times they
occur.

Scale: one scan of the vectors per round and one to code them, without a shuffle of vectors. A task holds the trie of
a bounded number of vectors and sends one partial sum per entry and dimension; those are added map-side and by key. The
codebooks (parts x entries pieces, whatever the input) are all that the driver sees.

Defined cases: vectors that are null, empty or hold null or non-finite components are dropped, as are those of another
length than the kept vector of the smallest id; floor(SCALE * x) beyond +-2**24 counts as that bound; parts are equal
where ``parts`` divides the length and differ by one otherwise; with fewer vectors than ``entries`` the codebooks are
smaller; equal ids are ordered by their vectors, null ids last; repeated rows are coded each; without a kept vector the
result is empty; input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C, vectors as V

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 24
RUN = 2048


def integers(matrix: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(matrix * SCALE), -LIMIT, LIMIT).astype(np.int64)


def cut(dims: int, parts: int) -> list[slice]:
    return [slice(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]


class Trie:
    """The distinct rows of ``pieces`` as leaves of a lexicographic trie, with the number of times each occurs."""

    def __init__(self, pieces: np.ndarray):
        order = np.lexsort(pieces.T[::-1])
        rows = pieces[order]
        new = np.zeros(len(rows), bool)
        new[0] = True
        self.first, self.value = [], []
        for d in range(rows.shape[1]):
            new[1:] |= rows[1:, d] != rows[:-1, d]
            self.first.append(np.flatnonzero(new))
            self.value.append(rows[self.first[-1], d])
        self.leaves = rows[self.first[-1]]
        self.times = np.diff(np.append(self.first[-1], len(rows)))
        self.leaf_of = np.empty(len(rows), np.int64)
        self.leaf_of[order] = np.cumsum(new) - 1
        #: Of each node its parent, and of each node its first child with an end.
        self.parent = [None] + [np.searchsorted(a, b, side="right") - 1 for a, b in zip(self.first, self.first[1:])]
        self.child = [np.append(np.searchsorted(b, a), len(b)) for a, b in zip(self.first, self.first[1:])]

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each leaf; of equally near entries the first."""
        top = int(max(np.abs(self.leaves).max(initial=0), np.abs(book).max(initial=0)))
        kind = np.int32 if book.shape[1] * (2 * top) ** 2 < 1 << 31 else np.int64
        columns = book.T.astype(kind)
        entry, distance = np.empty(len(self.leaves), np.int64), np.empty(len(self.leaves), np.int64)
        last = book.shape[1] - 1

        def walk(depth: int, begin: int, end: int, held: np.ndarray | None, base: int) -> None:
            for a in range(begin, end, RUN):
                z = min(a + RUN, end)
                step = np.square(self.value[depth][a:z, None].astype(kind) - columns[depth])
                if held is not None:
                    step += held[self.parent[depth][a:z] - base]
                if depth < last:
                    walk(depth + 1, int(self.child[depth][a]), int(self.child[depth][z]), step, a)
                else:
                    entry[a:z] = step.argmin(axis=1)
                    distance[a:z] = np.take_along_axis(step, entry[a:z, None], axis=1)[:, 0]

        walk(0, 0, len(self.first[0]), None, 0)
        return entry, distance


def first_books(df: DataFrame, id_col: str, vec_col: str, dims: int, parts: int, entries: int) -> list[np.ndarray]:
    """Per part the pieces of the ``entries`` kept vectors of the smallest ids."""
    kept = df.where(V.whole(vec_col) & (F.size(vec_col) == dims))
    rows = kept.orderBy(F.col(id_col).asc_nulls_last(), F.col(vec_col)).limit(entries).select(vec_col).collect()
    first = integers(np.array([r[0] for r in rows], np.float64))
    return [first[:, s] for s in cut(dims, parts)]


def moved(df: DataFrame, vec_col: str, dims: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks with each entry at the floor of the mean of its pieces; unused entries stay."""
    pieces = cut(dims, len(books))

    def run(batches):
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for _, matrix in V.matrices(batch, "v", dims):
                x = integers(matrix)
                for p, s in enumerate(pieces):
                    if books[p].shape[1]:
                        trie = Trie(x[:, s])
                        entry, _ = trie.nearest(books[p])
                        np.add.at(n[p], entry, trie.times)
                        np.add.at(total[p], entry, trie.leaves * trie.times[:, None])
        for p in range(len(books)):
            used = np.flatnonzero(n[p])
            width = books[p].shape[1]
            if len(used) and width:
                yield pa.RecordBatch.from_pydict({
                    "part": np.full(len(used) * width, p), "entry": np.repeat(used, width),
                    "at": np.tile(np.arange(width), len(used)), "n": np.repeat(n[p][used], width),
                    "total": total[p][used].ravel()})

    sums = (df.select(F.col(vec_col).alias("v")).mapInArrow(run, "part long, entry long, at long, n long, total long")
            .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    out = [b.copy() for b in books]
    for r in sums.collect():  # no more rows than the codebooks have components
        out[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return out


def fitted(df: DataFrame, id_col: str, vec_col: str, parts: int, entries: int, rounds: int) -> tuple[int, list[np.ndarray]]:
    dims = V.dimension(df, id_col, vec_col)
    if not dims:
        return 0, []
    books = first_books(df, id_col, vec_col, dims, parts, entries)
    for _ in range(rounds):
        books = moved(df, vec_col, dims, books)
    return dims, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, label, code (an unsigned byte per part) and error of every kept vector, with the codebooks' digest."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    dims, books = fitted(df, id_col, vec_col, parts, entries, rounds)
    pieces, name = cut(dims, parts), digest(books)

    def run(batches):
        for batch in batches:
            for rows, matrix in V.matrices(batch, "v", dims):
                x = integers(matrix)
                code, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
                for p, s in enumerate(pieces):
                    if books[p].shape[1]:
                        trie = Trie(x[:, s])
                        entry, distance = trie.nearest(books[p])
                        code[:, p], error = entry[trie.leaf_of], error + distance[trie.leaf_of]
                offsets = np.arange(len(rows) + 1, dtype=np.int32) * parts
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                     pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(code.tobytes())]),
                     pa.array(error)], names=["i", "l", "code", "error"])

    schema = T.StructType([T.StructField("i", df.schema[id_col].dataType), T.StructField("l", df.schema[label_col].dataType),
                           T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    rows = df.select(F.col(id_col).alias("i"), F.col(label_col).alias("l"), F.col(vec_col).alias("v"))
    if not dims:
        rows = rows.limit(0)
    return rows.mapInArrow(run, schema).withColumn("codebooks", F.lit(name))


def code_report(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code in hexadecimal, error, label_error (errors summed over equal labels, nulls together) and codebooks_sha256.

    The coded rows are written once, so that the sums per label are a table of known size when they are joined.
    A sum beyond a long is null.
    """
    rows = C.written(coded(df, id_col, vec_col, label_col, parts, entries, rounds), "codes")
    label = F.struct(F.coalesce(F.col("l").cast("string"), F.lit("")).alias("s"), F.col("l").isNull().alias("none"))
    sums = C.written(rows.groupBy(label.alias("k")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("t"))
                     .select("k", F.expr("try_cast(t AS bigint)").alias("label_error")), "label-errors")
    return rows.withColumn("k", label).join(sums, "k").select(
        F.col("i").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.col("codebooks").alias("codebooks_sha256"))
