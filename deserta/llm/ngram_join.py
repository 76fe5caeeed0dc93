"""Exact n-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Every document is the set of its word n-grams. Sets are ordered by how many documents hold an n-gram, rarest first, so
that two sets of enough similarity share one of their first n - ceil(t n) + 1 elements, and most documents share none of
theirs with any other. The steps:

1. Equal sets become one class (by a 64-bit hash of the set). Only one document of a class takes part.
2. The n-grams' document counts are exchanged between blocks of texts (``blocks.shared_keys``).
3. Documents whose prefix holds a shared n-gram emit their prefix as postings; all others have no partner.
4. Candidates from the postings pass the length and the positional filter; their sets are then bounded by a suffix
   filter and, if that allows, intersected. The posting lists of a large group of near copies are long, so the first
   ``ROUNDS`` rounds only join each document with a few pivots of its lists; a list whose documents already are in one
   component is done. What is left, documents of different components in one list, is first measured against the
   list's pivot, which bounds what two of them can have in common, and then joined exhaustively where that bound
   allows a link, so that no link between components is lost. A judged pair is kept and never judged again.
5. Components of the links.

Scale: no step gathers a list or a component in one task; posting lists meet in equi-joins, which adaptive execution
splits when skewed. Nothing but counts reaches the driver.

N-grams are 48-bit hashes of words' 64-bit hashes. Defined cases: a null or empty text, or one without words, has the
empty set and stands alone; a document of fewer words than n has one n-gram, all of its words; repeated rows and equal
sets share a component; rows of equal id are rows of their own, whose component is the smallest id reached; a null id is
larger than any other and a component of null ids only is null; an empty table gives an empty result; input columns named
like an output column are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks as B, common as C
from .components import components

ROUNDS = 2
#: Pivots that a document meets in a round; in the first round it is one, that of its shortest list.
TRIES = 4
PROBES = 8
KEY_MASK = C.U64((1 << B.KEY_BITS) - 1)
BYTES_PER_BUCKET = 16 << 20


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram keys of all texts, one text after the other, and the offsets of the texts' sets."""
    low = C.LOWER[buf]
    starts, ends, bounds = C.word_ranges(low, offsets, C.BLANK_WORDS)
    words = C.range_hashes(low, starts, ends)
    counts = np.diff(bounds)
    text_of = np.repeat(np.arange(len(counts)), counts)
    h, at = C.window_hashes(words, bounds, k)
    keys, texts = [h], [text_of[at]]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            x = words[bounds[short]]
            for j in range(1, n):
                x = C.mix(x + C.U64(j)) + words[bounds[short] + j] * C.U64(0x9FB21C651E98DF25)
            keys.append(C.mix(x + C.U64(n)))
            texts.append(short)
    text, key = np.concatenate(texts).astype(np.uint64), np.concatenate(keys) & KEY_MASK
    both = np.sort((text << C.U64(B.KEY_BITS)) | key)  # a block has at most MAX_TEXTS texts
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both & KEY_MASK, np.searchsorted(both >> C.U64(B.KEY_BITS), np.arange(len(counts) + 1, dtype=np.uint64))


def set_hashes(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of each set; 0 for the empty one."""
    total = np.concatenate(([C.U64(0)], np.cumsum(C.mix(keys + C.U64(0x51ED270B)), dtype=np.uint64)))
    n = np.diff(at).astype(np.uint64)
    return np.where(n > 0, C.mix(total[at[1:]] - total[at[:-1]] + n * C.U64(0xC2B2AE3D27D4EB4F)) | C.U64(1), C.U64(0))


def first_of_each(hashes: np.ndarray) -> np.ndarray:
    """Positions of the first text of each distinct non-empty set."""
    _, first = np.unique(hashes, return_index=True)
    return np.sort(first[hashes[first] != 0])


def prefix_length(n, percent: int):
    return n - -(-(percent * n) // 100) + 1


def least_overlap(n, m, percent: int):
    """Smallest intersection of sets of n and m elements with the similarity: ceil(t / (1 + t) (n + m))."""
    return -(-(percent * (n + m)) // (100 + percent))


def set_rows(blocks: DataFrame, k: int, digests: bool = False) -> DataFrame:
    """(id, n, node, block, pos, digest) of every row; node is the hash of its set, digest the MD5 of its text if asked for."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                buf, offsets, ids = B.unpack(row)
                keys, at = shingles(buf, offsets, k)
                yield pa.RecordBatch.from_pydict({
                    "id": B.ids_column(ids), "n": np.diff(at).astype(np.int64), "node": set_hashes(keys, at).view(np.int64),
                    "block": np.full(len(ids), row["block"]), "pos": np.arange(len(ids)),
                    "digest": pa.array([hashlib.md5(buf[a:z]).hexdigest() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                                       if digests else [None] * len(ids), pa.string())})

    return blocks.mapInArrow(run, "id long, n long, node long, block long, pos long, digest string")


def candidates(blocks: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, n, own, prefix, keys) of one document per class whose prefix holds a shared n-gram.

    own: its n-grams that no other document has; they come first. prefix: its other prefix n-grams, rarest first. keys:
    all its n-grams that others have, sorted.
    """
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = C.buckets_for(spark, total, BYTES_PER_BUCKET)

    def keys_of(buf, offsets, ids):
        keys, at = shingles(buf, offsets, k)
        pick = np.zeros(len(ids), bool)
        pick[first_of_each(set_hashes(keys, at))] = True
        return np.unique(keys[np.repeat(pick, np.diff(at))], return_counts=True)

    taken = (rows.where("n > 0").groupBy("node").agg(F.min(F.struct("block", "pos")).alias("at"))
             .groupBy("at.block").agg(F.collect_list("at.pos").alias("take")))  # at most MAX_TEXTS to a block
    replies = B.shared_keys(blocks, keys_of, buckets).withColumn("take", F.lit(None).cast("array<long>"))
    replies = replies.unionByName(taken, allowMissingColumns=True)

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"node": [], "n": [], "own": [], "prefix": [], "keys": []}
        take = sorted(p for x in right.column("take").to_pylist() if x for p in x)
        for row in left.to_pylist():
            keys, at = shingles(*B.unpack(row)[:2], k)
            nodes = set_hashes(keys, at).view(np.int64)
            known, n_docs = B.reply(right)
            if len(known):
                where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                docs = np.where(known[where] == keys, n_docs[where], 1).astype(np.uint64)
            else:
                docs = np.ones(len(keys), np.uint64)
            for p in take:
                mine, each = keys[at[p]:at[p + 1]], docs[at[p]:at[p + 1]]
                others = each > 1
                n, own = len(mine), len(mine) - int(np.count_nonzero(others))
                first = prefix_length(n, percent) - own
                if first > 0 and own < n:
                    ranked = np.sort((each[others] << C.U64(B.KEY_BITS)) | mine[others])[:first]
                    for c, x in zip(out, (int(nodes[p]), n, own, ranked.tobytes(), B.pack_keys(mine[others]))):
                        out[c].append(x)
        return pa.table({c: pa.array(v, pa.binary() if c in ("prefix", "keys") else pa.int64()) for c, v in out.items()})

    found = blocks.select("block", "ids", "lens", "text").groupBy("block").cogroup(replies.groupBy("block"))
    return found.applyInArrow(pick, "node long, n long, own long, prefix binary, keys binary")


def postings(cand: DataFrame) -> DataFrame:
    """(key, node, n, own, pos): every prefix n-gram that others have, with its position in the document's order."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                key = np.frombuffer(row["prefix"], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "key": key, "node": np.full(len(key), row["node"]), "n": np.full(len(key), row["n"]),
                    "own": np.full(len(key), row["own"]), "pos": row["own"] + np.arange(len(key))})

    return cand.select("node", "n", "own", "prefix").mapInArrow(run, "key long, node long, n long, own long, pos long")


def may_link(n: str, pos: str, m: str, pos2: str, percent: int) -> str:
    """Length and positional filter: what stands after the common n-gram must be able to fill the overlap."""
    return (f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) AND "
            f"least({n} - {pos}, {m} - {pos2}) >= ({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}")


def compared(pairs: DataFrame, cand: DataFrame, judge, schema: str) -> DataFrame:
    """Columns that ``judge(x, y, n, m)`` gives for the sets of each pair (a, b), with the pair."""
    left = cand.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("keys").alias("x"))
    right = cand.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("keys").alias("y"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                a, b, n, m, x, y = (part.column(part.schema.get_field_index(c)).to_pylist() for c in "abnmxy")
                out = []
                for row in zip(a, b, n, m, x, y):
                    said = judge(B.unpack_keys(row[4]), B.unpack_keys(row[5]), row[2], row[3])
                    out.append((row[0], row[1], *said))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, schema)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def judged(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> tuple[int, int, int, int]:
    """(linked, common, further n-grams that x and that y share with others) of two sets; all three numbers at least what they say.

    Suffix filter: both sets are cut at elements of y; no more than the smaller piece of each cut can be common. Where
    that bound forbids a link the sets are not intersected, and the bound stands for the intersection.
    """
    need = least_overlap(n, m, percent)
    bound = min(len(x), len(y))
    if bound >= need:
        cuts = y[np.linspace(0, len(y), PROBES + 1).astype(int)[1:-1]]
        px = np.concatenate(([0], np.searchsorted(x, cuts), [len(x)]))
        py = np.concatenate(([0], np.searchsorted(y, cuts), [len(y)]))
        bound = int(np.minimum(np.diff(px), np.diff(py)).sum())
    if bound < need:
        return 0, bound, len(x), len(y)
    common = overlap(x, y)
    return int(common >= need), common, len(x) - common, len(y) - common


def verified(pairs: DataFrame, cand: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, common, rest_a, rest_b) of the pairs of classes."""
    return compared(pairs, cand, lambda x, y, n, m: judged(x, y, n, m, percent),
                    "a long, b long, linked long, common long, rest_a long, rest_b long")


def unjudged(pairs: DataFrame, held: DataFrame | None) -> DataFrame:
    """Each pair once, larger class first, without those that an earlier round has judged."""
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return pairs if held is None else pairs.join(held.select("a", "b"), ["a", "b"], "left_anti")


def class_links(cand: DataFrame, percent: int, rounds: int = ROUNDS) -> DataFrame | None:
    """Links (a, b) that connect all linked classes; pairs already connected by others may be left out.

    Every pair is judged at most once: what a round finds is kept, linked or not, and later rounds leave the pair out.
    """
    post = C.written(postings(cand), "postings")
    post = C.written(post.join(post.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "key"), "postings")
    held, labels = None, None
    for r in range(rounds + 2):
        lab = post.withColumn("label", F.col("node")) if labels is None else post.join(labels, "node", "left").withColumn(
            "label", F.coalesce("label", "node"))
        # Pivots are in turn any document and the one with the fewest n-grams of its own, the nearest to what a group of
        # copies was copied from. The last two passes take the latter, whose intersections the first of them measures.
        by = F.xxhash64("node", "key", F.lit(r)) if r < rounds and r % 2 == 0 else F.struct("own", F.xxhash64("node"))
        pivot = F.min_by(F.struct("node", "n", "pos", "label"), by)
        mixed = (lab.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), pivot.alias("p"),
                                        F.count("*").alias("c")).where("lo <> hi").select("key", "p", "c"))
        lists = C.written(lab.join(mixed, "key"), "lists")
        post = lists.select("key", "node", "n", "own", "pos")
        if lists.isEmpty():
            break
        if r < rounds:
            tried = lists.where("label <> p.label AND " + may_link("n", "pos", "p.n", "p.pos", percent))
            rank = F.xxhash64("key", "node", F.lit(r)) if r else F.col("c")  # first the shortest list, then any
            pivots = F.array_sort(F.collect_set(F.struct(rank, "p.node")))  # no more than a prefix has n-grams
            pairs = (tried.groupBy(F.col("node").alias("a")).agg(F.slice(pivots, 1, TRIES if r else 1).alias("few"))
                     .select("a", F.explode("few.node").alias("b")))
        elif r == rounds:
            pairs = lists.where("node <> p.node").select(F.col("node").alias("a"), F.col("p.node").alias("b"))
        else:
            pairs = remaining_pairs(lists, held, percent)
        new = C.written(verified(unjudged(pairs, held), cand, percent), "judged")
        held = new if held is None else held.unionByName(new)
        if r <= rounds:
            labels = components(held.where("linked = 1").select("a", "b"))
    return None if held is None else held.where("linked = 1").select("a", "b")


def remaining_pairs(lists: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in one list that the filters and the pivot's measurements leave possible.

    With x, y and the pivot p: what x and y have in common lies in p, at most the smaller of their intersections with p,
    or outside, at most the smaller number of n-grams that they share with anyone but not with p.
    """
    known = held.selectExpr("a AS node", "b AS pivot", "common", "rest_a AS rest").unionByName(
        held.selectExpr("b AS node", "a AS pivot", "common", "rest_b AS rest"))
    side = (lists.withColumn("pivot", F.col("p.node")).join(known, ["node", "pivot"], "left")
            .select("key", "node", "n", "pos", "label", F.col("p.label").alias("of_pivot"),
                    F.coalesce("common", "n").alias("common"), F.coalesce("rest", F.lit(0)).alias("rest")))
    side = C.written(side, "lists")
    x, y = side.where("label <> of_pivot").alias("x"), side.alias("y")
    fits = (f"{100 + percent} * (least(x.common, y.common) + least(x.rest, y.rest)) >= {percent} * (x.n + y.n) AND "
            + may_link("x.n", "x.pos", "y.n", "y.pos", percent))
    return (x.join(y, F.col("x.key") == F.col("y.key")).where("x.label <> y.label AND " + fits)
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))


def classes_of(df: DataFrame, id_col: str, text_col: str, k: int, percent: int, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): ``set_rows`` of every document, and (node, label) of every class of equal non-empty sets."""
    blocks = B.write_blocks(df, id_col, text_col, "shingles")
    rows = C.written(set_rows(blocks, k, digests), "sets")
    cand = C.written(candidates(blocks, rows, k, percent), "candidates")
    found = class_links(cand, percent)
    classes = rows.where("n > 0").select("node").distinct()
    if found is None:
        return rows, classes.withColumn("label", F.col("node"))
    return rows, classes.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))


def component_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                     percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links of at least ``percent``) of every document."""
    rows, labels = classes_of(df, id_col, text_col, k, percent)
    low = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("low")).join(labels, "node")
    low = low.select("node", "label").join(low.groupBy("label").agg(F.min("low").alias("low")), "label")
    return rows.join(low.select("node", "low"), "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))


def near_duplicates_dropped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                            percent: int = 80) -> DataFrame:
    """The rows of ``df``, with their columns, one of each component: that of the smallest id (null is the largest).

    Rows are told apart by id and text: a copy goes whatever its id, and a clean row stays whatever rows share its id. Of
    the rows of equal id and text one stays; of different texts of the smallest id the one of the smallest MD5. Rows
    without words are in no component, and all stay.
    """
    rows, labels = classes_of(df.select(id_col, text_col), id_col, text_col, k, percent, digests=True)
    each = (rows.where("n > 0").groupBy("node", "id", "digest").agg(F.count("*").alias("copies")).join(labels, "node")
            .select("label", "id", "digest", "copies", F.struct(F.col("id").isNull(), "id", "digest").alias("rank")))
    least = each.groupBy("label").agg(F.min("rank").alias("least"))
    told = C.written(each.join(least, "label").where("rank <> least OR copies > 1").select(
        "id", "digest", (F.col("rank") == F.col("least")).alias("stays")), "copies")
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    keyed = df.withColumn("__md5", key).withColumn("__id", F.col(id_col).cast("long"))
    gone = told.select(F.col("id").alias("__id2"), F.col("digest").alias("__md5_2"), F.col("stays").alias("__stays"))

    def met(side: DataFrame) -> list:
        return [keyed["__id"].eqNullSafe(side["__id2"]), keyed["__md5"] == side["__md5_2"]]

    out = keyed.join(gone, met(gone), "left_anti")
    again = gone.where("__stays")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, met(again), "left_semi").dropDuplicates(["__id", "__md5"]))
    return out.drop("__md5", "__id")
