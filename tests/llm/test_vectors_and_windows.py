"""Vector codes, whitening and substring dedup against brute force, on real rows and on hard ones."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from deserta.llm import common, dedup_substring, ngram_join, vector_codes, whitening
from test_text_operators import documents, expected, frame, result, words

NAN, INF = float("nan"), float("inf")
VECTORS = [
    (9001, None, 1), (9002, [], 1), (9003, [None] * 64, 2), (9004, [NAN] + [0.0] * 63, 2), (9005, [INF] + [0.0] * 63, None),
    (9006, [0.25, -0.5] * 32, None), (9007, [0.25, -0.5] * 32, 3), (9007, [0.25, -0.5] * 32, 3), (9008, [1.0, 2.0], 3),
    (9009, [-0.001] * 64, None), (None, [0.3] * 64, 1), (None, [0.3] * 64, None), (9010, [100.0] + [-100.0] * 63, 4),
]


@pytest.fixture(scope="module")
def vectors(spark):
    """The small table's vectors and the hard ones, with columns named like inner and output ones."""
    real = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>"), "label")
    hard = frame(spark, VECTORS, "vec_id long, embedding array<double>, label int")
    d = real.unionByName(hard)
    for c in ("i", "v", "x", "l", "code", "error", "n", "component", "block", "_1"):
        d = d.withColumn(c, F.lit("clash"))
    return d.repartition(3), [tuple(r) for r in d.select("vec_id", "embedding", "label").collect()]


def finite(rows, dims=64):
    return [(i, v, l) for i, v, l in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]


def nearest(x, book):
    return min((sum((a - c) ** 2 for a, c in zip(x, e)), j) for j, e in enumerate(book))


def codes_by_hand(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * c) for c in v], l) for i, v, l in finite(rows)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    w = len(kept[0][1]) // parts
    piece = [[x[p * w:(p + 1) * w] for _, x, _ in kept] for p in range(parts)]
    books = [p[:entries] for p in piece]
    for _ in range(rounds):
        for xs, book in zip(piece, books):
            near = [nearest(x, book)[1] for x in xs]
            for j in set(near):
                mine = [x for x, n in zip(xs, near) if n == j]
                book[j] = [sum(c) // len(mine) for c in zip(*mine)]
    name = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for r, (i, _, l) in enumerate(kept):
        found = [nearest(piece[p][r], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[l] = by_label.get(l, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, l))
    return [(i, code, error, by_label[l], name) for i, code, error, l in out]


@pytest.mark.parametrize("parts, entries, rounds", [(16, 64, 2), (4, 7, 1), (64, 200, 2)])
def test_vector_codes(vectors, parts, entries, rounds):
    got = vector_codes.code_report(vectors[0], parts=parts, entries=entries, rounds=rounds)
    assert result(got) == expected(codes_by_hand(vectors[1], parts, entries, rounds))


@pytest.mark.parametrize("top", [3, 1 << 20])
def test_trie_finds_the_nearest_entry_of_every_piece(monkeypatch, top):
    monkeypatch.setattr(vector_codes, "RUN", 5)
    rng = np.random.default_rng(top)
    pieces, book = rng.integers(-top, top, (300, 4)), rng.integers(-top, top, (9, 4))
    trie = vector_codes.Trie(pieces)
    entry, distance = trie.nearest(book)
    want = [nearest(x.tolist(), book.tolist()) for x in pieces]
    assert [(int(distance[j]), int(entry[j])) for j in trie.leaf_of] == want
    assert len(trie.first[0]) == len(np.unique(pieces[:, 0])) and len(trie.leaves) == len(np.unique(pieces, axis=0))


def test_vector_codes_bound_far_components(spark):
    d = frame(spark, [(1, [1e30, -1e30], 1), (2, [0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["error"] for r in vector_codes.code_report(d, parts=2, entries=1, rounds=0).collect()}
    assert got == {1: 0, 2: 2 * vector_codes.LIMIT ** 2}


def whitened_by_hand(rows, most=16):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in finite(rows)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    scaled = {x: [n * c - s for c, s in zip(x, sums)] for x in fit}
    centred = np.array([[c / n for c in scaled[x]] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return [(i, n, sum(c * c for c in scaled[tuple(x)]), np.array(scaled[tuple(x)]) / n @ u / np.sqrt(e), e / np.trace(v))
            for i, x in kept]


@pytest.mark.parametrize("values", [whitening.BLOCK_VALUES, 64 * 7])
def test_whitening(vectors, monkeypatch, values):
    monkeypatch.setattr(whitening, "BLOCK_VALUES", values)  # blocks of 7 rows: many blocks, most partly filled
    got = {}
    for r in whitening.whitened(vectors[0]).collect():
        assert r["identity_error"] < 1e-9
        got.setdefault((r["vec_id"], r["n"], r["deviation"]), []).append((r["component"], r["whitened"], r["explained"]))
    want, sign = {}, None
    for i, n, far, w, explained in whitened_by_hand(vectors[1]):
        want.setdefault((i, n, far), []).append((w, explained))
    assert got.keys() == want.keys()
    for key, rows in sorted(got.items(), key=str):
        assert len(rows) == 16 * len(want[key])
        mine = np.array([x[1:] for x in sorted(rows)]).reshape(16, -1, 2)
        w, explained = want[key][0]
        sign = np.sign(w * mine[:, 0, 0]) if sign is None else sign
        assert np.allclose(mine[:, :, 0], (sign * w)[:, None], atol=1e-8) and np.allclose(mine[:, :, 1], explained[:, None], rtol=1e-8)


def test_whitening_of_few_or_equal_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)).count() == 0
    line = whitening.whitened(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], schema)).collect()
    assert {r["component"] for r in line} == {1} and abs(sum(r["whitened"] ** 2 for r in line) / 5 - 1) < 1e-12
    assert all(abs(r["explained"] - 1) < 1e-12 for r in line)
    far = whitening.whitened(frame(spark, [(1, [1e300]), (2, [-1e300])], schema)).collect()
    assert [abs(r["whitened"]) for r in far] == [1.0, 1.0]


def test_deviation_is_exact_beyond_a_long():
    x = np.array([[1 << 30, 0], [-(1 << 30), 1]], np.int64)
    n, total = 1 << 20, [5, 7]
    assert whitening.deviations(x, n, total).tolist() == [sum((n * int(c) - s) ** 2 for c, s in zip(r, total)) for r in x]


def substrings_by_hand(rows, k):
    big, first = 1 << 63, {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in sorted(split, key=lambda r: big if r[0] is None else r[0]):
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j:j + k]), big if i is None else i)
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j:j + k])] < (big if i is None else i):
                gone[j:j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        yield i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    d = documents(spark)
    return d, [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]


@pytest.mark.parametrize("window, block, segment", [(13, 8 << 20, 5 << 20), (13, 1 << 14, 1 << 13), (1, 1 << 16, 1 << 16), (3, 1, 1 << 16)])
def test_substring_dedup(docs, monkeypatch, window, block, segment):
    monkeypatch.setattr(dedup_substring, "BLOCK_BYTES", block)  # many blocks and segments, down to a text to a block
    monkeypatch.setattr(dedup_substring, "SEGMENT_BYTES", segment)
    d = docs[0] if block > 1 else docs[0].where("doc_id < 130 OR doc_id IS NULL")
    rows = docs[1] if block > 1 else [r for r in docs[1] if r[0] is None or r[0] < 130]
    assert result(dedup_substring.dedup_report(d, window=window)) == expected(substrings_by_hand(rows, window))


def test_a_full_sketch_loses_no_window(docs, monkeypatch):
    monkeypatch.setattr(dedup_substring, "WIDTH_BITS", 4)  # every counter overflows; all windows go on to the grouping
    assert result(dedup_substring.dedup_report(docs[0])) == expected(substrings_by_hand(docs[1], 13))


def test_sketch_estimates_at_least_the_count_and_drops_most_single_windows(spark):
    rng = np.random.default_rng(3)
    single = [" ".join(map(str, rng.integers(0, 1 << 40, 2000))) for _ in range(30)]
    d = frame(spark, list(enumerate(single + single[:2])))
    block = dedup_substring.B.write_blocks(d.coalesce(1), "doc_id", "text", "words").first().asDict()
    segments = 3
    messages = list(dedup_substring.sketch_messages(block, 13, segments))
    flags = [f for s in range(segments) for f in dedup_substring.merged(dedup_substring.as_table(
        [m for m in messages if m["segment"] == s], dedup_substring.SKETCH)).to_pylist()]
    w = dedup_substring.Windows(block, 13)
    found = dedup_substring.estimated_repeated(w, segments, flags)
    twice = set(np.flatnonzero(np.isin(w.text, [0, 1, 30, 31])).tolist())
    assert twice <= set(found.tolist()) and len(found) - len(twice) < 0.05 * len(w.at)


def test_kept_texts_are_those_of_the_digests(docs):
    digests = {(r["doc_id"], r["kept_sha256"]) for r in dedup_substring.dedup_report(docs[0]).collect()}
    kept = dedup_substring.deduplicated(docs[0]).collect()
    assert {(r["doc_id"], hashlib.sha256(r["kept"]).hexdigest()) for r in kept} == digests


def test_empty_tables(spark, vectors, docs):
    assert vector_codes.code_report(vectors[0].limit(0)).count() == 0
    assert whitening.whitened(vectors[0].limit(0)).count() == 0
    assert dedup_substring.dedup_report(docs[0].limit(0)).count() == 0


def test_sequence_hashes_are_equal_for_equal_sequences_only():
    values = np.random.default_rng(0).integers(0, 4, 500).astype(np.uint64)
    for k in (1, 2, 3, 7, 13):
        hashes = common.sequence_hashes(values, k, 0x100000001B3).tolist()
        pairs = set(zip(hashes, (tuple(values[i:i + k].tolist()) for i in range(len(values) - k + 1))))
        assert len({h for h, _ in pairs}) == len({s for _, s in pairs}) == len(pairs)


def test_range_hashes_do_not_depend_on_slices(monkeypatch):
    buf = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    starts = np.sort(np.random.default_rng(2).integers(0, 4000, 300))
    ends = starts + np.random.default_rng(3).integers(0, 900, 300)
    whole = common.range_hashes(buf, starts, ends)
    monkeypatch.setattr(common, "SLICE", 100)
    monkeypatch.setattr(common, "_powers", [])
    assert (common.range_hashes(buf, starts, ends) == whole).all()
    mixed = np.random.default_rng(4).permutation(300)
    assert (common.range_hashes(buf, starts[mixed], ends[mixed]) == whole[mixed]).all()
    assert len({(int(h), buf[a:z].tobytes()) for h, a, z in zip(whole, starts, ends)}) == len(set(whole.tolist()))


def test_near_duplicates_go_by_row(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "b"), (2, text + " more", "c"), (None, text, "d"), (3, "quite another text of some words", "e"),
            (2, "a clean text that shares its id only", "f"), (4, None, "g"), (4, "", "h"), (None, "a lone text without an id", "i")]
    d = frame(spark, rows, "doc_id long, text string, label string")
    for df in (d, d.union(d)):
        kept = ngram_join.near_duplicates_dropped(df)
        times = 1 if df is d else 2
        got = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
        want = [("1", text), ("2", rows[5][1]), ("3", rows[4][1]), ("None", rows[8][1])] + [("4", "")] * 2 * times
        assert got == sorted(want) and kept.columns == d.columns


def test_every_pair_is_judged_once(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        w = [f"{i % 3}w{j}" for j in range(80)]
        for j in rng.choice(80, rng.integers(0, 9), replace=False):
            w[j] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(w)))
    seen, real = [], ngram_join.verified

    def counted(pairs, cand, percent):
        pairs = common.written(pairs, "asked")
        seen.extend(tuple(sorted(r)) for r in pairs.collect())
        return real(pairs, cand, percent)

    monkeypatch.setattr(ngram_join, "verified", counted)
    ngram_join.component_report(frame(spark, rows)).collect()
    assert seen and len(seen) == len(set(seen))
