"""Toxicity by a classifier chain.

The chain predicts its categories in order, here ``low_quality`` (quality = 0) and then ``toxic``: each is a logistic
model over hashed words, and the later model also sees the probabilities of the earlier categories. Those inputs are
out-of-fold predictions in training (each part of the labelled documents is scored by a model of the other parts), so the
later model learns from probabilities as they look on unseen documents. The decision threshold of each category is taken
from its own out-of-fold predictions.

Training uses at most about ``MAX_LABELLED`` labelled documents (a documented bound, chosen by a hash of the id, so
reruns agree): their hashed words, at most that many whole texts, are the only document data the driver sees, and the models, ``DIMS``
numbers per category, are all that is sent to executors. Scoring reads each text once, whole, without a shuffle.

Defined cases: a null or empty text has no words and gets the probability of the intercepts; equal rows get equal results;
labels that are null or belong to no document are ignored, several labels of one document count as the largest; with no
labels, or one class only, the category's model is constant and predicts its share (0 if there are no labels); an empty
table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

DIMS = 1 << 20
STEMS = (4, 5)
MAX_LABELLED = 8_000
FOLDS = 3
MIN_DOCS = 3
STEPS = 60
L2 = 2.0
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))


def hashed_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, text) pairs, by text: lower-cased words and their first ``STEMS`` bytes, which inflected forms
    share."""
    low = C.LOWER[buf]
    starts, ends, bounds = C.word_ranges(low, offsets, C.ALNUM_WORDS)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    long = [np.flatnonzero(ends - starts >= n) for n in STEMS]
    hashes = C.range_hashes(low, np.concatenate([starts, *(starts[i] for i in long)]),
                            np.concatenate([ends, *(starts[i] + n for i, n in zip(long, STEMS))]))
    kind = np.repeat(np.arange(len(STEMS) + 1), [len(starts), *map(len, long)]).astype(np.uint64)
    feature = (C.mix(hashes + kind) % C.U64(DIMS)).astype(np.int64)
    both = np.sort(np.concatenate([text_of, *(text_of[i] for i in long)]) * DIMS + feature)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both % DIMS, both // DIMS


@dataclass
class Model:
    """Logistic model over hashed words and the probabilities of the earlier categories."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, feature, text_of, before: np.ndarray) -> np.ndarray:
        n = len(before)
        z = np.bincount(text_of, weights=self.weights[feature], minlength=n) + self.bias
        if len(self.earlier):
            z = z + before @ self.earlier
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(feature, text_of, before: np.ndarray, y: np.ndarray, dims: int, steps: int = STEPS,
        l2: float = L2) -> Model:
    """Penalised maximum likelihood by accelerated gradient steps, scaled per feature by its number of documents."""
    n, k = before.shape
    share = float(y.mean()) if n else 0.0
    start = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    w, e, b = np.zeros(dims), np.zeros(k), start
    if share in (0.0, 1.0):
        return Model(w, e, start if n else -30.0)
    df = np.bincount(feature, minlength=dims).astype(float)
    step = 1.0 / (0.25 * df * np.sqrt(np.maximum(1.0, np.bincount(text_of, minlength=n).mean())) + l2)
    pw, pe, pb, t = w, e, b, 1.0
    for _ in range(steps):
        p = Model(w, e, b).predict(feature, text_of, before)
        g = p - y
        nw = w - step * (np.bincount(feature, weights=g[text_of], minlength=dims) + l2 * w)
        ne = e - (before.T @ g + l2 * e) / (0.25 * n + l2) if k else e
        nb = b - g.sum() / (0.25 * n + l2)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / nt
        w, e, b = nw + m * (nw - pw), ne + m * (ne - pe), nb + m * (nb - pb)
        pw, pe, pb, t = nw, ne, nb, nt
    return Model(pw, pe, pb)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability above which the F1 score of these predictions is highest."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1.0, y.sum()))
    last = np.append(p[order][1:] != p[order][:-1], True)
    at = int(np.argmax(np.where(last, f1, -1.0)))
    low = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + low) / 2)


def train_chain(feature, text_of, labels: np.ndarray, folds: int = FOLDS) -> list[tuple[Model, float]]:
    """(model, threshold) per category, in chain order, from rows of 0/1 labels."""
    n = len(labels)
    known = np.flatnonzero(np.bincount(feature, minlength=DIMS) >= MIN_DOCS)  # rarer features get no weight
    keep = np.isin(feature, known)
    feature, text_of, dims = np.searchsorted(known, feature[keep]), text_of[keep], len(known)
    fold = np.arange(n) % folds
    before, chain = np.zeros((n, 0)), []
    for c in range(labels.shape[1]):
        y, out = labels[:, c].astype(float), np.zeros(n)
        for f in range(folds):
            rest, held = fold != f, fold == f
            m = fit(*_rows(feature, text_of, rest), before[rest], y[rest], dims)
            out[held] = m.predict(*_rows(feature, text_of, held), before[held])
        model = fit(feature, text_of, before, y, dims)
        wide = np.zeros(DIMS, np.float32)
        wide[known] = model.weights
        chain.append((Model(wide, model.earlier, model.bias), best_threshold(out, y) if 0 < y.sum() < n else 0.5))
        before = np.column_stack([before, out])
    return chain


def _rows(feature, text_of, pick: np.ndarray):
    new = np.cumsum(pick) - 1
    keep = pick[text_of]
    return feature[keep], new[text_of[keep]]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories=CATEGORIES,
                  max_labelled: int = MAX_LABELLED):
    """(feature, text_of, labels) of the sampled labelled documents, ordered by a hash of their ids."""
    got = labels.groupBy(F.col(id_col).alias("i")).agg(*[F.max(F.expr(e)).alias(c) for c, e in categories])
    got = got.where(" AND ".join(f"{c} IS NOT NULL" for c, _ in categories) + " AND i IS NOT NULL")
    every = max(1, -(-got.count() // max_labelled))
    got = got.where(F.pmod(F.xxhash64("i"), F.lit(every)) == 0)

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, "t"):
                feature, text_of = hashed_words(*C.column_bytes(part.column(1)))
                at = np.searchsorted(text_of, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], lists],
                                                 names=["h", *[c for c, _ in categories], "f"])

    pick = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(got, "i")
    rows = (pick.select(F.xxhash64("i", "t").alias("h"), "t", *[F.col(c).cast("int") for c, _ in categories])
            .mapInArrow(run, "h long, " + ", ".join(f"{c} int" for c, _ in categories) + ", f array<int>").toArrow())
    rows = rows.sort_by("h").combine_chunks()
    lists = rows.column("f").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    feature = np.asarray(lists.flatten()).astype(np.int64)
    sizes = np.asarray(lists.value_lengths()).astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)
    y = np.column_stack([np.asarray(rows.column(c)).astype(np.int64) for c, _ in categories])
    return feature, np.repeat(np.arange(len(sizes)), sizes), y.reshape(-1, len(categories))


def with_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  categories=CATEGORIES, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with p_<category> and <category> (boolean) for every category of the chain."""
    feature, text_of, y = training_rows(docs, labels, id_col, text_col, categories, max_labelled)
    sent = docs.sparkSession.sparkContext.broadcast(
        [(m.weights, m.earlier, m.bias, limit) for m, limit in train_chain(feature, text_of, y)])
    names = [c for c, _ in categories]
    made = [*(f"p_{c}" for c in names), *names]
    base = docs.select(*[c for c in docs.columns if c not in made])
    schema = base.withColumns({**{f"p_{c}": F.lit(0.0) for c in names}, **{c: F.lit(True) for c in names}}).schema

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, text_col):
                words = hashed_words(*C.column_bytes(part.column(part.schema.get_field_index(text_col))))
                before = np.zeros((part.num_rows, 0))
                for *model, _ in sent.value:
                    before = np.column_stack([before, Model(*model).predict(*words, before)])
                said = [pa.array(before[:, i] > m[-1]) for i, m in enumerate(sent.value)]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, before.T.copy()), *said],
                                                 names=[*part.schema.names, *made])

    return base.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, p_low_quality, p_toxic, low_quality, toxic of every document."""
    return with_toxicity(docs.select(id_col, text_col), labels, id_col, text_col).drop(text_col)
