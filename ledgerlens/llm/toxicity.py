"""Toxicity by a classifier chain of linear models.

The categories are the label columns in a given order; here quality, then toxic. A text's features are its distinct
words and their beginnings, hashed. The first category has a logistic model on these; every later
one also gets the earlier categories' probabilities. For training these are out-of-fold
predictions, so a later model sees earlier ones as they behave on unseen texts; for scoring
they come from the earlier models fitted on all folds.

The fit looks at no more than ``SAMPLE`` labelled documents per value of the last category, those with
the smallest hashes of their ids; the intercepts are corrected for how much each value was
thinned out. That is the only bound: every document is scored, from its whole text. The fit is one
small task; its result, at most ``SLOTS`` weights a category, is broadcast.

A null or empty text has no features; its probabilities come from the intercepts. Label rows
with a null are left out; of several label rows of one document the largest values hold. A
document may be repeated: it is scored each time, and counts once in the fit. Without labels of both values of the last category
nothing is known: all probabilities are null and no document is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.batches import arrow_udf
from ledgerlens.llm.decontam import TO_WORDS
from ledgerlens.llm.minhash import mixed, pieces, span_hashes, words_between

CATEGORIES = ("quality", "toxic")
#: Labelled documents of each value of the last category that the fit looks at.
SAMPLE = 3_000
FOLDS = 3
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Lengths in bytes of the beginnings of words.
BEGINNINGS = (4, 5)
#: A feature in fewer of the sample's documents has no weight.
LEAST_DOCUMENTS = 3
#: A feature counts only if it differs between the values by so many standard errors.
LEAST_Z = 3.0
STEPS, RIDGE = 300, 0.1
THRESHOLD = 0.4

IS_GAP = np.frombuffer(TO_WORDS, np.uint8) == 32


def features(text: str) -> np.ndarray:
    """Slots of the distinct words, without case, and of their beginnings."""
    data = np.frombuffer(text.encode(), np.uint8)
    gap, out = IS_GAP[data], [np.empty(0, np.uint64)]
    for a, b in pieces(gap):
        starts, stops = words_between(gap[a:b])
        for k in (0, *BEGINNINGS):
            long = stops - starts >= k
            ends = starts[long] + k if k else stops
            out.append(mixed(span_hashes(data[a:b], starts[long], ends) + np.uint64(k)))
    return np.unique(np.concatenate(out) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


class Rows:
    """Sparse 0/1 rows: the slots of all features, and the row of each."""

    def __init__(self, flat: np.ndarray, row: np.ndarray, n: int, n_slots: int):
        self.flat, self.row, self.n, self.n_slots = flat, row, n, n_slots

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.flat], self.n)

    def gradient(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, per_row[self.row], self.n_slots)

    def of(self, rows: np.ndarray) -> Rows:
        """The rows marked, numbered anew."""
        on, number = rows[self.row], (np.cumsum(rows) - 1).astype(np.int32)
        return Rows(self.flat[on], number[self.row[on]], int(rows.sum()), self.n_slots)

    def only(self, slots: np.ndarray) -> Rows:
        """The features with these slots, numbered anew."""
        place = np.full(self.n_slots, -1, np.int32)
        place[slots] = np.arange(len(slots), dtype=np.int32)
        flat = place[self.flat]
        on = flat >= 0
        return Rows(flat[on], self.row[on], self.n, len(slots))


def telling(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Slots in enough rows that differ clearly between the two values: log odds ratio over its standard error."""
    n1, n0 = y.sum(), (1 - y).sum()
    a, b = rows.gradient(y) + 0.5, rows.gradient(1 - y) + 0.5
    ratio = np.log(a / (n1 - a + 1)) - np.log(b / (n0 - b + 1))
    clear = np.abs(ratio) / np.sqrt(1 / a + 1 / b + 1 / (n1 - a + 1) + 1 / (n0 - b + 1)) >= LEAST_Z
    return np.flatnonzero(clear & (a + b - 1 >= LEAST_DOCUMENTS))


def logistic(rows: Rows, dense: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Slot weights, dense weights and intercept of a ridge-penalised logistic model on the telling slots.

    Accelerated gradient steps; the step follows from the largest eigenvalue of the features' products.
    """
    chosen, weights = telling(rows, y), np.zeros(rows.n_slots)
    rows = rows.only(chosen)
    k = len(chosen)

    def times(t: np.ndarray) -> np.ndarray:
        return rows.sums(t[:k]) + dense @ t[k:-1] + t[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate((rows.gradient(r), dense.T @ r, [r.sum()]))

    top = np.ones(k + dense.shape[1] + 1)
    for _ in range(30):
        top = back(times(top / np.linalg.norm(top)))
    ridge = np.full(len(top), RIDGE)
    ridge[-1] = 0
    step = 1 / (0.25 * np.linalg.norm(top) + RIDGE)
    theta = ahead = np.zeros(len(top))
    for t in range(STEPS):
        new = ahead - step * (back(probability(times(ahead)) - y) + ridge * ahead)
        ahead, theta = new + t / (t + 3) * (new - theta), new
    weights[chosen] = theta[:k]
    return weights, theta[k:-1], float(theta[-1])


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(rows: Rows, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot weights, earlier-category weights and intercepts of the chain; one column of ``labels`` per category."""
    fold = np.arange(rows.n) % FOLDS
    m = labels.shape[1]
    before = np.zeros((rows.n, 0))
    weights, chain, intercepts = np.zeros((m, rows.n_slots)), np.zeros((m, m)), np.zeros(m)
    for c in range(m):
        y = labels[:, c].astype(float)
        weights[c], chain[c, :c], intercepts[c] = logistic(rows, before, y)
        out = np.zeros(rows.n)
        for f in range(FOLDS if c + 1 < m else 0):
            on = fold != f
            w, d, b = logistic(rows.of(on), before[on], y[on])
            out[~on] = probability(rows.of(~on).sums(w) + before[~on] @ d + b)
        before = np.column_stack((before, out))
    return weights, chain, intercepts


MODEL = "used array<int>, weights array<array<double>>, chain array<array<double>>, intercepts array<double>"


def _fit_task(categories: tuple[str, ...], shift: float) -> Callable:
    def fit(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("h", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        slots, labels = sample.column("slots").chunk(0) if sample.num_rows else pa.array([], pa.list_(pa.int32())), np.column_stack([sample.column(c).to_numpy() for c in categories])
        flat = slots.flatten().to_numpy()
        row = np.repeat(np.arange(len(slots), dtype=np.int32), np.diff(slots.offsets.to_numpy()))
        weights, chain, intercepts = fit_chain(Rows(flat, row, len(slots), SLOTS), labels)
        used = np.flatnonzero(weights.any(axis=0))
        weights = weights[:, used]
        intercepts[-1] += shift  # only the last category's values were thinned out
        return pa.table({"used": pa.array([used.astype(np.int32)], pa.list_(pa.int32())), "weights": pa.array([weights.tolist()], pa.list_(pa.list_(pa.float64()))),
                         "chain": pa.array([chain.tolist()], pa.list_(pa.list_(pa.float64()))), "intercepts": pa.array([intercepts.tolist()], pa.list_(pa.float64()))})

    return fit


def feature_slots(text: Column) -> Column:
    """array<int> of the feature slots of each whole text."""

    @arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py() or "") for t in texts], pa.list_(pa.int32()))

    return of(text)


class Chain:
    """A fitted chain, ready to be broadcast."""

    def __init__(self, used: np.ndarray, weights: np.ndarray, chain: np.ndarray, intercepts: np.ndarray):
        self.table = np.zeros((SLOTS, len(intercepts)), np.float32)
        self.table[used] = weights.T
        self.chain, self.intercepts = chain, intercepts

    def probabilities(self, text: str) -> np.ndarray:
        z = self.table[features(text)].sum(axis=0, dtype=np.float64) + self.intercepts
        out = np.zeros(len(z))
        for c in range(len(z)):
            out[c] = 1 / (1 + np.exp(-np.clip(z[c] + self.chain[c, :c] @ out[:c], -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, doc_id: str = "doc_id",
        text: str = "text", sample: int = SAMPLE) -> Chain | None:
    """Fit a chain on at most ``sample`` labelled documents of each value of the last category."""
    last = categories[-1]
    known = labels.dropna(subset=[doc_id, *categories]).groupBy(F.col(doc_id).alias("doc_id")).agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    known = known.withColumn("h", F.xxhash64(F.col("doc_id")))
    n = {r[last]: r["n"] for r in known.groupBy(last).agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    chosen = [known.filter(F.col(last) == v).orderBy("h", "doc_id").limit(sample) for v in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most 2 * sample small rows
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).join(chosen, "doc_id")
    # a document may be repeated any number of times; it counts once, with its smallest text
    texts = texts.groupBy("doc_id", "h", *categories).agg(F.min("body").alias("body"))
    rows = texts.select("doc_id", "h", *categories, feature_slots(F.col("body")).alias("slots"))
    shift = float(np.log(n[1] / min(n[1], sample)) - np.log(n[0] / min(n[0], sample)))
    model = rows.groupBy().applyInArrow(_fit_task(categories, shift), MODEL).first()
    return Chain(np.array(model["used"], np.int64), np.array(model["weights"]), np.array(model["chain"]), np.array(model["intercepts"]))


def probabilities(text: Column, model: Broadcast) -> Column:
    """array<double> of the categories' probabilities for each whole text."""

    @arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        chain = model.value
        return pa.array([chain.probabilities(t.as_py() or "") for t in texts], pa.list_(pa.float64()))

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, out: str, categories: tuple[str, ...] = CATEGORIES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with a column ``out``: the categories' probabilities in their order; null without a model."""
    chain = fit(docs, labels, categories, doc_id, text)
    if chain is None:
        return docs.withColumn(out, F.lit(None).cast("array<double>"))
    return docs.withColumn(out, probabilities(F.col(text), docs.sparkSession.sparkContext.broadcast(chain)))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **names) -> DataFrame:
    """Documents that the last category's model does not reject, same columns."""
    out = "__p"
    while out in docs.columns:
        out += "_"
    p = F.element_at(F.col(out), -1)
    return scored(docs, labels, out, **names).filter(F.coalesce(p < threshold, F.lit(True))).drop(out)
