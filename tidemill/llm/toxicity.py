"""Toxicity by non-negative positive-unlabelled learning, with numpy.

A logistic classifier over words and character n-grams of words is trained from confirmed toxic
texts and unlabelled texts (no label of theirs tells one text from another). The risk estimator is corrected by the
class prior p: p*R+(positive) + max(0, R-(unlabelled) - p*R-(positive)); where the bracket is
negative the step goes up its gradient instead, as published for non-negative PU learning. The prior
is the share of toxic rows among the labelled rows that may be learned from, so the number of rows labelled
0 counts there and nowhere else.

Bounds (``max_positive``, ``max_unlabelled``): the training sample is that many documents at most,
those whose hashed ids are smallest, whole texts. Features are not limited in number: they are all those of
the sampled positives that ``min_documents`` of them have and that are clearly more frequent there. Every
document is scored, over its whole text.

Nulls and edges: a null or empty text has no features and gets the score of the bias alone; a
document may have no label or several (it is a positive if any says so); a null doc_id counts as
learnable but matches no label; repeated rows each get a row; without any positive the scores are 0;
an empty table gives no rows. Only doc_id and text are read of the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.compute  # noqa: F401  (used by name)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, whole, written

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Toxicity:
    max_positive: int = 2_500
    max_unlabelled: int = 7_500
    folds: int = 5
    held_out_fold: int = 0
    gram: int = 5
    min_documents: int = 4
    min_lift: float = 3.0
    min_clear: float = 4.0
    clear_per_root: float = 0.35
    epochs: int = 300
    rate: float = 0.05
    decay: float = 1e-4
    beta: float = 0.0


@dataclass
class Model:
    """weights: by feature; those near 0 are left out."""

    weights: dict[str, float]
    bias: float
    gram: int


def features_of(word: str, gram: int) -> list[str]:
    """The word between ``^`` and ``$`` and all its character n-grams."""
    w = f"^{word}$"
    return [w] if len(w) <= gram else [w, *(w[i : i + gram] for i in range(len(w) - gram + 1))]


def lowered(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


def choose(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, how: Toxicity) -> np.ndarray:
    """Features that positives have clearly more often, the clearest first; were all of a feature's texts toxic, its lift would be 1 / prior."""
    share_p, share_u = in_p / n_p, in_u / n_u
    clear = (share_p - share_u) / np.sqrt(share_p / n_p + share_u / n_u + 1e-12)
    least = min(how.min_clear, how.clear_per_root * np.sqrt(n_p))  # few positives can't show more
    chosen = np.flatnonzero((in_p >= how.min_documents) & (share_p > how.min_lift * share_u) & (clear > least))
    return chosen[np.argsort(-clear[chosen], kind="stable")]


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: list[str], prior: float, how: Toxicity) -> Model:
    """positive, unlabelled: the numbers of the features of each text; names: of the features."""
    n_p, n_u, n = len(positive), len(unlabelled), len(names)
    if not n_p or not n_u:
        return Model({}, -50.0, how.gram)
    owner, cols = [], []
    for k, row in enumerate([*positive, *unlabelled]):
        cols.append(row)
        owner.append(np.full(len(row), k, "i4"))
    owner, cols = np.concatenate(owner), np.concatenate(cols)
    w, bias = np.zeros(n), np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    # for the logistic loss, d loss(z, +1)/dz = s - 1 and d loss(z, -1)/dz = s
    for step in range(1, how.epochs + 1):
        z = np.bincount(owner, weights=w[cols], minlength=n_p + n_u) + bias
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        soft = np.logaddexp(0, z)
        negative = soft[n_p:].mean() - prior * soft[:n_p].mean()
        g = np.empty_like(s)
        if negative >= -how.beta:
            g[:n_p] = -prior / n_p
            g[n_p:] = s[n_p:] / n_u
        else:
            g[:n_p] = prior * s[:n_p] / n_p
            g[n_p:] = -s[n_p:] / n_u
        grad = np.r_[np.bincount(cols, weights=g[owner], minlength=n) + how.decay * w, g.sum()]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(bias), how.gram)


class _Numbers:
    """Numbers of the indexed features of a text; those of a word are looked up once."""

    def __init__(self, index: dict[str, int], gram: int, cache_words: int = 150_000):
        self.index, self.gram, self.limit, self.known = index, gram, cache_words, {}

    def __call__(self, text: str | None) -> list[int]:
        known, found = self.known, set()
        if len(known) > self.limit:
            known.clear()
        for w in lowered(text):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(self.index[f] for f in features_of(w, self.gram) if f in self.index)
            found.update(own)
        return sorted(found)


class Scorer:
    """Scores of texts; the features of a word are looked up once."""

    def __init__(self, model: Model, cache_words: int = 200_000):
        self.model, self.limit, self.known = model, cache_words, {}

    def _of(self, word: str) -> tuple[str, ...]:
        has = self.model.weights
        return tuple({f for f in features_of(word, self.model.gram) if f in has})

    def score(self, text: str | None) -> float:
        known, has, found = self.known, self.model.weights, set()
        if len(known) > self.limit:
            known.clear()
        for w in lowered(text):
            f = known.get(w)
            if f is None:
                f = known[w] = self._of(w)
            if f:
                found.update(f)
        z = self.model.bias + sum(has[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))


def held_out(how: Toxicity, doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, how.folds) == how.held_out_fold, F.lit(False))


def _sample(ids: DataFrame, n: int, kind: int) -> DataFrame:
    """n ids at most, the smallest by hash. A threshold on the hash comes first, so about n rows are ever sorted, not n of each task."""
    rows = ids.count()
    share = min(1.0, (n + 4 * n**0.5 + 10) / max(1, rows))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000))
    return ids.where(h < int(share * 1_000_000_000) + 1).distinct().orderBy(h, "doc_id").limit(n).withColumn("kind", F.lit(kind))


def fit(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity()) -> Model:
    """Trains on the driver from a sample bounded by the parameters; what comes there are numbers of features."""
    import pyarrow as pa

    docs = whole(docs, {"doc_id": "long", "text": "string"})
    labels = whole(labels, {"doc_id": "long", "toxic": "int"}).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    labels = labels.where(~held_out(how, F.col("doc_id")))
    prior = labels.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    positive = _sample(labels.where("toxic = 1").select("doc_id"), how.max_positive, 1)
    unlabelled = _sample(docs.where(~held_out(how, F.col("doc_id"))).select("doc_id"), how.max_unlabelled, 0)
    chosen = F.broadcast(positive.unionByName(unlabelled))  # max_positive + max_unlabelled rows at most
    # ids first, then text: of the large table only sampled rows go on; copies of a text count once in each group
    sample = docs.join(chosen, "doc_id").groupBy("kind", F.xxhash64("text").alias("h")).agg(F.min_by("text", "doc_id").alias("text"))
    sample = written(sample.select("kind", "text").coalesce(8), "sample")  # max_positive + max_unlabelled rows at most

    def features(batches: Iterator) -> Iterator:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(sorted({f for w in lowered(t.as_py()) for f in features_of(w, how.gram)}), pa.string())], names=["f"])

    often = sample.where("kind = 1").select("text").mapInArrow(features, "f string").groupBy("f").count().where(F.col("count") >= how.min_documents)
    names = [r["f"] for r in often.orderBy(F.desc("count"), "f").collect()]
    context = docs.sparkSession.sparkContext
    sent = context.broadcast({f: k for k, f in enumerate(names)})  # features of max_positive texts

    def count(batches: Iterator) -> Iterator:
        """How many texts of each kind have each candidate: sums of a task."""
        of, n = _Numbers(sent.value, how.gram), np.zeros((2, max(1, len(sent.value))), "i8")
        size = np.zeros(2, "i8")
        for b in batches:
            for kind, t in zip(b.column("kind").to_pylist(), b.column("text"), strict=True):
                n[kind, of(t.as_py())] += 1
                size[kind] += 1
        kind, f = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[kind, 0, 1].astype("i4")), pa.array(np.r_[f, -1, -1].astype("i4")), pa.array(np.r_[n[kind, f], size])], names=["kind", "f", "n"])

    total = sample.mapInArrow(count, "kind int, f int, n long").groupBy("kind", "f").agg(F.sum("n").alias("n")).toPandas()
    seen, size = np.zeros((2, len(names)), "i8"), np.zeros(2, "i8")
    own = total.f >= 0
    seen[total.kind[own], total.f[own]] = total.n[own]
    size[total.kind[~own]] = total.n[~own]
    if not size.all():
        return train([], [], [], prior, how)
    names = [names[k] for k in choose(seen[1], seen[0], int(size[1]), int(size[0]), how)]
    sent.unpersist()
    kept = context.broadcast({f: k for k, f in enumerate(names)})  # those chosen of them

    def numbers(batches: Iterator) -> Iterator:
        of = _Numbers(kept.value, how.gram)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array([of(t.as_py()) for t in b.column("text")], pa.list_(pa.int32()))], names=["kind", "f"])

    rows = sample.mapInArrow(numbers, "kind int, f array<int>").toPandas()
    groups = {k: [np.asarray(x, "i4") for x in rows.f[rows.kind == k]] for k in (0, 1)}
    return train(groups[1], groups[0], names, min(0.95, max(1e-3, prior)), how)


def _scored(model: Model, docs: DataFrame, passed: list[str], keep_all: bool):
    """A function over record batches: the passed columns and the score; or only the rows below 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # chosen features of max_positive texts

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(sent.value)
        for b in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in b.column("text")], pa.float64())
            columns = [b.column(c) for c in passed]
            if keep_all:
                yield pa.RecordBatch.from_arrays([*columns, scores], names=[*passed, "score"])
            else:
                yield pa.RecordBatch.from_arrays(columns, names=passed).filter(pa.compute.less(scores, 0.5))

    return run


def score(docs: DataFrame, model: Model, how: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    docs = whole(docs, {"doc_id": "long", "text": "string"})
    docs = docs.select("doc_id", held_out(how, F.col("doc_id")).alias("held_out"), "text")
    out = docs.mapInArrow(_scored(model, docs, ["doc_id", "held_out"], True), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score is below 0.5, in one pass and without a join."""
    return docs.mapInArrow(_scored(model, docs, docs.columns, False), docs.schema)
