"""Quality classifier by positive-unlabelled learning.

A small network is fitted by the non-negative unbiased risk

    prior * E_positive[loss(z, +1)] + max(0, E_unlabelled[loss(z, -1)] - prior * E_positive[loss(z, -1)])

where `positive` are trusted rows of quality 1, `unlabelled` is web text taken without its labels and
`prior` is the estimated share of positives. Where the second part turns negative (over-fitting) the
step goes up its gradient instead, as the method asks. Labels, language, source and id never enter a
score: a score is a function of the text alone.

Fitting uses a bounded sample (MAX_POSITIVE, MAX_UNLABELLED rows, chosen by a hash of the id); scoring
covers every row in one narrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import doc_columns, give_back, table, tidy, with_text

#: Bounds of the sample that the classifier is fitted on.
MAX_POSITIVE = 20_000
MAX_UNLABELLED = 20_000
#: Prior where no labelled row is there to estimate it from.
DEFAULT_PRIOR = 0.5
THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 5, 0
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1500, 1024, 0.01, 1e-4

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\r\n", b".", b",", b"!?", b"*&$%#@^~", b"|<>{}[]\\/_=+", b"\"'`();:-"]
_CLASS = np.full(256, len(_GROUPS), np.int64)  # the last class: bytes of other characters and control bytes
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _k
_CLASS[128:] = len(_GROUPS) + 1
N_FEATURES = len(_GROUPS) + 2 + 12


def features(text: bytes) -> list[float]:
    """A fixed number of figures of the whole text; all zero for an empty one."""
    if not text:
        return [0.0] * N_FEATURES
    n = len(text)
    shares = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), len(_GROUPS) + 2) / n
    words = text.split()
    m = len(words)
    if m:
        lower = text.lower().split()
        distinct, pairs = len(set(lower)), len(set(zip(lower, lower[1:])))
        stuck = sum(map(eq, lower, lower[1:])) / m
        again = sum(map(eq, lower, lower[2:])) / m
        length = sum(map(len, words)) / m
        caps = sum(map(bytes.isupper, words)) / m
        titles = sum(map(bytes.istitle, words)) / m
    else:
        distinct = pairs = 0
        stuck = again = length = caps = titles = 0.0
    lines = text.split(b"\n")
    return [*shares.tolist(), np.log1p(n), np.log1p(m), distinct / max(m, 1), distinct / max(m, 1) ** 0.75, pairs / max(m - 1, 1), stuck, again, length / 10, caps, titles, len(set(lines)) / len(lines), np.log1p(n / len(lines))]


def feature_matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t or b"") for t in texts], np.float64).reshape(-1, N_FEATURES)


class Classifier:
    """A network with one hidden layer; `prior` is the score of every text when there is nothing to learn from."""

    def __init__(self, prior: float):
        self.prior, self.weights = prior, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - mean) / scale, -8, 8) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def risk_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk with logistic loss, and its gradient by the outputs on positives and on unlabelled rows."""
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if negative >= 0:
        return positive + negative, prior * (sp - 1 - sp) / len(zp), su / len(zu)
    return positive, prior * sp / len(zp), -su / len(zu)  # up the gradient of the negative part


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Classifier:
    """Minimises the risk by Adam on mini-batches. Without rows of either kind nothing is learned."""
    model = Classifier(prior)
    if not len(positive) or not len(unlabelled):
        return model
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    w = [both.mean(0), both.std(0) + 1e-6, rng.normal(0, 0.3, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    w[5][0] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    scaled = [np.clip((x - w[0]) / w[1], -8, 8) for x in (positive, unlabelled)]
    m1, m2 = [np.zeros_like(x) for x in w[2:]], [np.zeros_like(x) for x in w[2:]]
    for step in range(1, STEPS + 1):
        xp, xu = (x[rng.integers(0, len(x), min(BATCH, len(x)))] for x in scaled)
        hp, hu = np.tanh(xp @ w[2] + w[3]), np.tanh(xu @ w[2] + w[3])
        _, gp, gu = risk_gradient(hp @ w[4] + w[5], hu @ w[4] + w[5], prior)
        x, h, g = np.concatenate([xp, xu]), np.concatenate([hp, hu]), np.concatenate([gp, gu])
        back = np.outer(g, w[4]) * (1 - h * h)
        grads = [x.T @ back + DECAY * w[2], back.sum(0), h.T @ g + DECAY * w[4], np.array([g.sum()])]
        for k, grad in enumerate(grads):
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
            w[2 + k] = w[2 + k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    model.weights = tuple(w)
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null ids fall into fold 0, which is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(HELD_OUT_FOLD))


@tidy
def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = feature_matrix(batch.column("text").cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("trusted"), pa.array(list(x), pa.list_(pa.float64()))], ["trusted", "x"])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Classifier:
    """Fits on the training folds: trusted positives from `labels`, unlabelled text from `docs`.

    The prior is the share of quality 1 among the labelled training rows, kept within [0.02, 0.98].
    """
    known = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id")) != HELD_OUT_FOLD)
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = DEFAULT_PRIOR if share is None else min(0.98, max(0.02, share))
    def first(df: DataFrame, n: int) -> DataFrame:
        """The n rows whose ids have the least hashes; a bound on the hash keeps others from being gathered."""
        place, share = F.xxhash64(F.lit(7), "doc_id"), min(1.0, (1.1 * n + 1000) / max(1, df.count()))
        return df.where(place <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))).orderBy(place, "doc_id").limit(n)

    trusted = first(known.where("quality = 1").select("doc_id").distinct(), max_positive).withColumn("trusted", F.lit(True))
    web = first(docs.where("doc_id is not null").where(fold(F.col("doc_id")) != HELD_OUT_FOLD).select("doc_id"), max_unlabelled).distinct().withColumn("trusted", F.lit(False))
    picked = F.broadcast(trusted.unionByName(web))  # at most max_positive + max_unlabelled ids
    sample = docs.select("doc_id", "text").join(picked, "doc_id").select("trusted", "text").mapInArrow(_features_of, "trusted boolean, x array<double>")
    got = sample.toPandas()
    of = lambda k: np.array(got.loc[got["trusted"] == k, "x"].tolist(), np.float64).reshape(-1, N_FEATURES)
    positive, unlabelled = of(True), of(False)
    order = lambda x: x[np.lexsort(x.T)]  # noqa: E731  the same model whatever the order of rows
    return fit(order(positive), order(unlabelled), prior)


def score_documents(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns in `keep`, `score` and `predicted` for every row, repeated rows included. Null and empty texts get the score of an all-zero text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    given, text = with_text(docs, keep, "text", "q_text")
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(feature_matrix(batch.column(text).cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return given.mapInArrow(run, schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "score", "predicted")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = doc_columns(docs)
    model = train(docs, table(spark, sf_dir, "labels"))
    give_back()
    return doc_columns(score_documents(docs, model, keep=tuple(docs.columns)).where("predicted = 1"))
