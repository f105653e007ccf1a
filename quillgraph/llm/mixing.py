"""Soft-membership mixing: documents belong to domains by posteriors, and rates fit token targets.

A softmax regression over hashed words and four shares of the text is fitted to the labels
table (domains: clean, low quality, toxic) on ``fit_rows`` labelled documents with the least id hashes. It gives
every document its domain posteriors p. Rates r >= 0 then minimise the squared distance between
the expected domain tokens sum(n r p) and their targets, in the metric of the domains' Gram matrix, by
projected gradient steps from r = 1. A step needs one aggregation of as many numbers as domains, and
rates are a formula of the posteriors and all steps so far: nothing of documents is gathered.

Targets are ``weights`` of a budget; the default budget keeps ``headroom`` times the clean tokens there are.

Defined cases: without two labelled domains posteriors are the label shares (all clean if there are no labels);
null or empty texts have no tokens and get a rate by their posteriors like others; equal rows get equal
copies; a null id is hashed with the text, as all ids are; ``mix`` keeps columns called like those that ``rated`` adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize
from .textkit import BLANK, LOWER, Rolling, find_words, slices, text_bytes, tidy

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = (0.90, 0.08, 0.02)
HEADROOM = 1.1
FIT_ROWS = 4000
BUCKETS = 1 << 15
SEED = 77
STEPS = 25
TOLERANCE = 1e-3
SYMBOL = np.zeros(256, bool)
SYMBOL[[*b"#*$%&|<>!"]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True


def features(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a slice: words of each text, its distinct word buckets, and four shares."""
    data, offsets = text_bytes(column)
    words = find_words(LOWER[data], offsets)
    rolling = Rolling(13)
    bucket = (rolling.ranges(rolling.byte_sums(words.data), words.start, words.end) % np.uint64(BUCKETS)).astype(np.int32)
    n = np.diff(words.first)
    own = [np.unique(bucket[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]

    def per_doc(mask: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(mask)]
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, np.diff(offsets))

    distinct = np.array([len(x) for x in own]) / np.maximum(1, n)
    dense = np.stack([per_doc(SYMBOL[data]), per_doc(UPPER[data]), per_doc(BLANK[data]), distinct], axis=1)
    return n, own, dense


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            _, own, dense = features(part.column("text"))
            arrays = [part.column("domain"), pa.array(own, pa.list_(pa.int32())), pa.array(list(dense), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["domain", "words", "dense"])


class Classifier:
    """Softmax regression on the presence of hashed words and standardised shares."""

    def __init__(self, domain: np.ndarray, words: list[np.ndarray], dense: np.ndarray, steps: int = 200, ridge: float = 1e-2) -> None:
        k = len(DOMAINS)
        seen = np.bincount(domain, minlength=k) if len(domain) else np.eye(1, k)[0]
        self.prior = seen / seen.sum()
        self.trained = (seen > 0).sum() > 1
        self.weights, self.dense = np.zeros((BUCKETS + 1, k)), np.zeros((4, k))
        self.bias = np.log(np.maximum(self.prior, 1e-6))
        self.mean, self.scale = np.zeros(4), np.ones(4)
        if not self.trained:
            return
        self.mean, self.scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6)
        truth = np.eye(k)[domain]
        columns = np.concatenate([*words, np.zeros(0, np.int32)])
        rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
        shares = np.clip((dense - self.mean) / self.scale, -5, 5)
        past = [np.full_like(x, 1e-8) for x in (self.weights, self.dense, self.bias)]
        for _ in range(steps):
            wrong = (self._softmax(self._scores(words, shares)) - truth) / len(words)
            steep = np.stack([np.bincount(columns, wrong[rows, j], BUCKETS + 1) for j in range(k)], axis=1)
            slopes = (steep + ridge * self.weights, shares.T @ wrong + ridge * self.dense, wrong.sum(axis=0))
            for x, g, p in zip((self.weights, self.dense, self.bias), slopes, past):
                p += g * g
                x -= 0.1 * g / np.sqrt(p)

    def _scores(self, words: list[np.ndarray], shares: np.ndarray) -> np.ndarray:
        at = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
        flat = np.concatenate([x for w in words for x in (w, [BUCKETS])]).astype(np.int64) if words else np.zeros(0, np.int64)
        sums = np.add.reduceat(self.weights[flat], at, axis=0) if words else np.zeros((0, len(DOMAINS)))
        return sums + shares @ self.dense + self.bias

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def posteriors(self, words: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.tile(self.prior, (len(words), 1))
        return self._softmax(self._scores(words, np.clip((dense - self.mean) / self.scale, -5, 5)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """Fit on at most ``fit_rows`` labelled documents; that bound also holds for what is broadcast and collected."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select("doc_id", domain.alias("domain"))
    held = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(held), "doc_id")
    # where ids repeat there are more rows than labels: of them too those of the least hashes
    texts = texts.orderBy(F.xxhash64("doc_id", "text"), "domain").limit(2 * fit_rows).select("domain", "text")
    rows = texts.mapInArrow(tidy(_feature_batches), "domain int, words array<int>, dense array<double>").toArrow()
    dense = np.array(rows.column("dense").to_pylist()).reshape(-1, 4)
    words = [np.asarray(w, np.int32) for w in rows.column("words").to_pylist()]
    order = np.lexsort((dense[:, 0], [w[:1].sum() for w in words], [len(w) for w in words])) if words else []
    return Classifier(rows.column("domain").to_numpy()[order], [words[i] for i in order], dense[order]) if words else Classifier(np.zeros(0, int), [], dense)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with n_tokens (long) and a posterior for each domain (``p_clean`` and so on), rounded to six places."""
    names = ["n_tokens", *(f"p_{d}" for d in DOMAINS)]
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, own, dense = features(part.column("text"))
                p = shared.value.posteriors(own, dense).round(6)
                arrays = [pa.array(n.astype(np.int64)), *(pa.array(p[:, j].copy()) for j in range(len(DOMAINS)))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], [*kept, *names])

    fields = [T.StructField(names[0], T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names[1:])]
    return docs.select(*kept).mapInArrow(tidy(predict), T.StructType([*(docs.schema[c] for c in kept), *fields]))


def rate_column(steps: list[np.ndarray]) -> Column:
    """The rate after projected steps: each takes the posteriors' share of the gradient off and stays at 0 or above."""
    rate = F.lit(1.0)
    for g in steps:
        change = sum((F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS, g)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - change)
    return rate


def fit_rates(members: DataFrame, weights: tuple = WEIGHTS, headroom: float = HEADROOM, budget: float | None = None, max_steps: int = STEPS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps for ``rate_column``, targets, expected tokens reached); ``members`` has n_tokens and posteriors and is read once a step."""
    k = len(DOMAINS)
    sums = members.agg(
        *[F.sum(F.col("n_tokens") * F.col(f"p_{a}") * F.col(f"p_{b}")).alias(f"g_{a}_{b}") for a in DOMAINS for b in DOMAINS],
        *[F.sum(F.col("n_tokens") * F.col(f"p_{a}")).alias(f"t_{a}") for a in DOMAINS],
    ).first()
    flat = np.array([float(x or 0) for x in sums])
    gram, now = flat[: k * k].reshape(k, k), flat[k * k :]
    share = np.asarray(weights, float) / sum(weights)
    if budget is None:
        budget = headroom * now[0] / share[0] if share[0] else now.sum()
    targets = share * budget
    targets[now <= 0] = 0  # a domain without tokens can't be filled
    inverse = np.linalg.pinv(gram + 1e-9 * max(np.trace(gram), 1e-12) * np.eye(k), rcond=1e-8)
    steps: list[np.ndarray] = []
    while len(steps) < max_steps and np.abs(now - targets).max() > TOLERANCE * max(budget, 1):
        steps.append(inverse @ (now - targets))
        reached = members.withColumn("_r", rate_column(steps)).agg(*[F.sum(F.col("n_tokens") * F.col("_r") * F.col(f"p_{d}")) for d in DOMAINS]).first()
        now = np.array([float(x or 0) for x in reached])
    return steps, targets, now


def copies(seed: int = SEED) -> Column:
    """A whole number of copies whose expectation is the rate; the draw is a hash of id and text."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")


def rated(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> DataFrame:
    """``docs`` with n_tokens, posteriors, rate and copies. Texts are read twice and never shuffled."""
    model = fit(docs, labels, fit_rows)
    names = ["n_tokens", *(f"p_{d}" for d in DOMAINS)]
    light = materialize(memberships(docs.select("text"), model).select(*names), "memberships")
    steps, _, _ = fit_rates(light, **options)
    return memberships(docs, model).withColumn("rate", F.round(rate_column(steps), 6)).withColumn("copies", copies())


def mix(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    added = ("n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies", "_copy")
    taken = {c: f"_in_{c}" for c in docs.columns if c in added}
    out = rated(docs.withColumnsRenamed(taken), labels, **options).where("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*[F.col(taken.get(c, c)).alias(c) for c in docs.columns])
