"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; web text without a label is the
unlabelled set. A small network on features of the whole text minimises the
non-negative unbiased risk (Kiryo et al., 2017):

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

so no document need be labelled bad. The class prior is estimated from the same two
sets: the smallest ratio, over score thresholds, of the unlabelled to the positive share
above the threshold (an upper bound that is tight where only positives score high).

Gradient steps are taken on bounded samples; the features' mean and scale and the
unlabelled shares that the prior is read from are counted over all unlabelled documents.

Defined results: a null text is the empty text; repeated rows score alike; an empty
table gives no rows; with fewer than two unlabelled documents, all learnable ones count as
unlabelled, their labels hidden (the risk only asks for a sample of the mixture); without
two positives nothing is learned: every score is the least that counts as good (``UNLEARNED``), so that nothing is dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import score_rows, ship_by_value, sigmoid

#: Bounded samples that the model is fitted on (chosen by id hash).
POSITIVE_CAP = 8000
UNLABELLED_CAP = 16000
#: Prior, and score of everything, where nothing can be learned.
NO_DATA_PRIOR = 0.5
UNLEARNED = 0.7

BYTE_KIND = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    BYTE_KIND[_i] = 1 if _c.islower() and _i < 128 else 2 if _c.isupper() and _i < 128 else 3 if _c.isdigit() and _i < 128 else 4 if _c == " " else 5 if _c in "\n\r\t" else 6 if _c in ".,;:!?'\"-()" else 0 if _i >= 128 else 7
FEATURES = 30


def features(text: str) -> np.ndarray:
    """Shape of a whole text: character kinds, repetition of words and lines, word lengths."""
    f = np.zeros(FEATURES, np.float64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        f[0] = 1.0
        return f
    kinds = np.bincount(BYTE_KIND[raw], minlength=8)
    f[1:9] = kinds / n
    f[9] = np.log1p(n)
    by_byte = np.bincount(raw, minlength=256)
    p = by_byte[by_byte > 0] / n
    f[10] = -(p * np.log(p)).sum()
    f[11] = by_byte[[33, 35, 36, 37, 38, 42, 124]].sum() / n
    words = text.split()
    m = len(words)
    if not m:
        return f
    count = Counter(words)
    f[12] = np.log1p(m)
    f[13] = len(count) / m
    f[14] = max(count.values()) / m
    pairs = sum(a == b for a, b in zip(words, words[1:]))
    f[15] = pairs / m
    size = np.fromiter(map(len, words), np.int64, m)
    f[16], f[17] = size.mean(), size.std()
    f[18] = (size > 14).mean()
    f[19] = (size <= 2).mean()
    f[20] = sum(w.isupper() for w in words) / m
    f[21] = sum(w.isalpha() for w in words) / m
    f[22] = sum(not w[-1].isalnum() for w in words) / m
    f[23] = sum(not w[0].isalnum() for w in words) / m
    lines = text.split("\n")
    f[24] = np.log1p(len(lines))
    f[25] = 1 - len(set(lines)) / len(lines)
    f[26] = m / len(lines)
    f[27] = sum(w.istitle() for w in words) / m
    f[28] = len(count) / np.sqrt(m)
    f[29] = text.count(". ") / m
    return f


def feature_rows(docs: DataFrame) -> DataFrame:
    """Every column but the text, plus the feature array (executors look at whole texts)."""

    def make():
        return lambda texts: {"x": [features(t) for t in texts]}

    return score_rows(docs, "text", make, {"x": pa.list_(pa.float64())}, "x array<double>")


class Net:
    """One hidden layer; ``values`` are plain arrays, fit for a broadcast."""

    def __init__(self, mean, scale, values):
        self.mean, self.scale, self.values = mean, scale, values

    def logits(self, x: np.ndarray) -> np.ndarray:
        return logits_of(x, self.mean, self.scale, self.values)


def logits_of(x, mean, scale, values):
    w1, b1, w2, b2 = values
    h = np.maximum(np.clip((x - mean) / scale, -8, 8) @ w1 + b1, 0)
    return h @ w2 + b2


def train_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, moments: tuple[np.ndarray, np.ndarray] | None = None, hidden: int = 24, steps: int = 1500, rate: float = 3e-3, batch: int = 512, seed: int = 11) -> Net:
    """Adam on the non-negative risk; where the corrected part goes below zero, its gradient is turned round."""
    rng = np.random.default_rng(seed)
    mean, scale = (unl.mean(0), unl.std(0)) if moments is None else moments
    scale = scale + 1e-6
    p, u = np.clip((pos - mean) / scale, -8, 8), np.clip((unl - mean) / scale, -8, 8)
    d = p.shape[1]
    values = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(())]
    m, v, step = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values], 0
    rounds = max(1, len(u) // batch)
    epochs = -(-steps // rounds)
    for epoch in range(epochs):
        pu, pp = rng.permutation(len(u)), rng.permutation(len(p))
        for k in range(rounds):
            ub = u[pu[k::rounds]]
            pb = p[pp[k::rounds]] if len(p) >= rounds else p
            x = np.concatenate([pb, ub])
            pre = x @ values[0] + values[1]
            h = np.maximum(pre, 0)
            s = sigmoid(h @ values[2] + values[3])
            sp, su = s[: len(pb)], s[len(pb) :]
            # sigmoid loss: l(z, +1) = 1 - s, l(z, -1) = s
            negative = su.mean() - prior * sp.mean()
            g_pos_up = -prior * sp * (1 - sp) / len(pb)
            g_neg = np.concatenate([-prior * sp * (1 - sp) / len(pb), su * (1 - su) / len(ub)])
            g = np.concatenate([g_pos_up, np.zeros(len(ub))]) + g_neg if negative >= 0 else -g_neg
            gh = np.outer(g, values[2]) * (pre > 0)
            grads = [x.T @ gh + 1e-4 * values[0], gh.sum(0), h.T @ g + 1e-4 * values[2], g.sum()]
            step += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                values[i] = values[i] - rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return Net(mean, scale, tuple(values))


def thresholds(pos: np.ndarray, least: float = 0.05) -> np.ndarray:
    """Score thresholds, rising, that the prior is read at."""
    return np.quantile(pos, np.linspace(0, 1 - least, 96))


def reached(ts: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """How many scores reach none, the first, .. all of the thresholds at most."""
    return np.bincount(np.searchsorted(ts, scores, "right"), minlength=len(ts) + 1)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, least: float = 0.05) -> float:
    """Share of positives among the unlabelled, from held-back scores of both sets."""
    return prior_of_counts(pos, reached(thresholds(pos, least), unl), least)


def prior_of_counts(pos: np.ndarray, counts: np.ndarray, least: float = 0.05) -> float:
    """``estimate_prior`` with the unlabelled scores given as ``reached`` counts.

    For a threshold t: unlabelled above t is at least prior * positives above t, so every
    ratio bounds the prior from above; sampling error is added before the smallest is taken.
    """
    total = counts.sum()
    best = 1.0
    for i, t in enumerate(thresholds(pos, least)):
        qp, qu = (pos >= t).mean(), counts[i + 1 :].sum() / total
        err = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(total))
        if qp > least and (qu + err) / qp < best + err / qp:
            best = min(best, qu / qp + 0.25 * err / qp)
    return float(min(max(best, 0.02), 0.98))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An array column of features as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), FEATURES)


def moments_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, standard deviation) of the features ``x`` of all rows; each task gives one row."""
    ship_by_value()

    def merge(a, b):
        n, shift = a[0] + b[0], b[1] - a[1]
        return n, a[1] + shift * (b[0] / n), a[2] + b[2] + shift**2 * (a[0] * b[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                one = (len(x), x.mean(0), ((x - x.mean(0)) ** 2).sum(0))
                total = one if total is None else merge(total, one)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.list_(pa.float64())), pa.array([total[2]], pa.list_(pa.float64()))], names=["n", "mean", "m2"])

    parts = rows.select("x").mapInArrow(run, "n bigint, mean array<double>, m2 array<double>").orderBy("n", "mean", "m2").collect()
    total = None
    for r in parts:
        one = (r["n"], np.array(r["mean"]), np.array(r["m2"]))
        total = one if total is None else merge(total, one)
    return total[1], np.sqrt(total[2] / total[0])


def held_back_counts(rows: DataFrame, models: list[tuple[Net, np.ndarray, pa.Array]]) -> list[np.ndarray]:
    """``reached`` counts of all rows (doc_id, x) for each (model, thresholds, ids that the model was trained on)."""
    ship_by_value()
    plain = [((m.mean, m.scale, m.values), ts, ids) for m, ts, ids in models]
    ref = rows.sparkSession.sparkContext.broadcast(plain)  # ids: half a bounded sample each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        models = ref.value
        total = [np.zeros(len(ts) + 1, np.int64) for _, ts, _ in models]
        for b in batches:
            x = matrix(b.column(1))
            for k, (values, ts, ids) in enumerate(models):
                fresh = ~pc.is_in(b.column(0), value_set=ids).to_numpy(zero_copy_only=False)
                total[k] += reached(ts, logits_of(x[fresh], *values))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.list_(pa.int64()))], names=["model", "counts"])

    got = rows.select("doc_id", "x").mapInArrow(run, "model int, counts array<bigint>")
    each = got.select("model", F.posexplode("counts").alias("at", "n")).groupBy("model", "at").agg(F.sum("n").alias("n")).collect()
    out = [np.zeros(len(ts) + 1, np.int64) for _, ts, _ in models]
    for r in each:
        out[r["model"]][r["at"]] = r["n"]
    return out


def fit(pos: pa.Table, unl: pa.Table, unlabelled: DataFrame) -> tuple[Net | None, float]:
    """Prior from two first models, each counted on what it didn't see, then the final model.

    ``pos``, ``unl``: samples (doc_id, x); ``unlabelled``: all unlabelled rows (doc_id, x).
    """
    if len(pos) < 2 or len(unl) < 2:
        return None, NO_DATA_PRIOR
    moments = moments_of(unlabelled)
    p, u = matrix(pos["x"]), matrix(unl["x"])
    a, b = np.arange(len(p)) % 2 == 0, np.arange(len(u)) % 2 == 0
    models, held = [], []
    for flip in (False, True):
        first = train_nnpu(p[a ^ flip], u[b ^ flip], 0.5, moments, steps=500)
        held.append(first.logits(p[~(a ^ flip)]))
        models.append((first, thresholds(held[-1]), unl["doc_id"].filter(pa.array(b ^ flip)).combine_chunks()))
    prior = float(np.mean([prior_of_counts(h, c) for h, c in zip(held, held_back_counts(unlabelled, models))]))
    return train_nnpu(p, u, prior, moments), prior


def fit_quality(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, positive_cap: int = POSITIVE_CAP, unlabelled_cap: int = UNLABELLED_CAP) -> tuple[Net | None, float]:
    """(model, estimated prior). ``learn``: rows that may be learned from, by ``doc_id``."""
    learn = F.lit(True) if learn is None else learn
    one = labels.where(learn & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"), F.lit(True).alias("labelled"))
    free = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id", "text")
    # repeated rows of an id count once; texts stay where they are read, only features are joined
    rows = feature_rows(free).groupBy("doc_id").agg(F.min("x").alias("x")).join(one, "doc_id", "left")
    rows = C.staged(rows, "features")
    unlabelled = rows.where(F.col("labelled").isNull()).select("doc_id", "x")
    if len(unlabelled.limit(2).toArrow()) < 2:
        unlabelled = rows.select("doc_id", "x")

    def sample(df: DataFrame, cap: int) -> pa.Table:
        return C.smallest_hashes(df, cap, "doc_id").select("doc_id", "x").toArrow().sort_by("doc_id")

    return fit(sample(rows.where("q = 1"), positive_cap), sample(unlabelled, unlabelled_cap), unlabelled)


def scorer(ref):
    def make():
        model, prior = ref.value

        def score(texts):
            if model is None or not texts:
                return {"score": np.full(len(texts), UNLEARNED)}
            x = np.stack([features(t) for t in texts])
            return {"score": sigmoid(logits_of(x, *model))}

        return score

    return make


def share(docs: DataFrame, model: Net | None, prior: float):
    plain = None if model is None else (model.mean, model.scale, model.values)
    return docs.sparkSession.sparkContext.broadcast((plain, prior))  # a few thousand numbers


def score_quality(docs: DataFrame, model: Net | None, prior: float) -> DataFrame:
    """(doc_id, score) of every whole text."""
    return score_rows(docs.select("doc_id", "text"), "text", scorer(share(docs, model, prior)), {"score": pa.float64()}, "score double")


def keep_good(docs: DataFrame, model: Net | None, prior: float, threshold: float = 0.7) -> DataFrame:
    """The documents that score at least ``threshold``, all columns unchanged."""
    make = scorer(share(docs, model, prior))

    def keeper():
        score = make()
        return lambda texts: score(texts)["score"] >= threshold

    return C.keep_rows(docs, "text", keeper)
