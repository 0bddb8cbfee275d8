"""Toxicity: subword-bag embeddings averaged into a linear softmax (fastText style).

A text is the bag of its distinct words and of their character 3- to 5-grams. Each bucket
has a learned vector; the text's vector is their average; a linear softmax over two
classes reads it. Vectors and softmax are trained jointly in numpy, so an unseen
misspelling is judged by the n-grams it shares with known words.

Defined results: a null text is the empty text and scores the bias alone; repeated
rows score alike; an empty table gives no rows; without any usable label of one
class every text scores the known share of toxic labels (0 if there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import score_rows, sigmoid
from .subwords import SubwordHasher

#: Labelled texts per class that the model is fitted on (bounded sample, by id hash).
CLASS_CAP = 3000
BITS = 18
DIM = 8
#: Neutral features that every bag holds besides its own, so that a few words alone don't decide
#: (chosen among 0, 100 and 400 on inner folds of the learnable labels, never on held-out ones).
PAD = 400


@dataclass
class ToxicModel:
    """What scoring needs: per bucket the difference of the two class logits, and the bias."""

    weights: np.ndarray
    bias: float
    bits: int = BITS


def bag_rows(sample: DataFrame, bits: int) -> DataFrame:
    """(doc_id, y, buckets): bags are made on the executors, whole texts never reach the driver."""

    def make():
        hasher = SubwordHasher(bits)
        return lambda texts: {"buckets": [hasher.buckets(t) for t in texts]}

    return score_rows(sample, "text", make, {"buckets": pa.list_(pa.int32())}, "buckets array<int>")


def train(ids: list[np.ndarray], y: np.ndarray, bits: int = BITS, dim: int = DIM, steps: int = 750, rate: float = 0.5, batch: int = 64, seed: int = 7) -> ToxicModel:
    """Joint AdaGrad descent on bucket vectors and softmax; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    emb = (rng.random((1 << bits, dim), dtype=np.float32) - 0.5) / dim
    out = (rng.random((dim, 2), dtype=np.float32) - 0.5) / dim
    off = np.zeros(2, np.float32)
    g_emb = np.full((1 << bits, 1), 1e-6, np.float32)
    g_out, g_off = np.full_like(out, 1e-6), np.full_like(off, 1e-6)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    epochs = -(-steps * batch // max(1, len(y)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            rows = [r for r in order[s : s + batch] if len(ids[r])]
            if not rows:
                continue
            flat, size = np.concatenate([ids[r] for r in rows]), np.array([len(ids[r]) for r in rows])
            a = np.repeat(1.0 / (size + PAD), size).astype(np.float32)[:, None]
            doc = np.repeat(np.arange(len(rows)), size)
            vec = np.add.reduceat(emb[flat] * a, np.r_[0, np.cumsum(size)[:-1]], axis=0)
            z = vec @ out + off
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            d = p.astype(np.float32)
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= weight[rows][:, None].astype(np.float32)
            back = (d @ out.T)[doc] * a
            grad_out, grad_off = vec.T @ d / len(rows), d.mean(0)
            g_out += grad_out**2
            g_off += grad_off**2
            out -= step * grad_out / np.sqrt(g_out)
            off -= step * grad_off / np.sqrt(g_off)
            # several documents of a batch may touch one bucket: add them up first
            uniq, where = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(where, back[:, k], len(uniq)) for k in range(dim)], 1).astype(np.float32)
            g_emb[uniq] += (grad**2).mean(1, keepdims=True)
            emb[uniq] -= step * 0.2 * grad / np.sqrt(g_emb[uniq])
    diff = emb @ (out[:, 1] - out[:, 0])
    return ToxicModel(diff.astype(np.float32), float(off[1] - off[0]), bits)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, class_cap: int = CLASS_CAP, bits: int = BITS) -> ToxicModel:
    """Fit on at most ``class_cap`` labelled documents of each class.

    ``learn``: condition on ``labels`` rows that may be learned from (default: all).
    """
    learn = F.lit(True) if learn is None else learn
    known = labels.where(learn & F.col("toxic").isin(0, 1)).agg(F.avg(F.col("toxic")), F.count(F.lit(1))).first()
    sample = C.texts_of(docs, C.bounded_label_sample(labels, "toxic", learn, class_cap))
    rows = bag_rows(sample.select("doc_id", "y", "text"), bits).toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    y = np.asarray(rows["y"].to_pylist(), dtype=np.int64)
    if len(set(y.tolist())) < 2:
        share = float(known[0] or 0.0)
        return ToxicModel(np.zeros(1 << bits, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), bits)

    bags = rows["buckets"].combine_chunks()
    off, val = bags.offsets.to_numpy(), bags.values.to_numpy()
    return train([val[off[i] : off[i + 1]] for i in range(len(bags))], y, bits)


def scorer(model_ref):
    """Task side: whole texts -> probability of class 1."""

    def make():
        weights, bias, bits = model_ref.value
        hasher = SubwordHasher(bits)

        def score(texts):
            z = np.array([weights[b].sum() / (len(b) + PAD) for b in map(hasher.buckets, texts)], dtype=np.float64)
            return {"score": sigmoid(z + bias)}

        return score

    return make


def share(docs: DataFrame, model: ToxicModel):
    """Broadcast the model (2**bits floats, whatever the input) as plain values."""
    return docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.bits))


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score) of every document."""
    ref = share(docs, model)
    return score_rows(docs.select("doc_id", "text"), "text", scorer(ref), {"score": pa.float64()}, "score double")


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, all columns unchanged."""
    make = scorer(share(docs, model))

    def keeper():
        score = make()
        return lambda texts: score(texts)["score"] < threshold

    return C.keep_rows(docs, "text", keeper)
