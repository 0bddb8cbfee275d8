"""Language ID by rank-order profiles (Cavnar and Trenkle).

Each language has a profile: its most frequent character 1- to 3-grams, in order. A
document's own most frequent n-grams are compared with every profile by the
out-of-place distance, the sum over its n-grams of how far each stands from its
place in the profile (a fixed largest distance if it isn't there). The nearest
language wins.

Profiles count the n-grams of all learnable documents, on the executors, and only
``profile_size`` rows per language reach the driver.

Defined results: null text or text without a letter is ``und`` with score 0; ties go
to the language first in order; without any learnable row everything is ``und``;
rows whose language is null are never learned from; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import score_rows, ship_by_value, small_batches

#: n-grams in a profile, and most frequent n-grams of a document that are compared.
PROFILE_SIZE = 400
UNKNOWN = "und"
#: Code points that Unicode has; the cube of their number fits 63 bits.
POINTS = 0x110000


def letter_table() -> np.ndarray:
    """Code point of the BMP -> itself for a letter, else 0."""
    t = np.zeros(0x10000, np.int64)
    for i in range(0x10000):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            t[i] = i
    return t


def letters(text: str, table: np.ndarray) -> np.ndarray:
    """Letter numbers of the lower-cased text, any other character 0, a 0 at both ends."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = cp >= 0x10000
    if wide.any():
        out = table[np.where(wide, 0, cp)]
        for c in np.unique(cp[wide]):
            if chr(c).isalpha():
                out[cp == c] = int(c)
    else:
        out = table[cp]
    zero = np.zeros(1, np.int64)
    return np.concatenate([zero, out, zero])


def gram_codes(c: np.ndarray) -> np.ndarray:
    """All 1- to 3-grams as sorted 64-bit codes, unlike for unlike n-grams. A separator stands at an n-gram's end only.

    Codes are numbers in base ``POINTS``, those of shorter n-grams above those of longer ones.
    """
    one = c[c > 0] + (POINTS**3 + POINTS**2)
    a, b = c[:-1], c[1:]
    two = (a * POINTS + b + POINTS**3)[(a > 0) | (b > 0)]
    x, y, z = c[:-2], c[1:-1], c[2:]
    three = ((x * POINTS + y) * POINTS + z)[y > 0]
    codes = np.concatenate([one, two, three])
    codes.sort()
    return codes


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[at], np.diff(np.r_[at, len(codes)])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): partial counts, one row per language and n-gram of a task."""
    ship_by_value()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(lang, []).append(letters(t, table))
            for lang, parts in texts.items():
                code, n = runs(gram_codes(np.concatenate(parts)))
                if lang in total:
                    code = np.concatenate([total[lang][0], code])
                    code, where = np.unique(code, return_inverse=True)
                    n = np.bincount(where, np.concatenate([total[lang][1], n])).astype(np.int64)
                total[lang] = code, n
        for lang, (code, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, code bigint, n bigint")


def fit_profiles(docs: DataFrame, learn: F.Column, size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """Language -> its ``size`` most frequent n-grams in order, over all learnable documents."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = gram_counts(known).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size)
    out: dict[str, list] = {}
    for lang, code in top.orderBy("lang", "r").select("lang", "code").toArrow().to_pandas().itertuples(index=False):
        out.setdefault(lang, []).append(code)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def predictor(ref, size: int):
    """Task side: whole texts -> nearest language and 1 minus its share of the largest distance."""

    def make():
        names, codes, ranks = ref.value
        table = letter_table()

        def predict(texts):
            langs, scores = [], []
            for t in texts:
                c = letters(t, table)
                if not names or not c.any():
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                code, n = runs(gram_codes(c))
                top = code[np.argsort(-n, kind="stable")[:size]]
                at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
                place = np.arange(len(top))[:, None]
                far = np.where((codes[at] == top)[:, None], np.abs(ranks[at] - place), size)
                dist = np.minimum(far, size).sum(0)
                best = int(dist.argmin())
                langs.append(names[best])
                scores.append(1.0 - float(dist[best]) / (size * len(top)))
            return {"lang_pred": langs, "score": scores}

        return predict

    return make


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE_SIZE) -> DataFrame:
    """(doc_id, lang_pred, score); only the text is looked at."""
    names = sorted(profiles)
    codes = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(codes), len(names)), 10 * size, np.int64)
    for j, k in enumerate(names):
        ranks[np.searchsorted(codes, profiles[k]), j] = np.arange(len(profiles[k]))
    ref = docs.sparkSession.sparkContext.broadcast((names, codes, ranks))  # size x languages numbers
    fields = {"lang_pred": pa.string(), "score": pa.float64()}
    return score_rows(docs.select("doc_id", "text"), "text", predictor(ref, size), fields, "lang_pred string, score double")
