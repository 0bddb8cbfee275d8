"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the masked-out positions are ignored, so
a substituted word there doesn't break the match. Test passages are hashed under
every mask; the documents' windows are hashed alike and joined with them. Each hit
names a document, a passage and an alignment; along it, words are compared one to one,
and the pair counts as an overlap where some window of 13 words (the whole passage,
if shorter) agrees in at least 80 % of them. The masks are lossless for that rule: any
two substitutions in 13 words leave one of the three a hit.

The benchmark is taken in blocks of a bounded number of words, so what a task holds
doesn't grow with it; every block meets all documents in one scan, without a shuffle.

Defined results: words are runs of letters and digits, lower-cased, but each letter of a
script written without blanks (Han, kana, Thai, ..) is a word; passages of fewer than 5
words, such a letter counted as half a word, match only where the document holds all
their words in a row; passages without a word (and null ones) match nothing; equal
passages are searched as one, under their smallest item_id, and given for each of them; null texts have no words; repeated rows
and null ids of documents each give their own rows; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.report import skew_safe_join
from .common import keep_rows, ship_by_value, small_batches, staged

MASKS = ("11101011", "111010011", "1100110101")
WINDOW = 13
AGREE = 0.8
#: Passages of fewer words match without substitutions only.
LEAST_WORDS = 5
#: Words of the benchmark that a task holds at a time.
BLOCK_WORDS = 400_000

#: Letters and marks of scripts without blanks between words: Han, bopomofo, kana, Yi, Thai, Lao, Myanmar, Khmer, Tai, Javanese, Balinese.
UNSPACED = (
    "\u3005-\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003fffd\u3105-\u312f\u31a0-\u31bf"
    "\u3041-\u3096\u3099\u309a\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\uff66-\uff9f\U0001b000-\U0001b16f\ua000-\ua48c"
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u109a-\u109d\ua9e0-\ua9ef\ua9fa-\ua9fe\uaa60-\uaa76\uaa7a-\uaa7f"
    "\u1780-\u17d3\u17d7\u17dc\u17dd\u1950-\u1974\u1980-\u19c9\u1a20-\u1a7c\uaa80-\uaac2\uaadb-\uaadd\ua980-\ua9c0\u1b00-\u1b4c"
)
WORD = re.compile(rf"[^\W_{UNSPACED}]+|[{UNSPACED}]")
LONE = re.compile(rf"[{UNSPACED}]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def whole_only(words: list[str]) -> bool:
    """Whether a passage is too short to be told from chance once a word of it differs."""
    return len(words) - sum(LONE.match(w) is not None for w in words) / 2 < LEAST_WORDS


def mask_offsets(lengths: set[int]) -> list[tuple[tuple[int, ...], int | None]]:
    """(positions that count, length of the passages that the mask is for; None: any of 13 words or more).

    A shorter passage of n words may differ in e of them; its mask takes every (e + 1)-th
    word, so any e substitutions leave one of the mask's places within it whole.
    """
    fixed = [(tuple(i for i, c in enumerate(m) if c == "1"), None) for m in MASKS]
    short = []
    for n in sorted(x for x in lengths if x < WINDOW):
        step = n - math.ceil(AGREE * n - 1e-9) + 1
        short.append((tuple(range(0, step * (n // step), step)), n))
    return fixed + short


def seed_hashes(ids: np.ndarray, offsets: tuple[int, ...], which: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, hashes) of the windows whose counted words are all known (id > 0)."""
    span = offsets[-1] + 1
    n = len(ids) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids > 0
    ok = known[:n].copy()
    for o in offsets[1:]:
        ok &= known[o : o + n]
    at = np.flatnonzero(ok)
    h = np.full(len(at), which + 1, np.uint64)
    with np.errstate(over="ignore"):
        for o in offsets:
            h = (h ^ ids[at + o].astype(np.uint64)) * MIX
            h ^= h >> np.uint64(29)
    return at, h


class TestIndex:
    """Seed hashes of one block of passages; plain arrays, so that it can be broadcast."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocabulary: dict[str, int] = {}
        self.item_ids = [i for i, _ in items]
        coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64) for _, words in items]
        self.length = np.array([len(c) for c in coded], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.codes = np.concatenate(coded) if coded else np.zeros(0, np.int64)
        whole = [whole_only(words) for _, words in items]
        masks = [(*m, False) for m in mask_offsets({len(c) for c, w in zip(coded, whole) if not w})]
        masks += [(tuple(range(n)), n, True) for n in sorted({len(c) for c, w in zip(coded, whole) if w})]
        self.offsets = [m for m, _, _ in masks]
        self.whole = [w for _, _, w in masks]
        hashes, item, place = [], [], []
        for which, (offsets, length, w) in enumerate(masks):
            for k, c in enumerate(coded):
                if whole[k] != w or (len(c) != length if length else len(c) < WINDOW):
                    continue
                at, h = seed_hashes(c, offsets, which)
                hashes.append(h)
                item.append(np.full(len(at), k))
                place.append(at)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order].astype(np.int64)
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order].astype(np.int64)

    def plain(self) -> dict:
        return dict(self.__dict__)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW, agree: float = AGREE) -> tuple[int, int, int] | None:
    """(first, end, equal words) in the passage of what agrees along one alignment, or None.

    ``shift``: place in the document of the passage's first word (may lie outside).
    """
    n = len(item)
    lo, hi = max(0, -shift), min(n, len(doc) - shift)
    w = min(window, n)
    if hi - lo < w:
        return None
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[w:] - sums[:-w] >= agree * w - 1e-9)
    if not len(good):
        return None
    first, end = int(good[0]), int(good[-1]) + w
    return lo + first, lo + end, int(sums[end] - sums[first])


def find_overlaps(texts: list, index: dict) -> list[tuple[int, int, int, int, int, int]]:
    """(row of the text, row of the passage, document start, passage start, length, equal words), one per pair:
    its alignment of most equal words."""
    get = index["vocabulary"].get
    coded = [np.array([get(w, 0) for w in words_of(t)], np.int64) for t in texts]
    size = np.array([len(c) for c in coded], np.int64)
    # one zero between documents, so no window crosses
    start = np.cumsum(size + 1) - (size + 1)
    flat = np.zeros(int((size + 1).sum()), np.int64)
    for c, s in zip(coded, start):
        flat[s : s + len(c)] = c
    found = []
    best: dict[tuple[int, int], tuple] = {}
    for which, offsets in enumerate(index["offsets"]):
        at, h = seed_hashes(flat, offsets, which)
        lo, hi = np.searchsorted(index["hash"], h, "left"), np.searchsorted(index["hash"], h, "right")
        n = hi - lo
        hit = np.flatnonzero(n)
        if not len(hit):
            continue
        n, lo, at = n[hit], lo[hit], at[hit]
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        row = np.searchsorted(start, at, "right") - 1
        if index["whole"][which]:
            # every word counts, and all places are equally good: the first one is given
            k, n = index["item"][entry], len(offsets)
            same = np.all([flat[at + o] == index["codes"][index["start"][k] + o] for o in offsets], 0)
            row, k, shift = row[same], k[same], (at - start[row])[same]
            for i in np.unique(np.stack([row, k], 1), axis=0, return_index=True)[1].tolist():
                best[int(row[i]), int(k[i])] = int(row[i]), int(k[i]), int(shift[i]), 0, n, n
            continue
        found.append(np.stack([row, index["item"][entry], at - start[row] - index["place"][entry]], 1))
    for row, k, shift in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
        s = index["start"][k]
        got = overlap(coded[row], index["codes"][s : s + index["length"][k]], shift)
        if got and ((row, k) not in best or got[2] > best[row, k][4]):
            best[row, k] = row, k, shift + got[0], got[0], got[1] - got[0], got[2]
    return list(best.values())


def test_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[dict]:
    """Indexes over blocks of the distinct passages, each of about ``block_words`` words."""
    items = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id"))
    lone = F.length(F.regexp_replace("text", f"[^{UNSPACED}]", ""))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")) + lone)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        rows = [(i, w) for i, t in zip(part["item_id"].to_pylist(), part["text"].to_pylist()) if (w := words_of(t))]
        if rows:
            yield TestIndex(rows).plain()


OVERLAP_DDL = "doc_start bigint, item_start bigint, length bigint, matched bigint"


def with_equal_items(found: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pairs of every passage that stands for others of equal text, given for those, too."""
    equal = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id"), F.sort_array(F.collect_set("item_id")).alias("_items"))
    equal = staged(equal.where(F.size("_items") > 1).select("item_id", "_items"), "equal-items")
    if equal.isEmpty():
        return found
    # one passage may be hit by a large share of all documents: the join splits hot keys
    found = staged(found, "overlaps")
    more = skew_safe_join(found, equal, ["item_id"])
    more = more.withColumn("_item", F.explode("_items")).where(F.col("_item") != F.col("item_id"))
    return found.unionByName(more.withColumn("item_id", F.col("_item")).select(found.columns))


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, length, matched): one row per document and passage that overlap."""
    ship_by_value()
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("doc_id", docs), ("item_id", benchmark))]
    ddl = ", ".join([*kinds, OVERLAP_DDL])
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for index in test_blocks(benchmark, block_words):
        ref = spark.sparkContext.broadcast(index)  # at most block_words words (one passage at least)

        def run(batches: Iterator[pa.RecordBatch], ref=ref) -> Iterator[pa.RecordBatch]:
            index = ref.value
            for b in batches:
                found = find_overlaps(b.column(1).to_pylist(), index)
                cols = list(zip(*found)) if found else [[]] * 6
                ids = b.column(0).take(pa.array(cols[0], pa.int64()))
                items = pa.array([index["item_ids"][k] for k in cols[1]], item_type)
                yield pa.RecordBatch.from_arrays([ids, items, *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "item_id", "doc_start", "item_start", "length", "matched"])

        part = docs.select("doc_id", "text").mapInArrow(run, ddl)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], ddl)
    return with_equal_items(out, benchmark)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that overlap with no passage, all columns unchanged."""
    for index in test_blocks(benchmark, block_words):
        ref = docs.sparkSession.sparkContext.broadcast(index)

        def keeper(ref=ref):
            index = ref.value

            def keep(texts):
                mask = np.ones(len(texts), bool)
                mask[[f[0] for f in find_overlaps(texts, index)]] = False
                return mask

            return keep

        docs = keep_rows(docs, "text", keeper)
    return docs
