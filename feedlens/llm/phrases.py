"""Phrase collocations by Rabin-Karp fingerprints.

A task splits its texts into words, gives each word a 64-bit hash and sums prefix polynomials
over them, so the fingerprint of any n-gram is one subtraction and one product of numpy
arrays. Inside a scan n-grams are told apart exactly, by word numbers. What is shuffled is
a fingerprint, its count, a pointer to a document that holds the n-gram, and a check: some bits
of a hash of another kind. They travel as arrays, one row per scan and bucket of fingerprints. A bucket's task adds
up the counts per fingerprint and keeps one pointer. Only fingerprints that reach ``least`` go on.

Their pointers are followed into the texts, and only there phrases are written out. Where the checks
of a fingerprint differ, unlike phrases share it: such fingerprints are counted once more over all texts, by
their words, and each of their phrases is kept or dropped by its own count. (Two n-grams would have to agree in
64 bits of one hash and 31 of the other to go unnoticed.)

Lengths are counted one after the other. An n-gram can be frequent only if both its (n-1)-grams are,
so a bitmap of their frequent fingerprints (``BITMAP_BITS``, a fixed size) is broadcast and lets a task leave
others out. A wrong hit in the bitmap costs a row, never a result; a full one only saves nothing.

Defined results: a null text has no words; a null language is ``und``; all words of a long text count
(it is scanned in parts cut between pieces); repeated rows and ids count as rows; an empty table has no
phrases; other columns are ignored. Counts may reach 10 ** 15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.report import skew_safe_join
from .bytescan import Window as TextWindow
from .bytescan import runs, windows
from .common import ship_by_value, small_batches, staged

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Bits of the filter of frequent fingerprints: 8 MB, whatever the corpus.
BITMAP_BITS = 1 << 26

LETTER_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2 ** 64
WORD_BASE = 0xD1342543DE82EF95
CHECK_BASE = 0xA0761D6478BD642F
#: Bytes of text per scan; an n-gram is one entry per scan.
SCAN_BYTES = 4 << 20

#: Arrays of equal length; a check of -1 marks the number of all words of a language.
GRAM_DDL = "bucket int, fp array<bigint>, row array<bigint>, cnt array<bigint>, check array<int>"
#: Bytes of text whose entries one bucket takes, and buckets at most.
BUCKET_BYTES = 8 << 20
MAX_BUCKETS = 1 << 16
#: Fingerprints of unlike phrases that one scan looks for.
SHARED_AT_ONCE = 1 << 20


def prefix_sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomials sum(values[j] * base^j) modulo 2^64, and base^-i to shift a slice back."""
    n = len(values)
    up, down = np.full(n, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    if n:
        up[0] = 1
    down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return sums, down


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a window: places, exact numbers, piece and language of each, prefix polynomials."""

    def __init__(self, w: TextWindow):
        import xxhash

        lower = w.data.lower()  # bytes: A-Z only
        a = np.frombuffer(lower, np.uint8)
        kind = np.zeros(256, np.uint8)
        kind[list(BLANKS)], kind[list(BREAKS)] = 1, 2
        kinds = kind[a]
        inside = kinds == 0
        self.start, self.end = runs(inside)
        self.piece = np.cumsum(kinds == 2, dtype=np.int32)[self.start]
        off = np.zeros(len(self.start) + 1, np.int32)
        np.cumsum(self.end - self.start, out=off[1:])
        letters = a[inside]
        words = pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(off), pa.py_buffer(letters)]).dictionary_encode()
        self.word = words.indices.to_numpy()
        known = words.dictionary
        spots = np.concatenate([[0], np.cumsum(np.fromiter(map(len, known.to_pylist()), np.int64, len(known)))])
        sums, down = prefix_sums(np.frombuffer(b"".join(known.to_pylist()), np.uint8).astype(np.uint64) + np.uint64(1), LETTER_BASE)
        hashes = mixed((sums[spots[1:]] - sums[spots[:-1]]) * down[spots[:-1]])
        self.sums, self.down = prefix_sums(hashes[self.word], WORD_BASE)
        self.checks = np.fromiter(map(xxhash.xxh64_intdigest, known.to_pylist()), np.uint64, len(known))
        # owner of a part: (row, language); a language's number is its place among the window's
        langs = sorted({o[1] for o in w.owner})
        number = {x: i for i, x in enumerate(langs)}
        per_part = np.diff(np.concatenate([np.searchsorted(self.start, w.first), [len(self.start)]]))
        self.lang = np.repeat(np.array([number[o[1]] for o in w.owner], np.int32), per_part)
        self.lang_names = langs
        self.lang_hash = np.array([text_hash(x) for x in langs], np.uint64)

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of the n-gram at every word, and whether it lies within a piece."""
        count = max(0, len(self.word) - n + 1)
        raw = (self.sums[n : n + count] - self.sums[:count]) * self.down[:count]
        whole = self.piece[:count] == self.piece[n - 1 : n - 1 + count]
        return mixed(raw + self.lang_hash[self.lang[:count]] * np.uint64(LETTER_BASE) + np.uint64(n)), whole

    def grams(self, n: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, fingerprints, counts) of the window's distinct n-grams; ``known`` is the bitmap of n-1."""
        fp, whole = self.fingerprints(n)
        if known is not None:
            shorter, _ = self.fingerprints(n - 1)
            hit = in_bitmap(known, shorter)
            whole &= hit[:-1][: len(whole)] & hit[1:][: len(whole)]
        at = np.flatnonzero(whole)
        fp = fp[at]
        order = np.argsort(fp)
        at, fp = at[order], fp[order]
        exact = [self.lang[at], *(self.word[at + k] for k in range(n))]
        equal = fp[1:] == fp[:-1]
        same = np.logical_and.reduce([x[1:] == x[:-1] for x in exact]) if len(at) else equal
        if (equal & ~same).any():  # unlike n-grams of one fingerprint: order them by their words as well
            order = np.lexsort([*exact, fp])
            at, fp, exact = at[order], fp[order], [x[order] for x in exact]
            same = np.logical_and.reduce([x[1:] == x[:-1] for x in exact])
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(at) else np.zeros(0, np.int64)
        return at[first], fp[first], np.diff(np.concatenate([first, [len(at)]]))

    def check(self, at: np.ndarray, n: int) -> np.ndarray:
        """31 bits of a hash of the n-grams at words ``at`` that has nothing in common with the fingerprint."""
        total = np.zeros(len(at), np.uint64)
        for k in range(n):
            total = total * np.uint64(CHECK_BASE) + self.checks[self.word[at + k]]
        return (total >> np.uint64(33)).astype(np.int32)

    def text(self, data: bytes, at: int, n: int) -> bytes:
        """The n-gram at a word, lower-cased and set apart by one blank."""
        return b" ".join(data[s:e].lower() for s, e in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist()))


def in_bitmap(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether the bit of each fingerprint is set in a bitmap of 64-bit words."""
    at = fp & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def text_windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[TextWindow]:
    def texts():
        for b in batches:
            for row, lang, text in zip(*(c.to_pylist() for c in (b.column(0), b.column(1), b.column(2).cast(pa.binary())))):
                if text:
                    yield (row, lang), text

    return windows(texts(), BREAKS, size)


def count_grams(docs: DataFrame, n: int, known, size: int, buckets: int) -> DataFrame:
    """Fingerprint, pointer, count and check of each distinct n-gram of a scan; with n = 1 also each language's words."""
    ship_by_value()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if known is None else known.value
        for w in text_windows(batches, size):
            words = Words(w)
            at, fp, cnt = words.grams(n, bits)
            rows = np.array([o[0] for o in w.owner], np.int64)
            cols = [fp, rows[w.part_of(words.start[at])], cnt, words.check(at, n)]
            if n == 1:
                total = np.bincount(words.lang, minlength=len(words.lang_names))
                owner = {o[1]: o[0] for o in w.owner}
                more = [words.lang_hash, np.array([owner[x] for x in words.lang_names], np.int64), total, np.full(len(total), -1, np.int32)]
                cols = [np.concatenate([c, m[total > 0]]) for c, m in zip(cols, more)]
            # the upper bits of a fingerprint are its bucket, and entries come sorted by fingerprint
            to = ((cols[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            to, cols = to[order], [c[order] for c in cols]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            offsets = pa.array(np.append(first, len(to)), pa.int32())
            cols[0] = cols[0].view(np.int64)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(to[first]), *lists], names=["bucket", "fp", "row", "cnt", "check"])

    return docs.mapInArrow(run, GRAM_DDL)


def frequent(grams: DataFrame, least: int) -> DataFrame:
    """(fp, total, cnt, row, check, shared): fingerprints that reach ``least``, and the totals of languages (``total``).

    A bucket holds one entry of a fingerprint per scan, so no fingerprint makes it large.
    """

    def run(group: pa.Table) -> pa.Table:
        fp, row, cnt, check = (group[c].combine_chunks().flatten().to_numpy() for c in ("fp", "row", "cnt", "check"))
        out = []
        for total in (False, True):
            at = np.flatnonzero((check < 0) == total)
            at = at[np.argsort(fp[at])]
            key = fp[at]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
            if len(first):
                low, high = np.minimum.reduceat(check[at], first), np.maximum.reduceat(check[at], first)
                sums = np.add.reduceat(cnt[at], first)
                go = np.flatnonzero((sums >= least) | total)
                one = [key[first], np.full(len(first), total), sums, np.minimum.reduceat(row[at], first), low.astype(np.int64), low != high]
                out.append([c[go] for c in one])
        names = ["fp", "total", "cnt", "row", "check", "shared"]
        kinds = [np.int64, bool, np.int64, np.int64, np.int64, bool]
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, k) for k in kinds]
        return pa.table(dict(zip(names, cols)))

    return grams.groupBy("bucket").applyInArrow(run, "fp bigint, total boolean, cnt bigint, row bigint, check bigint, shared boolean")


def bitmap_of(pointers: DataFrame, bits: int) -> np.ndarray:
    """The fingerprints' bitmap; at most ``bits / 64`` rows reach the driver."""
    at = F.col("fp").bitwiseAND(F.lit(bits - 1))
    words = pointers.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast((fp & {bits - 1}) & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.view(np.uint64)


PHRASE = {"fp": pa.int64(), "lang": pa.string(), "n": pa.int32(), "phrase": pa.string(), "cnt": pa.int64()}
PHRASE_DDL = "fp bigint, lang string, n int, phrase string, cnt bigint"


def phrase_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(PHRASE)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PHRASE.values())], names=list(PHRASE))


def pointed_at(docs: DataFrame, pointers: DataFrame, bits: int) -> DataFrame:
    """The documents that some pointer names (and a few more): a bitmap keeps the texts of others out of the shuffle.

    A pointer is the smallest row that holds the phrase, so pointers gather in few documents.
    """
    known = docs.sparkSession.sparkContext.broadcast(bitmap_of(pointers.select(F.xxhash64("row").alias("fp")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = in_bitmap(known.value, b.column(3).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(hit)) for k in range(3)], names=["row", "lang", "text"])

    return docs.select("row", "lang", "text", F.xxhash64("row").alias("h")).mapInArrow(run, "row bigint, lang string, text string")


def followed(docs: DataFrame, pointers: DataFrame, size: int, bits: int) -> DataFrame:
    """(fp, lang, n, phrase, cnt): every pointer followed into its document's text.

    The document is hashed again to find the fingerprint, so a pointer is a row number, and a list of
    pointers has at most ``max_words`` entries for each word of its document.
    """
    ship_by_value()
    small_batches(docs.sparkSession)
    per_row = pointers.groupBy("row").agg(F.collect_list(F.struct("fp", "check", "cnt", "n")).alias("found"))
    joined = pointed_at(docs, pointers, bits).join(per_row, "row").select("lang", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts():
            for b in batches:
                for lang, text, found in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2)):
                    flat = found.values
                    yield (None, lang, [flat.field(k).to_numpy() for k in range(4)]), text

        for w in windows(texts(), BREAKS, size):
            rows: list[tuple] = []
            fp, check, cnt, n = (np.concatenate([o[2][k] for o in w.owner]) for k in range(4))
            lang = np.repeat(np.arange(len(w.owner)), [len(o[2][0]) for o in w.owner])
            for k in np.flatnonzero(n == 0).tolist():
                rows.append((int(fp[k]), w.owner[lang[k]][1], 0, "", int(cnt[k])))
            words = Words(w)
            for m in np.unique(n[n > 0]).tolist():
                wanted = np.flatnonzero(n == m)
                wanted = wanted[np.argsort(fp[wanted].view(np.uint64))]
                keys = fp[wanted].view(np.uint64)
                have, whole = words.fingerprints(m)
                at = np.flatnonzero(whole)
                place = np.minimum(np.searchsorted(keys, have[at]), len(keys) - 1)
                hit = keys[place] == have[at]
                at, place = at[hit], place[hit]
                good = words.check(at, m) == check[wanted[place]]
                at, place = at[good], place[good]
                first = np.unique(place, return_index=True)[1]
                for a, k in zip(at[first].tolist(), wanted[place[first]].tolist()):
                    rows.append((int(fp[k]), words.lang_names[words.lang[a]], m, words.text(w.data, a, m).decode(), int(cnt[k])))
            yield phrase_batch(rows)

    # a long text is scanned in parts and may give a phrase from several of them
    return joined.mapInArrow(run, PHRASE_DDL).groupBy("fp", "n").agg(F.min(F.struct("lang", "phrase", "cnt")).alias("p")).select("p.lang", "n", "p.phrase", F.col("p.cnt").alias("f"))


def counted_by_words(docs: DataFrame, fps: np.ndarray, n: int, size: int) -> DataFrame:
    """(lang, n, phrase, f): exact counts of the phrases of given fingerprints, over all texts."""
    ref = docs.sparkSession.sparkContext.broadcast(np.sort(fps))  # SHARED_AT_ONCE numbers at most
    ship_by_value()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ref.value.view(np.int64)
        for w in text_windows(batches, size):
            words = Words(w)
            at, fp, cnt = words.grams(n, None)
            hit = np.flatnonzero(np.isin(fp.view(np.int64), keys))
            yield phrase_batch([
                (0, words.lang_names[words.lang[a]], n, words.text(w.data, a, n).decode(), c) for a, c in zip(at[hit].tolist(), cnt[hit].tolist())
            ])

    return docs.mapInArrow(run, PHRASE_DDL).groupBy("lang", "n", "phrase").agg(F.sum("cnt").alias("f"))


def phrase_counts(docs: DataFrame, max_words: int = 3, least: int = 10, bits: int = BITMAP_BITS, size: int = SCAN_BYTES) -> DataFrame:
    """(lang, n, phrase, f): every phrase of 1 to ``max_words`` words with f >= ``least``, exactly counted per language.

    With n = 0 and an empty phrase: all words of the language.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    rows = staged(rows.select(F.monotonically_increasing_id().alias("row"), "lang", "text"), "phrase-texts")
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = min(MAX_BUCKETS, 1 + n_bytes // BUCKET_BYTES)
    found, again, known = [], [], None
    for n in range(1, max_words + 1):
        kept = staged(frequent(count_grams(rows, n, known, size, buckets), least), "frequent")
        found.append(kept.where("not shared").withColumn("n", F.when(F.col("total"), 0).otherwise(n)))
        shared = kept.where("shared").select("fp")
        slices = -(-shared.count() // SHARED_AT_ONCE)
        for k in range(slices):
            part = shared.where(F.pmod(F.xxhash64("fp"), F.lit(slices)) == k).toArrow()["fp"].to_numpy()
            again.append(counted_by_words(rows, part, n, size).where(F.col("f") >= least))
        if n < max_words:
            if known is not None:
                known.unpersist()
            known = docs.sparkSession.sparkContext.broadcast(bitmap_of(kept.where("not total"), bits))
    pointers = found[0]
    for k in found[1:]:
        pointers = pointers.unionByName(k)
    out = followed(rows, pointers, size, bits)
    for more in again:
        out = out.unionByName(more)
    return staged(out, "phrases")


def words_between(words: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


SCORE = """(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0)))
           div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"""


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, cover_pct: int = 50, bits: int = BITMAP_BITS, size: int = SCAN_BYTES) -> DataFrame:
    """Every surviving phrase: lang, phrase, a, l, r, score, n.

    The cut with the lowest score counts, the earliest of equal ones. A phrase goes where a longer candidate holds
    its words and has ``cover_pct`` percent of its count or more.
    """
    counts = phrase_counts(docs, max_words, least, bits, size)
    words = F.split("phrase", " ")
    cand = counts.where("n >= 2").select("lang", "n", "phrase", F.col("f").alias("a"), words.alias("w"))

    # both parts of every cut, looked up in one join; a common word is a part of many phrases, so hot parts are salted
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), words_between(F.col("w"), F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), words_between(F.col("w"), F.col("k") + 1, F.col("n") - F.col("k")).alias("part")),
    )
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.*")
    looked = skew_safe_join(sides, counts.where("n >= 1").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    cut = looked.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    best = cut.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    # the largest count of the longer candidates that hold a phrase
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: words_between(F.col("w"), i, m))))
    longer = cand.where("n >= 3").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * cover_pct))
    totals = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    return skew_safe_join(staged(left.select("lang", "phrase", "a", "b.l", "b.r", "b.score"), "scored"), totals, ["lang"])


def top_collocations(found: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's ``most`` best phrases with their rank; Spark keeps ``most`` of a task before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
