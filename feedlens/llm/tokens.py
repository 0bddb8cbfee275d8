"""Token counts by overlap resynchronisation.

Short texts are encoded whole, in place. A huge text is cut, in Spark, into chunks
that overlap, and each chunk is encoded by itself with offsets, so one document's
chunks spread over many tasks. Neighbouring chunks are spliced at a boundary that
both encodings have and that is stable: a token that starts right after white space,
from which both give the same tokens up to the last white space that both see. Where
the overlap holds no such boundary, the document is cut again with an overlap four
times as wide, until it is one chunk.

White space ends every token, composes with nothing and is part of no special
string, so what follows it encodes alike wherever the chunk began. The same fact
lets the encoder remember the tokens of each blank-separated piece.

Defined results: null counts as the empty text (0 bytes, 0 tokens); repeated rows each
give a row, also of a huge text; rows are matched by a row key, not by doc_id, so null
or repeated ids do no harm; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import score_rows, ship_by_value, staged

#: Characters of a chunk and of the first overlap; texts longer than a chunk are cut.
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
#: Distinct pieces that an encoder remembers before it starts afresh, and the longest that it keeps.
CACHE_PIECES = 400_000
CACHE_CHARS = 64


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


#: Where a lower-case Latin letter meets marks that end its piece: tokens never reach across.
BEFORE_MARKS = re.compile("(?<=[a-zßà-öø-ÿ])(?=[.,;:!?]+(?:[ \n]|$))")
LATIN_WORD = re.compile("[a-zßà-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level BPE uses for each byte, for ``str.translate`` of Latin-1 text."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """Computes what it doesn't hold; forgets everything beyond ``most`` entries."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        got = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[key] = got
        return got


class PieceEncoder:
    """Ids of a whole text as little-endian 32-bit bytes, by the library, piece by piece.

    A text is cut at blanks and line ends where ``white_space_drops`` holds for the
    tokenizer; a Latin-1 text is lower-cased first and its words are cut from the marks
    after them where ``words_stand_alone`` does. Otherwise the library gets the whole
    text. What a piece encodes to is remembered.
    """

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.letters = byte_letters()
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces = Remembered(self.whole, CACHE_PIECES)
        self.words = Remembered(self.word, CACHE_PIECES)
        self.split = white_space_drops(self.tok)
        self.latin = self.split and self.words_stand_alone()

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, piece: str) -> bytes:
        """Ids of a lower-case Latin-1 piece; a plain word goes straight to the library's model."""
        if LATIN_WORD.fullmatch(piece) is None:
            return self.whole(piece)
        stand_in = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tok.model.tokenize(stand_in)]).tobytes()

    def words_stand_alone(self) -> bool:
        probe = ["Abc", "straße", "ÀÉÎõü", "qwxzy", "it's", "a.b"]
        marks = [".", "...", "!!", ",.", "?!:;"]
        return all(self.word(w.lower()) + self.whole(m) == self.whole(w + m) for w in probe for m in marks)

    def ids(self, text: str) -> bytes:
        if not self.split:
            return self.whole(text)
        if self.latin and is_latin1(text) and not any(s[:2] in text for s in self.specials):
            cut = BEFORE_MARKS.sub(" ", text.lower())
            return b"".join(map(self.words.__getitem__, cut.replace("\n", " ").split(" ")))
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


def shared_encoder(path: str) -> PieceEncoder:
    """The encoder of this worker process: what it remembers outlives a task where Spark uses workers again."""
    import sys
    import types

    held = sys.modules.setdefault("_feedlens_worker", types.ModuleType("_feedlens_worker")).__dict__.setdefault("encoders", {})
    if path not in held:
        held[path] = PieceEncoder(path)
    return held[path]


def is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def white_space_drops(tok) -> bool:
    """Whether blanks and line ends never reach a token and never change their neighbours."""
    probe = ["a", "b1", "c."]
    apart = [i for p in probe for i in tok.encode(p, add_special_tokens=False).ids]
    return all(tok.encode(s.join(probe), add_special_tokens=False).ids == apart for s in (" ", "\n", " \n ", "  "))


def count_short(docs: DataFrame, path: str) -> DataFrame:
    """(every column but text, n_tokens) of whole texts."""

    def make():
        enc = PieceEncoder(path)
        return lambda texts: {"n_tokens": [len(enc.ids(t)) // 4 for t in texts]}

    return score_rows(docs, "text", make, {"n_tokens": pa.int64()}, "n_tokens bigint")


def chunk_rows(long_docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, part, last, chunk): chunk ``part`` starts at part * chunk and runs ``overlap`` characters into the next."""
    ship_by_value()
    held = max(1, (4 << 20) // (chunk + overlap))  # chunks handed on at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                last = (len(text) - 1) // chunk
                for first in range(0, last + 1, held):
                    parts = range(first, min(last + 1, first + held))
                    cut = [text[p * chunk : p * chunk + chunk + overlap] for p in parts]
                    numbers = [pa.array(v, pa.int64()) for v in ([key] * len(cut), list(parts), [last] * len(cut))]
                    yield pa.RecordBatch.from_arrays([*numbers, pa.array(cut, pa.string())], names=["key", "part", "last", "chunk"])

    return long_docs.select("key", "text").mapInArrow(run, "key bigint, part bigint, last bigint, chunk string")


def boundaries(text: str, starts: np.ndarray) -> np.ndarray:
    """Which of the tokens that start at ``starts`` follow white space."""
    return np.fromiter((s == 0 or text[s - 1].isspace() for s in starts.tolist()), bool, len(starts))


def encode_chunks(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Each chunk's token count, and its stable boundaries in the first and the last ``overlap`` characters.

    ``head`` and ``tail`` list (absolute start, tokens of this chunk before it, hash of
    the tokens from there to the last white space of the overlap).
    """
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(path)
        for b in batches:
            out = {"key": [], "part": [], "last": [], "n": [], "head": [], "tail": []}
            for key, part, last, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                enc = tok.encode(text, add_special_tokens=False)
                starts = np.array([o[0] for o in enc.offsets], np.int64)
                ids = enc.ids

                def zone(lo: int, hi: int) -> list[dict]:
                    # tokens before the zone's last white space can't change with what follows
                    end = hi
                    while end > lo and not text[end - 1].isspace():
                        end -= 1
                    a, z = np.searchsorted(starts, [lo, end])
                    if a >= z:
                        return []
                    ok = boundaries(text, starts[a:z])
                    sums, h = [], 0
                    for i in range(z - 1, a - 1, -1):
                        h = (h * 1_000_003 + ids[i] * 65_599 + int(starts[i] - lo) + 1) & 0x7FFFFFFFFFFFFFFF
                        sums.append(h)
                    sums.reverse()
                    return [{"at": int(starts[a + i] + part * chunk), "n": int(a + i), "h": sums[i]} for i in np.flatnonzero(ok)]

                out["key"].append(key)
                out["part"].append(part)
                out["last"].append(last)
                out["n"].append(len(ids))
                out["head"].append([] if part == 0 else zone(0, min(overlap, len(text))))
                out["tail"].append([] if part == last else zone(chunk, len(text)))
            mark = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("h", pa.int64())]))
            kinds = [pa.int64()] * 4 + [mark, mark]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    mark = "array<struct<at: bigint, n: bigint, h: bigint>>"
    return chunks.mapInArrow(run, f"key bigint, part bigint, last bigint, n bigint, head {mark}, tail {mark}")


def splice(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens, ok): neighbours meet at the first boundary that both have with the same tokens after it."""
    nxt = encoded.select("key", (F.col("part") - 1).alias("part"), F.col("head").alias("next_head"))
    pair = encoded.join(nxt, ["key", "part"], "left")
    # a common boundary: same place, same tokens from there on
    common = F.expr(
        "get(filter(tail, t -> exists(next_head, x -> x.at = t.at and x.h = t.h)), 0)"
    )
    pair = pair.withColumn("meet", F.when(F.col("part") < F.col("last"), common))
    other = F.expr("get(filter(next_head, x -> x.at = meet.at), 0).n")
    # this chunk counts up to the boundary; the next one must leave out what it has before it
    own = F.when(F.col("part") == F.col("last"), F.col("n")).otherwise(F.col("meet.n") - other)
    return pair.groupBy("key").agg(F.sum(own).alias("n_tokens"), F.min(((F.col("part") == F.col("last")) | F.col("meet").isNotNull()).cast("int")).alias("ok"))


def count_long(long_docs: DataFrame, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, parts: int | None = None) -> DataFrame:
    """(key, n_tokens) of texts longer than a chunk. Each round repeats only what found no boundary."""
    left, done = long_docs, None
    while True:
        n = parts or left.sparkSession.sparkContext.defaultParallelism * 4
        spread = chunk_rows(left, chunk, overlap).repartition(n, "key", "part")
        got = staged(splice(encode_chunks(spread, path, chunk, overlap)), "splice")
        fine = got.where("ok = 1").select("key", "n_tokens")
        done = fine if done is None else done.unionByName(fine)
        bad = got.where("ok = 0")
        if bad.isEmpty():
            return done
        left = left.join(bad.select("key"), "key", "left_semi")
        overlap *= 4
        chunk = max(chunk, 2 * overlap)


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    is_long = F.length("text") > chunk
    short = count_short(rows.where(~is_long), path).select("doc_id", "n_bytes", "n_tokens")
    # the key is a row's place in the scan: unique, whatever the ids are
    big = staged(rows.where(is_long).withColumn("key", F.monotonically_increasing_id()), "long")
    if big.isEmpty():
        return short
    counted = count_long(big.select("key", "text"), path, chunk, overlap)
    long_rows = big.select("key", "doc_id", "n_bytes").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long_rows)
