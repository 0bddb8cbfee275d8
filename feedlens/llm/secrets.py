"""Secret scans: known shapes, and a battery of randomness tests for everything else.

Base spans are strings of three known shapes (assignments, access keys, hex). Beside them every
run of ``[A-Za-z0-9+/_-]`` of ``LEAST`` characters or more is a candidate. Its encoding is the smallest
of ``ENCODINGS`` that holds all its characters. Three tests look at the numbers of its characters:

* chi-squared: how often two places hold the same character, which is Pearson's statistic against a
  uniform alphabet up to a linear map, with its exact mean and variance;
* runs: changes between the lower and the upper half of the alphabet;
* serial correlation of neighbours.

Each test is taken against two models. Against uniform random characters none may reject (``ALPHA``, Bonferroni).
Against ordinary strings the three must together reject: ordinary strings have the character frequencies, half
changes and correlation of all the corpus' shorter runs of the same encoding. The tests are combined by
Stouffer's method; a test weighs as much as it can tell random from ordinary strings of that length and encoding.
The p-values against ordinary strings then pass a false-discovery control that is aware of length: a short
string proves little, so each encoding and band of lengths is a family of its own, with a
Benjamini-Yekutieli threshold (valid under dependence) from the histogram of the family's p-values over the whole corpus.

One task scans texts in windows of bytes; a text is cut only at bytes that no span can hold. What is kept is
one row per document, its base spans and its candidates' three numbers; the text is read once.

Defined results: a null text is empty and has no spans; every row gives one row, also rows of null or repeated
ids; an empty table gives none; offsets are code points, ends exclusive; candidates inside a base span are not
given again; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Window, byte_class, runs, windows
from .common import ship_by_value, small_batches, staged

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
#: Every assignment holds one of these, so texts without any are not searched.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
LEAST_ASSIGN, LEAST_HEX = 12, 16
#: Bytes at which a text may be cut: no span holds one.
CUTS = b"\n\r\t,;!?()"

#: Shortest candidate, and shortest run that teaches what ordinary strings look like.
LEAST, LEAST_ORDINARY = 16, 4
LOW, UP, NUM = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: Alphabets in the order of their symbols' numbers, smaller ones first.
ENCODINGS = {
    "decimal": NUM, "hex": NUM + LOW[:6], "HEX": NUM + UP[:6], "base32": UP + b"234567", "lower36": NUM + LOW, "upper36": NUM + UP,
    "base62": UP + LOW + NUM, "base64": UP + LOW + NUM + b"+/", "base64url": UP + LOW + NUM + b"-_", "other": UP + LOW + NUM + b"+/-_",
}
SIZES = np.array([len(a) for a in ENCODINGS.values()])
#: First lengths of the bands that are families of their own.
BANDS = np.array([16, 24, 32, 48, 96])
#: A candidate goes where a test rejects randomness at this level; expected share of ordinary strings among what is given.
ALPHA, FDR = 0.001, 0.01
#: p-values are counted in steps of a twentieth of a decade, down to 10 ** -30.
STEP, LAST_BIN = 0.05, 600
#: Fewer neighbouring pairs than this teach nothing about an encoding: it takes what all encodings teach.
LEAST_PAIRS = 1000

_NUMBER = np.zeros((len(ENCODINGS), 256), np.int64)
_HELD = np.zeros(256, np.uint16)
for _e, _letters in enumerate(ENCODINGS.values()):
    _NUMBER[_e, list(_letters)] = np.arange(len(_letters))
    _HELD[list(_letters)] |= np.uint16(1 << _e)
IN_RUN = byte_class(ENCODINGS["other"])
IN_HEX = byte_class(ENCODINGS["hex"])

SCAN = {
    "base": pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])),
    "cand": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("enc", pa.int32()), ("same", pa.int64()), ("changes", pa.int64()), ("corr", pa.float64())])),
    "stat": pa.list_(pa.int64()),
}
SCAN_DDL = (
    "base array<struct<start:bigint,kind:int,end:bigint>>, "
    "cand array<struct<start:bigint,end:bigint,enc:int,same:bigint,changes:bigint,corr:double>>, stat array<bigint>"
)
#: Sums per encoding: 256 character counts, pairs, half changes, sums of x, y, xx, yy, xy.
WIDTH = 256 + 7


def infer(a: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Number of the smallest encoding that holds all characters of each run; runs follow one another in ``a``."""
    held = np.bitwise_and.reduceat(_HELD[a], start) if len(start) else np.zeros(0, np.uint16)
    bits = held[:, None] >> np.arange(len(ENCODINGS), dtype=np.uint16) & 1
    return bits.argmax(axis=1)


def joined_runs(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs' bytes one after the other, and where each begins."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    return a[np.repeat(start - first, size) + np.arange(int(size.sum()))], first


def ordinary_sums(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per encoding the sums over runs that the model of ordinary strings needs (integers, so they add up exactly)."""
    out = np.zeros((len(ENCODINGS), WIDTH), np.int64)
    if not len(start):
        return out
    letters, first = joined_runs(a, start, end)
    enc = np.repeat(infer(letters, first), end - start)
    out[:, :256] = np.bincount(enc * 256 + letters, minlength=len(ENCODINGS) * 256).reshape(-1, 256)
    pair = np.ones(len(letters), bool)
    pair[first] = False
    second = np.flatnonzero(pair)
    e = enc[second]
    x, y = _NUMBER[e, letters[second - 1]], _NUMBER[e, letters[second]]
    change = (2 * x >= SIZES[e]) != (2 * y >= SIZES[e])
    for k, v in enumerate((np.ones_like(x), change, x, y, x * x, y * y, x * y)):
        out[:, 256 + k] = np.bincount(e, v, minlength=len(ENCODINGS)).astype(np.int64)
    return out


def statistics(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per candidate: encoding, pairs of equal characters, half changes, serial correlation."""
    outs = []
    for k in range(0, len(start), 4096):
        s, t = start[k : k + 4096], end[k : k + 4096]
        letters, first = joined_runs(a, s, t)
        n = t - s
        enc = infer(letters, first)
        run = np.repeat(np.arange(len(s)), n)
        x = _NUMBER[enc[run], letters]
        counts = np.bincount(run * 128 + x, minlength=len(s) * 128).reshape(-1, 128)
        same = (counts * (counts - 1) // 2).sum(axis=1)
        second = np.ones(len(letters), bool)
        second[first] = False
        second = np.flatnonzero(second)
        high = 2 * x >= SIZES[enc[run]]
        changes = np.bincount(run[second], high[second] != high[second - 1], minlength=len(s)).astype(np.int64)
        d = x - (np.add.reduceat(x, first) / n)[run]
        spread = np.add.reduceat(d * d, first)
        corr = np.bincount(run[second], d[second] * d[second - 1], minlength=len(s)) / np.where(spread > 0, spread, 1)
        outs.append((enc, same, changes, np.where(spread > 0, corr, 1.0)))
    if not outs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*outs))


def base_spans(data: bytes, a: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the window, leftmost and non-overlapping per kind."""
    out = []
    low = data.lower()
    if any(x in low for x in ASSIGN_WORDS):
        out += [(*m.span(2), 0) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(*m.span(), 1) for m in ACCESS.finditer(data)]
    s, e = runs(IN_HEX[a])
    keep = e - s >= LEAST_HEX
    out += [(x, y, 2) for x, y in zip(s[keep].tolist(), e[keep].tolist())]
    return sorted((s, k, e) for s, e, k in out)


def scan_window(w: Window, chars_before: dict[int, int]) -> tuple[dict[int, tuple[list, list]], np.ndarray]:
    """Base spans and candidates of every document in the window, in code points; ordinary sums.

    ``chars_before`` has the characters of each document's earlier windows and is brought up to date.
    """
    a = np.frombuffer(w.data, np.uint8)
    chars = np.zeros(len(a) + 1, np.int64)
    np.cumsum((a & 0xC0) != 0x80, out=chars[1:])
    offset = np.zeros(len(w.owner), np.int64)  # added to a window place in characters: place in the text
    ends = np.concatenate([w.first[1:], [len(a)]]) - 1
    for p, (doc, _) in enumerate(w.owner):
        seen = chars_before.get(doc, 0)
        offset[p] = seen - chars[w.first[p]]
        chars_before[doc] = seen + int(chars[ends[p]] - chars[w.first[p]])
    found: dict[int, tuple[list, list]] = {doc: ([], []) for doc, _ in w.owner}

    base = base_spans(w.data, a)
    if base:
        s, k, e = (np.array(c, np.int64) for c in zip(*base))
        part = w.part_of(s)
        for p, x, kind, y in zip(part.tolist(), (chars[s] + offset[part]).tolist(), k.tolist(), (chars[e] + offset[part]).tolist()):
            found[w.owner[p][0]][0].append((x, kind, y))
    start, end = runs(IN_RUN[a])
    size = end - start
    short = (size >= LEAST_ORDINARY) & (size < LEAST)
    sums = ordinary_sums(a, start[short], end[short])
    long = size >= LEAST
    start, end = start[long], end[long]
    if base and len(start):  # not again what a base span holds
        reach = np.maximum.accumulate(e)
        before = np.searchsorted(s, start, side="right") - 1
        inside = (before >= 0) & (reach[before] >= end)
        start, end = start[~inside], end[~inside]
    enc, same, changes, corr = statistics(a, start, end)
    part = w.part_of(start)
    cols = (part, chars[start] + offset[part], chars[end] + offset[part], enc, same, changes, corr)
    for p, *c in zip(*(x.tolist() for x in cols)):
        found[w.owner[p][0]][1].append(tuple(c))
    return found, sums


def scan(docs: DataFrame) -> DataFrame:
    """One row per document (``id``, its base spans and candidates) and one per window with sums (``stat``)."""
    ship_by_value()
    small_batches(docs.sparkSession)
    ddl = f"id {docs.schema[0].dataType.simpleString()}, {SCAN_DDL}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, object] = {}
        kind = [pa.null()]

        def texts():
            k = 0
            for b in batches:
                kind[0] = b.schema.field(0).type
                for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                    ids[k] = i
                    yield (k, None), t or b""
                    k += 1

        def rows(done: list[int], held: dict, sums: np.ndarray | None) -> pa.RecordBatch:
            extra = [] if sums is None else [None]
            cols = [
                pa.array([ids.pop(k) for k in done] + extra, kind[0]),
                pa.array([[dict(zip(("start", "kind", "end"), x)) for x in held[k][0]] for k in done] + extra, SCAN["base"]),
                pa.array([[dict(zip(("start", "end", "enc", "same", "changes", "corr"), x)) for x in held[k][1]] for k in done] + extra, SCAN["cand"]),
                pa.array([None] * len(done) + ([] if sums is None else [sums.ravel().tolist()]), SCAN["stat"]),
            ]
            for k in done:
                held.pop(k)
            return pa.RecordBatch.from_arrays(cols, names=["id", *SCAN])

        held: dict[int, tuple[list, list]] = {}
        chars: dict[int, int] = {}
        for w in windows(texts(), CUTS):
            found, sums = scan_window(w, chars)
            for doc, (b, c) in found.items():
                old = held.setdefault(doc, ([], []))
                old[0].extend(b)
                old[1].extend(c)
            last = w.owner[-1][0]  # may go on in the next window
            done = [k for k in held if k != last]
            for k in done:
                chars.pop(k)
            yield rows(done, held, sums)
        if held:
            yield rows(list(held), held, None)

    return docs.mapInArrow(run, ddl)


def ordinary_model(scanned: DataFrame) -> dict[int, tuple[float, ...]]:
    """Per encoding (sum q^2, sum q^3, half changes per pair, correlation) of all short runs; a fixed number of sums."""
    got = scanned.where("stat is not null").select(F.posexplode("stat").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    sums = np.zeros(len(ENCODINGS) * WIDTH, np.int64)
    sums[got["at"].to_numpy()] = got["v"].to_numpy()
    sums = sums.reshape(-1, WIDTH).astype(float)

    def one(s: np.ndarray) -> tuple[float, ...]:
        q = s[:256] / max(1.0, s[:256].sum())
        pairs, change, x, y, xx, yy, xy = s[256:]
        pairs = max(pairs, 1.0)
        sd = math.sqrt(max(0.0, xx / pairs - (x / pairs) ** 2) * max(0.0, yy / pairs - (y / pairs) ** 2))
        corr = (xy / pairs - x * y / pairs**2) / sd if sd else 0.0
        return float((q**2).sum()), float((q**3).sum()), change / pairs, corr

    pooled = one(sums.sum(axis=0))
    return {e: one(sums[e]) if sums[e, 256] >= LEAST_PAIRS else pooled for e in range(len(ENCODINGS))}


_tail = np.vectorize(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), otypes=[float])


def battery(n, enc, same, changes, corr, model) -> tuple[np.ndarray, np.ndarray]:
    """(p against random, p against ordinary) of every candidate."""
    size = SIZES[enc].astype(float)
    kappa, tau, rho, r0 = (np.array([model[int(e)][k] for e in enc]) for k in range(4))
    rho = np.clip(rho, 1e-3, 1 - 1e-3)
    pairs = n * (n - 1) / 2

    def same_sd(k, t):
        return np.sqrt(np.maximum(pairs * (k - k * k) + n * (n - 1) * (n - 2) * np.maximum(0, t - k * k), 1e-9))

    random_same = (same - pairs / size) / same_sd(1 / size, 1 / size**2)
    random_changes = (changes - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    random_corr = (corr + 1 / n) * np.sqrt(n)
    each = [_tail(random_same), 2 * _tail(np.abs(random_changes)), 2 * _tail(np.abs(random_corr))]
    p_random = np.minimum(1, 3 * np.minimum.reduce(each))

    # against ordinary strings: the score of each test, and where random strings of this length would have it
    sd_same, sd_changes = same_sd(kappa, tau), np.sqrt((n - 1) * rho * (1 - rho))
    z = np.array([(same - pairs * kappa) / sd_same, (changes - (n - 1) * rho) / sd_changes, (corr - r0) * np.sqrt(n)])
    shift = np.array([pairs * (1 / size - kappa) / sd_same, (n - 1) * (0.5 - rho) / sd_changes, (-1 / n - r0) * np.sqrt(n)])
    apart = (z * shift).sum(axis=0) / np.sqrt(np.maximum((shift * shift).sum(axis=0), 1e-9))
    return p_random, _tail(apart)


def rated(scanned: DataFrame, model: dict) -> DataFrame:
    """(id, base, cand) with every candidate's family and p-value bin, -1 where randomness is rejected."""
    names = ("start", "end", "family", "bin")
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
    ddl = f"id {scanned.schema['id'].dataType.simpleString()}, base array<struct<start:bigint,kind:int,end:bigint>>, cand array<struct<start:bigint,end:bigint,family:bigint,bin:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cand = b.column(2)
            flat = cand.flatten()
            start, end, enc, same, changes, corr = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            n = end - start
            if len(n):
                p_random, p = battery(n.astype(float), enc, same, changes, corr, model)
                where = np.where(p_random >= ALPHA, np.minimum(LAST_BIN, np.floor(-np.log10(np.maximum(p, 1e-40)) / STEP)), -1).astype(np.int64)
            else:
                where = np.zeros(0, np.int64)
            family = enc * len(BANDS) + np.searchsorted(BANDS, n, side="right") - 1
            rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, end, family, where)], names=list(names))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.diff(cand.offsets.to_numpy()))]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, rows).cast(kind)], names=["id", "base", "cand"])

    return scanned.where("stat is null").select("id", "base", "cand").mapInArrow(run, ddl)


def thresholds(counted: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Least bin that passes in each family, by Benjamini-Yekutieli over (family, bin, count)."""
    out = {}
    for family in {f for f, _, _ in counted}:
        bins = sorted(((b, c) for f, b, c in counted if f == family), reverse=True)
        m = sum(c for _, c in bins)
        harmonic = math.log(m) + 0.5773 + 0.5 / m
        rank = 0
        for b, c in bins:
            rank += c
            if b >= 0 and 10 ** (-b * STEP) * m * harmonic <= fdr * rank:
                out[family] = b
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``spans``, an array of (start, kind, end) by start, then kind as in ``KINDS``."""
    found = staged(scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "secrets")
    sized = staged(rated(found, ordinary_model(found)), "rated")
    # families times bins: a fixed number of rows
    counted = sized.select(F.explode("cand").alias("c")).groupBy("c.family", "c.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    least = thresholds([tuple(r) for r in counted])
    given = F.create_map(*[F.lit(x) for f, b in sorted(least.items()) for x in (f, b)]) if least else None
    if given is None:
        more = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    else:
        ok = F.filter("cand", lambda c: c["bin"] >= F.coalesce(F.try_element_at(given, c["family"].cast("int")), F.lit(LAST_BIN + 1)))
        more = F.transform(ok, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    spans = F.array_sort(F.concat("base", more))
    names = F.array(*[F.lit(k) for k in KINDS])
    return sized.select(
        F.col("id").alias(id_col),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"))).alias("spans"),
    )


def joined_spans(spans):
    """``kind:start:end`` of all spans, separated by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
