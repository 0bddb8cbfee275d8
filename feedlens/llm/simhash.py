"""SimHash near-duplicates through the generalised pigeonhole principle.

Fingerprints of at most ``tau`` differing bits are linked. The 64 bits are grouped into
m parts, correlated bits together; each fingerprint gets thresholds t_1..t_m, one per
part and unequal, whose sum is tau - m + 1 (a part may get -1: not probed). Two
fingerprints within tau bits are then within t_i on some part i, so probing each
part with every value within t_i finds every link. The thresholds are chosen per
fingerprint by dynamic programming over estimated candidate counts, so a part whose
value is crowded is left to the others; m is the one of least estimated total cost.
Probes meet the parts of all distinct fingerprints in a join that verifies the bit
distance; only true links leave it.

Crowded buckets: where a bucket is large, neighbours in sort order are linked first, in
linear time, and the join then compares only fingerprints of different groups; the
rows of a large group stand under a key of their own, which their own group never probes.

Defined results: null and wordless texts have fingerprint zero and are linked like any
other; a group's id is its smallest non-null doc_id (null if it has none); repeated
rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.report import skew_safe_join
from .common import score_rows, ship_by_value, smallest_hashes, staged

SHINGLE = 4
TAU = 4
#: Distinct fingerprints that bit correlations and candidate counts are estimated on.
SAMPLE = 20_000
#: Rows of one part value from which a bucket counts as crowded.
CROWDED = 256
#: Cost of one tested candidate, in probe rows.
TEST_COST = 0.02


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles (ASCII lower case, XXH64 seed 42)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip((end - size)[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist())]
    total = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 65_536):
        block = np.array(hashes[s : s + 65_536], np.uint64)
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, fp): the fingerprint as a signed long."""

    def make():
        return lambda texts: {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    return score_rows(docs.select("doc_id", "text", *carry), "text", make, {"fp": pa.int64()}, "fp bigint")


# ---- partitions and thresholds ----


def group_bits(sample: np.ndarray, m: int) -> list[np.ndarray]:
    """64 bits in m groups of near-equal size, each grown from its most correlated bits."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(0)
    norm = np.sqrt((bits**2).sum(0))
    norm[norm == 0] = 1
    corr = np.abs((bits / norm).T @ (bits / norm))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        left = sorted(free)
        a, b = np.unravel_index(corr[np.ix_(left, left)].argmax(), (len(left), len(left)))
        group = list(dict.fromkeys([left[a], left[b]]))[:size]
        while len(group) < size:
            rest = [x for x in left if x not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].mean(1).argmax())])
        free -= set(group)
        groups.append(np.array(sorted(group)))
    return groups


class Part:
    """One group of bits: its mask, the flips within each distance, and how crowded its values are."""

    def __init__(self, bits: np.ndarray, sample: np.ndarray, total: int, most: int = 2):
        one = [np.uint64(1) << np.uint64(b) for b in bits]
        self.mask = np.bitwise_or.reduce(one)
        flips = [np.uint64(0)]
        self.upto = [1]
        for t in range(1, most + 1):
            flips += [np.bitwise_or.reduce(c) for c in itertools.combinations(one, t)]
            self.upto.append(len(flips))
        self.flips = np.array(flips, np.uint64)
        value, n = np.unique(sample & self.mask, return_counts=True)
        crowded = n >= max(8, len(sample) // 1000)
        self.value, self.share = value[crowded], n[crowded] / max(1, len(sample)) * total
        light = total - self.share.sum()
        self.spread = [light * sum(math.comb(len(bits), j) for j in range(t + 1)) / 2.0 ** len(bits) for t in range(most + 1)]

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """Estimated cost of thresholds -1, 0, 1, .. for each fingerprint: probes plus candidates."""
        out = np.zeros((len(fps), len(self.upto) + 1))
        for t, n in enumerate(self.upto):
            out[:, t + 1] = n + TEST_COST * self.spread[t]
        if len(self.value):
            far = np.bitwise_count((fps & self.mask)[:, None] ^ self.value[None, :])
            for t in range(len(self.upto)):
                out[:, t + 1] += TEST_COST * ((far <= t) * self.share).sum(1)
        return out


def allocate(parts: list[Part], fps: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Per fingerprint the thresholds (sum tau - m + 1) of least cost, by dynamic programming over the parts."""
    units = tau + 1  # thresholds count from -1, so they share out tau - m + 1 + m units
    best = np.full((len(fps), units + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for p in parts:
        cost = p.costs(fps)
        new = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, np.int8)
        for u in range(cost.shape[1]):
            with_u = best[:, : units + 1 - u] + cost[:, u : u + 1]
            better = with_u < new[:, u:]
            new[:, u:][better] = with_u[better]
            pick[:, u:][better] = u
        best = new
        picks.append(pick)
    t = np.zeros((len(fps), len(parts)), np.int64)
    left = np.full(len(fps), units)
    for i in range(len(parts) - 1, -1, -1):
        u = picks[i][np.arange(len(fps)), left]
        t[:, i] = u - 1
        left = left - u
    return t, best[:, units]


def choose_parts(sample: np.ndarray, total: int, tau: int) -> list[Part]:
    """The partition count of least estimated cost, with its parts."""
    found = []
    for m in range(max(1, -(-(tau + 1) // 3)), tau + 2):
        parts = [Part(g, sample, total) for g in group_bits(sample, m)]
        found.append((allocate(parts, sample[:2000], tau)[1].mean(), m, parts))
    return min(found, key=lambda x: x[:2])[2]


def probe_rows(nodes: DataFrame, parts: list[Part], tau: int) -> DataFrame:
    """(part, value, fp, grp, ts): every part value that a fingerprint asks for; ``ts`` packs its thresholds + 1."""
    ship_by_value()
    plain = [(int(p.mask), p.upto, p.flips, p.value, p.share, p.spread) for p in parts]
    ref = nodes.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = []
        for mask, upto, flips, value, share, spread in ref.value:
            p = Part.__new__(Part)
            p.mask, p.upto, p.flips, p.value, p.share, p.spread = np.uint64(mask), upto, flips, value, share, spread
            local.append(p)
        for b in batches:
            fps_all = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            grp_all = b.column(1).to_numpy(zero_copy_only=False)
            for s in range(0, len(fps_all), 2048):
                fps, grp = fps_all[s : s + 2048], grp_all[s : s + 2048]
                t, _ = allocate(local, fps, tau)
                ts = ((t + 1) << (3 * np.arange(len(local)))).sum(1)
                for i, p in enumerate(local):
                    for level, n in enumerate(p.upto):
                        rows = np.flatnonzero(t[:, i] == level)
                        if len(rows):
                            value = ((fps[rows] & p.mask)[:, None] ^ p.flips[None, :n]).ravel()
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(value), i, np.int32)), pa.array(value.view(np.int64)), pa.array(np.repeat(fps[rows], n).view(np.int64)), pa.array(np.repeat(grp[rows], n)), pa.array(np.repeat(ts[rows], n))],
                                names=["part", "value", "fp", "grp", "ts"],
                            )

    return nodes.select("fp", "grp").mapInArrow(run, "part int, value bigint, fp bigint, grp bigint, ts bigint")


def index_rows(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """(part, value, fp, grp): every part of every fingerprint."""
    masks = [int(np.uint64(p.mask).astype(np.int64)) for p in parts]
    each = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(x).cast("bigint")).alias("value")) for i, x in enumerate(masks)])
    return nodes.select(F.explode(each).alias("e"), "fp", "grp").select("e.part", "e.value", "fp", "grp")


def sorted_links(index: DataFrame, tau: int, parts: int) -> DataFrame:
    """(a, b): within each part value in fingerprint order, links to the run's first or to the one before.

    Linear; range partitions cut a crowded value, so no task holds a whole one.
    """
    ship_by_value()
    ordered = index.select("part", "value", "fp").repartitionByRange(parts, "part", "value", "fp").sortWithinPartitions("part", "value", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = before = None
        for b in batches:
            out_a, out_b = [], []
            part, value, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            key = list(zip(part.tolist(), value.tolist()))
            for k, x in zip(key, fp.tolist()):
                if first is None or first[0] != k:
                    first = before = (k, x)
                    continue
                near = next((y for y in (first[1], before[1]) if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= tau), None)
                if near is None:
                    first = (k, x)
                elif near != x:
                    out_a.append(near)
                    out_b.append(x)
                before = (k, x)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def grouped(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``nodes`` with ``grp``: the smallest node of the component of ``key``."""
    comp = connected_components(edges).select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    return nodes.join(comp, nodes[key] == comp["_n"], "left").withColumn("grp", F.coalesce("_c", key)).drop("_n", "_c")


def links(nodes: DataFrame, parts: list[Part], tau: int, crowded: int = CROWDED) -> DataFrame:
    """(a, b): group pairs that a link joins. ``nodes``: (fp, grp)."""
    index, probes = index_rows(nodes, parts), probe_rows(nodes, parts, tau)
    # large groups of one bucket get a key of their own, which only other groups probe
    large = index.groupBy("part", "value", "grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= crowded)
    large = staged(large.select("part", "value", F.col("grp").alias("own")), "large")
    if not large.isEmpty():
        index = index.join(large, (index["part"] == large["part"]) & (index["value"] == large["value"]) & (index["grp"] == large["own"]), "left").select(
            index["part"], index["value"], "fp", "grp", "own"
        )
        extra = probes.join(large, ["part", "value"]).where(F.col("own") != F.col("grp"))
        probes = probes.withColumn("own", F.lit(None).cast("bigint")).unionByName(extra.select("part", "value", "fp", "grp", "ts", "own"))
    else:
        index, probes = (x.withColumn("own", F.lit(None).cast("bigint")) for x in (index, probes))
    i = index.select("part", "value", F.coalesce("own", F.lit(0)).alias("own"), F.col("own").isNull().alias("small"), F.col("fp").alias("y"), F.col("grp").alias("gy"))
    p = probes.select("part", "value", F.coalesce("own", F.lit(0)).alias("own"), F.col("own").isNull().alias("small"), F.col("fp").alias("x"), F.col("grp").alias("gx"), "ts")
    diff = F.col("x").bitwiseXOR(F.col("y"))
    # a fingerprint's own probes find all its links, so each pair is asked for from one side, and given by its first part
    hit = (F.col("x") > F.col("y")) & (F.col("gx") != F.col("gy")) & (F.bit_count(diff) <= tau)
    for j, part in enumerate(parts):
        mask = F.lit(int(np.uint64(part.mask).astype(np.int64))).cast("bigint")
        hit &= (F.col("part") <= j) | (F.bit_count(diff.bitwiseAND(mask)) >= F.shiftright("ts", 3 * j).bitwiseAND(F.lit(7)))
    hit = p.join(i, ["part", "value", "own", "small"]).where(hit)
    return hit.select(F.least("gx", "gy").alias("a"), F.greatest("gx", "gy").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU, sample: int = SAMPLE, crowded: int = CROWDED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id) of every document; with carried columns these and ``grp``, a key of the group."""
    spark = docs.sparkSession
    rows = staged(fingerprints(docs, shingle, carry), "fp")
    group = ["grp"] if carry else []
    out = ["doc_id", "fp", "component_id", *carry, *group]
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    picked = smallest_hashes(nodes, sample, "fp").select("fp").toArrow()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    if len(picked) < 2:
        return rows.join(nodes.withColumnRenamed("rep", "component_id").withColumn("grp", F.col("fp")), "fp").select(out)
    parts = choose_parts(picked, nodes.count(), tau)
    index = index_rows(nodes.withColumn("grp", F.col("fp")), parts)
    calm = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= crowded).isEmpty()
    nodes = nodes.withColumn("grp", F.col("fp"))
    if not calm:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        nodes = staged(grouped(nodes.drop("grp"), staged(sorted_links(index, tau, n), "runs"), "fp"), "groups")
    edges = staged(links(nodes.select("fp", "grp"), parts, tau, crowded), "links")
    final = nodes if edges.isEmpty() else grouped(nodes.withColumnRenamed("grp", "g0"), edges, "g0")
    # most groups are one fingerprint of one document; the id is the smallest document of all
    # a group or a fingerprint may hold a large share of all rows: both joins split hot keys
    final = staged(final.select("fp", "grp", "rep"), "final")
    least = final.groupBy("grp").agg(F.min("rep").alias("component_id"))
    of_fp = staged(skew_safe_join(final.select("fp", "grp"), least, ["grp"]).select("fp", "component_id", *group), "comp")
    return skew_safe_join(rows, of_fp, ["fp"]).select(out)


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """One document of each group, that with the smallest doc_id; all columns unchanged.

    A doc_id that comes several times is decided row by row: of its unlike texts each is
    kept or dropped by its own group, and equal rows count once. Rows without a doc_id come
    after all others: one of them stays where its group has no row with a doc_id.
    """
    key = "_text_key"
    while key in docs.columns:
        key += "_"
    text_key = F.md5(F.coalesce("text", F.lit("")))
    found = staged(near_duplicates(docs.select("doc_id", "text", text_key.alias(key)), shingle, tau, carry=(key,)), "near")
    named = found.where(F.col("doc_id").isNotNull())
    again = staged(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    gone = staged(named.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "copies")
    kept = docs.where(F.col("doc_id").isNotNull())
    if again.isEmpty():
        kept = kept.join(gone, "doc_id", "left_anti").select(docs.columns)
    else:
        kept = kept.join(gone.unionByName(again).distinct(), "doc_id", "left_anti").select(docs.columns)
        # of each group the row of smallest (doc_id, fingerprint), where its id is a repeated one
        first = named.groupBy("grp").agg(F.min(F.struct("doc_id", "fp", key)).alias("r")).select("r.doc_id", f"r.{key}").distinct()
        first = staged(first.join(again, "doc_id", "left_semi"), "first")
        kept = kept.unionByName(once_each(docs, first, text_key, key, ["doc_id", key]))
    nameless = found.where(F.col("component_id").isNull())
    if nameless.isEmpty():
        return kept
    # groups of nothing but rows without a doc_id: the row of smallest (fingerprint, text key)
    first = staged(nameless.groupBy("grp").agg(F.min(F.struct("fp", key)).alias("r")).select(f"r.{key}").distinct(), "nameless")
    return kept.unionByName(once_each(docs.where(F.col("doc_id").isNull()), first, text_key, key, [key]))


def once_each(docs: DataFrame, chosen: DataFrame, text_key: F.Column, name: str, keys: list[str]) -> DataFrame:
    """One row of ``docs`` for each chosen key."""
    return docs.withColumn(name, text_key).join(chosen, keys, "left_semi").dropDuplicates(keys).select(docs.columns)
