"""Topic clustering.

Items sharing two or more distinct keywords are linked; clusters are the
connected components. "Share ≥ 2 keywords" is the same as "share a keyword
*pair*", so instead of materialising every item pair (quadratic in a hot
keyword's item list) each item emits its keyword pairs and is linked to the
smallest item of every pair it holds — a star per pair, linear in the
input, with the same components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..session import cut_lineage
from .graph import star_components
from .report import skew_safe_join


def with_keywords(items: DataFrame) -> DataFrame:
    """Keywords from title, description and CVE ids (when not given)."""
    kw = T.extract_keywords(T.keyword_text("title", F.coalesce(F.col("description"), F.lit("")), F.coalesce(F.col("cve_ids"), F.array().cast("array<string>"))))
    if "keywords" in items.columns:
        return items.withColumn("keywords", F.when(F.coalesce(F.size("keywords"), F.lit(0)) > 0, F.col("keywords")).otherwise(kw))
    return items.withColumn("keywords", kw)


#: Classes that hold one pair of keywords and meet in one group, and members of a class that are paired as one row.
BLOCK, MEMBERS = 1000, 500
#: Pairs of rows that a task of the join compares on average, and its tasks at most.
TASK_PAIRS, MAX_PARTITIONS = 4_000_000, 20_000
#: Classes of a pair of keywords up to which a join costs less than a group of its own.
FEW = 64
#: Words whose rows are held as a matrix at a time.
WORDS = 1024


def _ship_by_value() -> None:
    """Pickle this module's task code by value, so executors need no installed copy of the package."""
    import sys

    from pyspark import cloudpickle

    mod = sys.modules[__name__]
    if mod.__name__ not in getattr(cloudpickle.cloudpickle, "_PICKLE_BY_VALUE_MODULES", set()):
        cloudpickle.register_pickle_by_value(mod)


def keyword_pairs(items: DataFrame, item_col: str = "item") -> DataFrame:
    """(item, k1, k2) for every pair k1 < k2 of an item's distinct keywords."""
    kws = F.array_sort(F.array_distinct(F.col("keywords")))
    pairs = F.flatten(
        F.transform(kws, lambda k, i: F.transform(F.slice(kws, i + 2, 1 << 30), lambda k2: F.struct(k.alias("k1"), k2.alias("k2"))))
    )
    return items.select(F.col(item_col).alias("item"), F.explode(pairs).alias("p")).select("item", "p.k1", "p.k2")


def shared_keyword_pairs(items: DataFrame, item_col: str = "item", min_shared: int = C.CLUSTER_MIN_SHARED) -> DataFrame:
    """Item pairs (a < b) with at least ``min_shared`` distinct shared keywords.

    This is the pair list itself (its size is the real output size), expanded from the pairs of classes; the
    clustering below never builds it.
    """
    return expand_classes(*shared_keyword_classes(items, item_col, min_shared))


def keyword_classes(items: DataFrame, item_col: str = "item") -> tuple[DataFrame, DataFrame]:
    """J2 membership: items of equal keyword sets are one class, named by its smallest item.

    Returns (classes, members): (cls, keywords, n_items) and (item, cls). Counted before anything is joined, so
    the copies of a keyword set are never paired with one another.
    """
    x = items.select(F.col(item_col).alias("item"), F.array_sort(F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>")))).alias("keywords"))
    x = x.where(F.size("keywords") > 0)
    classes = cut_lineage(x.groupBy("keywords").agg(F.min("item").alias("cls"), F.count(F.lit(1)).alias("n_items")))
    members = skew_safe_join(x, classes.select("keywords", "cls"), ["keywords"]).select("item", "cls")
    return classes.select("cls", "keywords", "n_items"), members


def shared_keyword_classes(items: DataFrame, item_col: str = "item", min_shared: int = C.CLUSTER_MIN_SHARED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """J2 between classes: (cls_a, cls_b, n_shared, n_links) with cls_a <= cls_b, and (item, cls).

    ``n_links`` is the number of item pairs that a row stands for. Classes meet on a *pair* of keywords, so a
    keyword that all items hold joins nothing by itself; two classes are given once, by the first pair that they share.
    The classes of a popular pair are dealt to blocks of about ``block``, and every two blocks meet in a group of their own,
    where matrices of rows and words count the words of all their pairs at once. Pairs with few classes are joined.
    """
    classes, members = keyword_classes(items, item_col)
    same = classes.where(F.size("keywords") >= min_shared).where(F.col("n_items") > 1).select(
        F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.size("keywords").alias("n_shared"),
        (F.col("n_items") * (F.col("n_items") - 1) / 2).cast("bigint").alias("n_links"),
    )
    ready = classes.where(F.size("keywords") >= 2).select("cls", "n_items", "keywords")
    if min_shared == 1:
        keyed = classes.select("cls", "n_items", "keywords", F.explode("keywords").alias("k1")).withColumn("k2", F.lit(""))
    else:
        kws = F.col("keywords")
        pairs = F.flatten(F.transform(kws, lambda k, i: F.transform(F.slice(kws, i + 2, 1 << 30), lambda k2: F.struct(k.alias("k1"), k2.alias("k2")))))
        keyed = ready.select("cls", "n_items", "keywords", F.explode(pairs).alias("p")).select("cls", "n_items", "keywords", "p.*")
    left, right, parts = blocks_that_meet(keyed, block)
    few = F.col("_n") <= F.lit(FEW)
    a = left.where(few).select("k1", "k2", "i", "j", F.col("cls").alias("x"), F.col("n_items").alias("n_a"), F.col("keywords").alias("w_a")).repartition(parts, "k1", "k2", "i", "j")
    b = right.where(few).select("k1", "k2", "i", "j", F.col("cls").alias("y"), F.col("n_items").alias("n_b"), F.col("keywords").alias("w_b")).repartition(parts, "k1", "k2", "i", "j")
    both = F.array_intersect("w_a", "w_b")  # in the order of the first, which is sorted
    first = (F.get(both, F.lit(0)) == F.col("k1")) & ((F.lit(min_shared) == 1) | (F.get(both, F.lit(1)) == F.col("k2")))
    once = F.when(F.col("i") == F.col("j"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))
    met = a.hint("shuffle_hash").join(b.hint("shuffle_hash"), ["k1", "k2", "i", "j"]).where(once & first & (F.size(both) >= min_shared))
    unlike = met.select(F.least("x", "y").alias("cls_a"), F.greatest("x", "y").alias("cls_b"), F.size(both).alias("n_shared"), (F.col("n_a") * F.col("n_b")).alias("n_links"))
    # a block that meets itself is there once (role 2), else both blocks are (0 and 1)
    role = F.when(F.col("i") == F.col("j"), 2).otherwise(0).alias("role")
    columns = ["k1", "k2", "i", "j", "cls", "n_items", "keywords"]
    sent = left.where(~few).select(*columns, role).unionByName(right.where(~few & (F.col("i") < F.col("j"))).select(*columns, F.lit(1).alias("role")))
    sent = sent.where(F.col("cls").isNotNull()).repartition(parts, "k1", "k2", "i", "j")
    kind = classes.schema["cls"].dataType.simpleString()
    _ship_by_value()

    def run(group: pa.Table) -> pa.Table:
        role = group["role"].to_numpy()
        word, last = group["k1" if min_shared == 1 else "k2"][0].as_py(), min(min_shared, 2)
        rows = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        row, code, before = words_of(group["keywords"].combine_chunks(), word)
        x, y, n_shared = pairs_that_begin_here(row, code, before, *rows, last, min_shared)
        x, y = rows[0][x], rows[1][y]
        cls, n_items = group["cls"].combine_chunks(), group["n_items"].to_numpy()
        place = np.unique(cls.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        # rows that meet themselves give each pair both ways
        once = place[x] < place[y] if role[0] == 2 else place[x] != place[y]
        x, y, n_shared = x[once], y[once], n_shared[once]
        low, high = np.where(place[x] < place[y], x, y), np.where(place[x] < place[y], y, x)
        return pa.table({"cls_a": cls.take(pa.array(low)), "cls_b": cls.take(pa.array(high)), "n_shared": pa.array(n_shared, pa.int32()), "n_links": pa.array(n_items[x] * n_items[y], pa.int64())})

    of_many = sent.groupBy("k1", "k2", "i", "j").applyInArrow(run, f"cls_a {kind}, cls_b {kind}, n_shared int, n_links bigint")
    return same.unionByName(unlike).unionByName(of_many), members


def words_of(keywords: pa.ListArray, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of the word, whether it stands before ``word``) for all words of sorted lists that all hold ``word``."""
    size = keywords.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    encoded = keywords.flatten().dictionary_encode(null_encoding="encode")
    code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    here = code == encoded.dictionary.index(word).as_py()
    place = np.zeros(len(size), np.int64)
    place[row[here]] = np.flatnonzero(here)
    return row, code, np.arange(len(row)) < place[row]


def pairs_that_begin_here(row, code, before, left: np.ndarray, right: np.ndarray, last: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``left``, place in ``right``, shared words) of the rows that share ``least`` words or more, where only ``last`` - 1 of them stand before the group's last word."""
    n_words = int(code.max()) + 1
    shared = np.zeros((2, len(left), len(right)), np.float32)  # whole numbers; before the group's last word, and from it on
    sides = []
    for rows in (left, right):
        at = np.full(int(row.max()) + 1, -1, np.int64)
        at[rows] = np.arange(len(rows))
        mine = at[row] >= 0
        sides.append((at[row[mine]], code[mine], before[mine], len(rows)))
    of_side = [np.bincount(c, minlength=n_words) for _, c, _, _ in sides]
    # a word of all rows is a number for all pairs, and one of a single row, or of one side, none
    full = (of_side[0] == len(left)) & (of_side[1] == len(right))
    single = (of_side[0] < 2) & (len(left) == len(right)) & np.array_equal(left, right)
    for part, wanted in enumerate((True, False)):
        held = [(r[b == wanted], c[b == wanted]) for r, c, b, _ in sides]
        counts = [np.bincount(c, minlength=n_words) for _, c in held]
        shared[part] += int(((counts[0] == len(left)) & (counts[1] == len(right)) & full).sum())
        some = np.flatnonzero((counts[0] > 0) & (counts[1] > 0) & ~full & ~single)
        for f in range(0, len(some), WORDS):
            number = np.full(n_words, -1, np.int64)
            number[some[f : f + WORDS]] = np.arange(len(some[f : f + WORDS]))
            x, y = (np.zeros((n, len(some[f : f + WORDS])), np.float32) for n in (len(left), len(right)))
            for m, (r, c) in zip((x, y), held):
                in_part = number[c] >= 0
                m[r[in_part], number[c[in_part]]] = 1
            shared[part] += x @ y.T
    total = shared[0] + shared[1]
    x, y = np.nonzero((shared[0] == last - 1) & (total >= least))
    return x, y, total[x, y].astype(np.int32)


def blocks_that_meet(keyed: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """The rows of each (k1, k2) as both sides of a self-join on (k1, k2, i, j), with i <= j, and a number of partitions.

    A key of more than ``block`` rows has several blocks, dealt by the hash of cls; a row goes to its own block's
    meetings only, so no group holds much more than ``block`` rows of a side.
    """
    counts = cut_lineage(keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    work = counts.agg(F.sum(F.col("_n") * F.col("_n").cast("double"))).first()[0] or 0.0
    par = keyed.sparkSession.sparkContext.defaultParallelism
    parts = int(max(2 * par, min(work / TASK_PAIRS, MAX_PARTITIONS)))
    of_key = counts.select("k1", "k2", "_n", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_s"))
    placed = cut_lineage(skew_safe_join(keyed, of_key, ["k1", "k2"]).withColumn("_c", F.pmod(F.xxhash64("cls"), F.col("_s")).cast("int")))
    left = placed.select("*", F.col("_c").alias("i"), F.explode(F.sequence("_c", F.col("_s") - 1)).alias("j"))
    right = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("_c"))).alias("i"), F.col("_c").alias("j"))
    return left, right, parts


def expand_classes(links: DataFrame, members: DataFrame, most: int = MEMBERS) -> DataFrame:
    """J2's item pairs (a < b, n_shared), for those who need every single one.

    A class of many members is cut into lists of about ``most``; a link becomes one row for every two lists. A class
    of one member is named by it, so a link between two of them is a pair as it stands.
    """
    links = cut_lineage(links)
    # where items repeat, unlike classes may have one name: then all links go through the lists
    shared_names = members.where(F.col("item") == F.col("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    plain = (F.col("n_links") == 1) & (F.col("cls_a") != F.col("cls_b")) & F.lit(shared_names.isEmpty())
    single, links = links.where(plain), links.where(~plain)
    sizes = cut_lineage(members.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("_s")))
    dealt = skew_safe_join(members, sizes, ["cls"]).withColumn("_c", F.pmod(F.xxhash64("item"), F.col("_s")).cast("int"))
    lists = cut_lineage(dealt.groupBy("cls", "_c").agg(F.collect_list(F.struct("item")).alias("list")))
    every = links
    for cls, c in (("cls_a", "_ca"), ("cls_b", "_cb")):
        cut = skew_safe_join(every, sizes.select(F.col("cls").alias(cls), "_s"), [cls])
        every = cut_lineage(cut.withColumn(c, F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s"))
    for cls, c, side in (("cls_a", "_ca", "_x"), ("cls_b", "_cb", "_y")):
        every = cut_lineage(skew_safe_join(every, lists.select(F.col("cls").alias(cls), F.col("_c").alias(c), F.col("list").alias(side)), [cls, c]))
    pairs = every.select("cls_a", "cls_b", "n_shared", "_y", F.explode("_x").alias("_x")).select("cls_a", "cls_b", "n_shared", F.col("_x.item").alias("x"), F.explode("_y").alias("_y"))
    pairs = pairs.withColumn("y", F.col("_y.item")).where((F.col("cls_a") != F.col("cls_b")) | (F.col("x") < F.col("y")))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n_shared")
    return single.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), "n_shared").unionByName(pairs)


def topic_components(items: DataFrame, item_col: str = "item") -> DataFrame:
    """A5: (item, comp) for items linked to at least one other item."""
    kp = cut_lineage(keyword_pairs(items, item_col))
    heads = kp.groupBy("k1", "k2").agg(F.min("item").alias("head"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    # a popular keyword pair can hold a large share of all items: hot pairs
    # are split over salted sub-keys for the join back to their head
    linked = skew_safe_join(kp, heads.select("k1", "k2", "head"), ["k1", "k2"])
    edges = linked.where(F.col("item") != F.col("head")).select(
        F.col("item").alias("a"), F.col("head").alias("b")
    ).distinct()
    return star_components(edges).select(F.col("node").alias("item"), "comp")


def cluster(items: DataFrame, item_col: str = "item") -> tuple[DataFrame, DataFrame]:
    """A5–A8. ``items`` needs score, rank columns and keywords.

    Returns (clusters, members):
      clusters: comp, name, shared_keywords, size, top_score, lead_item,
                is_other, and ordering columns;
      members:  item columns + comp.
    Singletons share one ``Other`` cluster (comp = -1, no shared keywords).
    """
    comps = topic_components(items, item_col)
    members = items.join(comps, items[item_col] == comps["item"], "left").drop(comps["item"])
    members = members.withColumn("is_other", F.col("comp").isNull()).withColumn(
        "comp", F.coalesce(F.col("comp"), F.lit(-1).cast("long"))
    )
    lead_key = F.struct(-F.col("score"), F.col("r_tier"), F.col("r_neg_pub"), F.col("r_pos"))
    summary = members.groupBy("comp", "is_other").agg(
        F.count(F.lit(1)).alias("size"),
        F.max("score").alias("top_score"),
        F.min_by(F.col(item_col), lead_key).alias("lead_item"),
        F.min(lead_key).alias("lead_key"),
    )
    # Keyword frequencies inside real clusters
    freq = (
        members.where(~F.col("is_other"))
        .select("comp", F.explode(F.array_distinct("keywords")).alias("kw"))
        .groupBy("comp", "kw")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    names = freq.groupBy("comp").agg(F.min_by("kw", F.struct(-F.col("cnt"), F.col("kw"))).alias("name_kw"))
    w = Window.partitionBy("comp").orderBy(F.desc("cnt"), F.asc("kw"))
    shared = (
        freq.where(F.col("cnt") >= 2)
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= C.CLUSTER_SHARED_SHOWN)
        .groupBy("comp")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "kw"))).alias("s"))
        .select("comp", F.col("s.kw").alias("shared_keywords"))
    )
    clusters = (
        summary.join(names, "comp", "left")
        .join(shared, "comp", "left")
        .select(
            "comp",
            F.when(F.col("is_other"), F.lit(C.CLUSTER_OTHER_NAME))
            .otherwise(F.coalesce(T.cluster_display_name(F.col("name_kw")), F.lit("Unknown")))
            .alias("name"),
            F.when(F.col("is_other"), F.array().cast("array<string>"))
            .otherwise(F.coalesce(F.col("shared_keywords"), F.array().cast("array<string>")))
            .alias("shared_keywords"),
            "size",
            "top_score",
            "lead_item",
            "is_other",
            "lead_key",
        )
    )
    return clusters, members
