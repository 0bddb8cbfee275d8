"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, merkle, mtree, packing, phrases, quality, secrets, sharding, simhash, tokens, toxicity, warc
from .common import id_fold, scratch_path, staged, table

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels, id_fold("doc_id", 5) != 0)
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit_profiles(docs, id_fold("doc_id", 4) != 2)
    out = langid.predict_language(docs, profiles)
    return out.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    # the parsed records are written once: both sides of the revisit lookup read them
    captured = staged(warc.assemble(warc.read_records(spark, path, payload=False)), "captures")
    found = warc.resolve_revisits(captured)
    revisit = F.col("answer.warc_type") == "revisit"
    return found.select(
        F.col("metadata.fields")["page-id"].try_cast("bigint").alias("page_id"),
        F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("answer.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original.payload_sha1")).otherwise(F.col("answer.payload_sha1")).alias("payload_digest"),
        F.col("answer.warc_type").alias("record_type"),
        F.when(revisit, F.col("original.page_id")).alias("refers_to"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2)


def op10_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, prior = quality.fit_quality(docs, labels, id_fold("doc_id", 4) != 2)
    out = quality.score_quality(docs, model, prior)
    return out.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def of_kind(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in secrets.KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *counts, F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"), secrets.joined_spans(F.col("spans")).alias("spans")
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_collocations(phrases.collocations(table(spark, sf_dir, "documents"), max_words=3, least=10), most=2000)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampers = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    leaves = docs.select(
        "doc_id", "source",
        merkle.leaf_digest(*fields, F.col("text")).alias("leaf"),
        F.when(tampers & (F.length(cut) < F.length("text")), merkle.leaf_digest(*fields, cut)).alias("tampered"),
    )
    m = merkle.manifest(leaves, group="source", order="doc_id", leaf="leaf", carry=["doc_id", "tampered"])
    m = m.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return m.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op1_mtree_topk": op1_mtree_topk,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_quality_pu": op10_quality_pu,
    "op11_secrets": op11_secrets,
    "op12_phrases": op12_phrases,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_TOP_K_SQL = """
WITH vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

_WARC_SQL = """
WITH captured AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages
),
digested AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(hexed, (5 * (k // 4) + 1)::INTEGER, 5))::INTEGER) >> (15 - 5 * (k % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest
  FROM captured
),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS answer FROM digested)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN answer = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN answer <> page_id THEN answer END AS refers_to
FROM newest
"""

_PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS n, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words WHERE len(w) > 2
),
f AS (SELECT lang, n, phrase, count(*) AS c FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE n = 1 GROUP BY lang),
cand AS (SELECT lang, n, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND c >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:n], ' ') AS rp
  FROM cand, (VALUES (1), (2)) ks(k) WHERE k < n
),
scored AS (
  SELECT x.lang, x.phrase, x.a, k, fl.c AS l, fr.c AS r, (1000000::HUGEINT * x.a * x.a) // (fl.c::HUGEINT * fr.c) AS score
  FROM cuts x JOIN f fl ON fl.lang = x.lang AND fl.phrase = x.lp JOIN f fr ON fr.lang = x.lang AND fr.phrase = x.rp
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, sub, max(a) AS most FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS sub FROM cand WHERE n = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score::BIGINT AS score
FROM best b JOIN total ON total.lang = b.lang LEFT JOIN longer g ON g.lang = b.lang AND g.sub = b.phrase
WHERE g.most IS NULL OR 100 * g.most < 50 * a
QUALIFY rank <= 2000
"""


def _tree_sql(first: str, levels: int, name: str) -> str:
    """CTEs ``<name>0 ..`` of a tree's levels over ``first`` (g, i, h) and ``<name>f0 ..`` of each node's siblings."""
    ctes = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS m FROM {first})"]
    for k in range(levels):
        run = "PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN"
        ctes.append(
            f"{name}f{k} AS (SELECT g, i, m > 1 AS up, "
            f"CASE WHEN m > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS lf, "
            f"CASE WHEN m > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS rf FROM {name}{k})"
        )
        up = f"SELECT g, i // 3 AS i, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, i // 3"
        ctes.append(f"{name}{k + 1} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS m FROM ({up}))")
    return ",\n".join(ctes)


def _merkle_sql(low: int = 13, high: int = 6) -> str:
    """The manifest as SQL, for up to 3^low documents of a source and 3^high sources."""

    def leaf(text: str) -> str:
        fields = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return "sha256(" + " || ".join(fields) + ")"

    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    # all bits of a CRC-32 but the last complement: its lowest bit is set where the CRC is even
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda acc, e: xor(xor(acc, e) >> 1, 3988292384 * (xor(acc, e) & 1)))"
    path = [f"f{k}" for k in range(low)] + [f"t{k}" for k in range(high)]
    joins = [f"JOIN sf{k} f{k} ON f{k}.g = d.g AND f{k}.i = d.i // {3**k}" for k in range(low)]
    joins += [f"JOIN tf{k} t{k} ON t{k}.i = d.j // {3**k}" for k in range(high)]
    folds = "SELECT *, other AS r0 FROM walked"
    for k in range(low + high):
        folds = f"SELECT *, CASE WHEN up{k} THEN sha256(lf{k} || r{k} || rf{k}) ELSE r{k} END AS r{k + 1} FROM ({folds})"
    cols = ", ".join(f"{p}.up AS up{k}, {p}.lf AS lf{k}, {p}.rf AS rf{k}" for k, p in enumerate(path))
    proof = " || ".join(f"lf{k} || rf{k}" for k in range(low + high))
    return f"""
WITH leaves AS (
  SELECT coalesce('=' || source, '') AS g, doc_id, {leaf("text")} AS h,
         CASE WHEN doc_id IS NOT NULL AND {crc} & 1 = 1 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS other
  FROM documents
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
{_tree_sql("ranked", low, "s")},
tops AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS source FROM s{low}),
{_tree_sql("tops", high, "t")},
d AS (SELECT r.*, tops.i AS j, tops.h AS subroot, (SELECT h FROM t{high}) AS root FROM ranked r JOIN tops ON tops.source = r.g),
walked AS (SELECT d.*, {cols} FROM d {" ".join(joins)})
SELECT doc_id, h AS leaf, subroot, root, sha256({proof}) AS proof_sha256, r{low + high} AS folded_root, r{low + high} = root AS verified FROM ({folds})
"""


#: Models, tokenizers, signatures, shard keys and randomness tests have no SQL form; their tests use brute force.
ORACLES: dict[str, str] = {"op1_mtree_topk": _TOP_K_SQL, "op8_warc": _WARC_SQL, "op12_phrases": _PHRASES_SQL, "op13_merkle_manifest": _merkle_sql()}
