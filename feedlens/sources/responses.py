"""Enrichment responses derived from the item table (for the catalog).

A real deployment lands the external batch job's output as ``(seq, raw)``;
here the rows are generated from ``news_items`` so their number grows with
the data. The mix covers every validation branch: clean and fenced JSON,
prose, a missing key, unknown/null incident types, a string boost, a
boolean boost, out-of-range boosts, string and unknown fix flags, null
optional fields, and items without any response.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import constants as C


def _types_sql(spark_side: bool) -> str:
    vals = ", ".join("'" + t.replace("'", "''") + "'" for t in C.ENRICH_INCIDENT_TYPES)
    return f"array({vals})" if spark_side else f"[{vals}]"


def responses_sql(src: str, spark_side: bool) -> str:
    n = len(C.ENRICH_INCIDENT_TYPES)
    itype = (
        f"element_at({_types_sql(True)}, CAST(1 + seq % {n} AS INT))" if spark_side else f"({_types_sql(False)})[1 + seq % {n}]"
    )
    s = "CAST({} AS STRING)" if spark_side else "CAST({} AS VARCHAR)"
    q = lambda x: "concat('\"', " + x + ", '\"')"
    it = q(itype)
    victim = q("source_name")
    impact = q(f"concat({s.format('seq % 97')}, ' records exposed')")
    fixed = "CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END"
    rationale = q(f"concat('rationale ', {s.format('seq')})")
    boost = s.format("seq % 25")

    def obj(it_=it, victim_=victim, impact_=impact, root_="'null'", fixed_=fixed, rat_=rationale, boost_=boost, with_boost=True):
        parts = [
            "'{\"incident_type\": '", it_, "', \"victim\": '", victim_, "', \"impact\": '", impact_,
            "', \"root_cause\": '", root_, "', \"is_fixed\": '", fixed_, "', \"severity_rationale\": '", rat_,
        ]
        if with_boost:
            parts += ["', \"ai_score_boost\": '", boost_]
        parts += ["'}'"]
        return "concat(" + ", ".join(parts) + ")"

    fence_open = "concat('```json', chr(10))"
    return f"""
      SELECT seq, raw FROM (
        SELECT seq, CASE seq % 12
          WHEN 0 THEN {obj()}
          WHEN 1 THEN concat({fence_open}, {obj()}, chr(10), '```')
          WHEN 2 THEN 'I cannot process this request.'
          WHEN 4 THEN {obj(with_boost=False)}
          WHEN 5 THEN {obj(it_="'\"Unknown Type\"'")}
          WHEN 6 THEN {obj(boost_="'\"5\"'")}
          WHEN 7 THEN {obj(it_="'null'")}
          WHEN 8 THEN {obj(boost_="'true'", fixed_="'\"true\"'")}
          WHEN 9 THEN {obj(boost_="'-3'", fixed_="'\"maybe\"'")}
          WHEN 10 THEN {obj(victim_="'null'", impact_="'null'", rat_="'null'", boost_="'0'")}
          END AS raw
        FROM {src}) r
      WHERE raw IS NOT NULL"""


def derived_responses(items: DataFrame) -> DataFrame:
    spark = items.sparkSession
    # spark.sql formats ``{name}`` arguments: escape the JSON braces first
    sql = responses_sql("ITEMS_SRC", True).replace("{", "{{").replace("}", "}}").replace("ITEMS_SRC", "{items}")
    return spark.sql(sql, items=items)
