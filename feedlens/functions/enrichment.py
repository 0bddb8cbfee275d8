"""External enrichment responses: clean, parse, validate, convert.

Responses arrive as a table ``(seq, raw STRING)`` produced by whatever
batch job called the model. Parsing uses ``try_parse_json`` (VARIANT), so a
bad row yields NULL instead of failing the job, and type checks look at
the VARIANT's own type — a string "5" is not a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

NUMERIC_TYPE = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT|BOOLEAN)$"


def strip_code_fence(raw: Column) -> Column:
    """Trim, drop an opening ```json / ``` fence and a closing fence."""
    s = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(s, r"(?U)^```(?:json)?\s*", "")
    s = F.regexp_replace(s, r"(?U)\s*```$", "")
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def parse_response(raw: Column) -> Column:
    """VARIANT or NULL."""
    return F.try_parse_json(strip_code_fence(raw))


def _vtype(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def validate_response(v: Column, cleaned: Column) -> Column:
    """An object with all required keys (null values allowed), a known
    incident type, and a numeric (or boolean) boost."""
    keys = F.json_object_keys(cleaned)
    required = F.array(*[F.lit(k) for k in C.ENRICH_REQUIRED_FIELDS])
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    has_keys = F.size(F.array_except(required, F.coalesce(keys, F.array().cast("array<string>")))) == 0
    itype_ok = (_vtype(v, "$.incident_type") == F.lit("STRING")) & F.try_variant_get(
        v, "$.incident_type", "string"
    ).isin(C.ENRICH_INCIDENT_TYPES)
    boost_ok = _vtype(v, "$.ai_score_boost").rlike(NUMERIC_TYPE)
    return F.coalesce(is_obj & has_keys & itype_ok & boost_ok, F.lit(False))


def _text_field(v: Column, key: str, default: str) -> Column:
    """``data.get(key) or default``: null, empty and false-like values fall back."""
    path = f"$.{key}"
    t = _vtype(v, path)
    s = F.try_variant_get(v, path, "string")
    falsy = (
        s.isNull()
        | (s == F.lit(""))
        | ((t == F.lit("BOOLEAN")) & (s == F.lit("false")))
        | (t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$") & (F.try_variant_get(v, path, "double") == 0))
        | ((t.startswith("ARRAY")) & (F.coalesce(F.to_json(F.try_variant_get(v, path, "variant")), F.lit("")) == "[]"))
        | ((t.startswith("OBJECT")) & (F.coalesce(F.to_json(F.try_variant_get(v, path, "variant")), F.lit("")) == "{}"))
    )
    return F.when(falsy, F.lit(default)).otherwise(s)


def _is_fixed(v: Column) -> Column:
    t = _vtype(v, "$.is_fixed")
    s = F.lower(F.try_variant_get(v, "$.is_fixed", "string"))
    return (
        F.when(t == F.lit("BOOLEAN"), F.try_variant_get(v, "$.is_fixed", "boolean"))
        .when((t == F.lit("STRING")) & s.isin("true", "false"), s == F.lit("true"))
        .when(t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$") & (F.try_variant_get(v, "$.is_fixed", "double") == 1), F.lit(True))
        .when(t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$") & (F.try_variant_get(v, "$.is_fixed", "double") == 0), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def response_boost(v: Column) -> Column:
    """Boost clamped to [0, 20]; booleans count as 0/1."""
    t = _vtype(v, "$.ai_score_boost")
    raw = F.when(t == F.lit("BOOLEAN"), F.try_variant_get(v, "$.ai_score_boost", "boolean").cast("double")).otherwise(
        F.try_variant_get(v, "$.ai_score_boost", "double")
    )
    return F.coalesce(F.least(F.greatest(raw, F.lit(C.ENRICH_BOOST_MIN)), F.lit(C.ENRICH_BOOST_MAX)), F.lit(0.0))


def response_to_incident(v: Column) -> Column:
    """The incident struct from a validated response."""
    return F.struct(
        _text_field(v, "incident_type", C.INCIDENT_TYPE_DEFAULT).alias("incident_type"),
        _text_field(v, "victim", C.VICTIM_DEFAULT).alias("victim"),
        _text_field(v, "impact", C.IMPACT_DEFAULT).alias("impact"),
        _text_field(v, "root_cause", C.ROOT_CAUSE_DEFAULT).alias("root_cause"),
        _is_fixed(v).alias("is_fixed"),
        _text_field(v, "severity_rationale", "").alias("severity_rationale"),
        response_boost(v).alias("ai_score_boost"),
    )


# Request wording is ours; what matters is the fields asked for and the
# allowed incident types (the validator also accepts "Cross-Site Scripting").
REQUEST_TYPES = [t for t in C.ENRICH_INCIDENT_TYPES if t != "Cross-Site Scripting"]
REQUEST_TEMPLATE = (
    "Extract incident fields from this security news item as one JSON object with keys "
    + ", ".join(C.ENRICH_REQUIRED_FIELDS)
    + ". incident_type is one of: "
    + " | ".join(REQUEST_TYPES)
    + ". ai_score_boost is a number from 0 to 20.\nTITLE: %s\nDESCRIPTION: %s"
)


def enrichment_request(title: Column, description: Column) -> Column:
    """Request text per item (title + first 800 chars of description)."""
    return F.format_string(REQUEST_TEMPLATE, title, F.substring(F.coalesce(description, F.lit("")), 1, C.ENRICH_DESC_MAX))
