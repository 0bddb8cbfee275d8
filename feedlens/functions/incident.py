"""Incident field extraction (S25–S31) as one struct of native expressions.

Rules are tried in order; the first matching pattern wins, exactly as a
CASE WHEN chain evaluates. Each regex is preceded by a literal pre-check
(``rule_guard``) that skips the scan on texts that cannot match. Patterns run with ``(?iUd)``: case-insensitive
with Unicode classes (Python's defaults) and '.' stopping only at '\\n'.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .rule_guard import guard
from .text import py_strip

FLAGS = "(?iUd)"
WORD = r"\p{L}\p{N}_"


def _rx(p: str) -> str:
    return FLAGS + p


def incident_text(title="title", description="description") -> Column:
    t = F.col(title) if isinstance(title, str) else title
    d = F.col(description) if isinstance(description, str) else description
    return F.concat_ws(" ", t, F.coalesce(d, F.lit("")))


def incident_type(text: Column) -> Column:
    """S25."""
    expr = None
    for pat, label in C.INCIDENT_TYPE_RULES:
        cond = guard(text, pat) & text.rlike(_rx(pat))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(C.INCIDENT_TYPE_DEFAULT))


def _templated(text: Column, pat: str, template: str) -> Column:
    if "{}" not in template:
        return F.lit(template)
    pre, post = template.split("{}", 1)
    group = py_strip(F.regexp_extract(text, _rx(pat), 1))
    return F.concat(F.lit(pre), group, F.lit(post))


def root_cause(text: Column) -> Column:
    """S28."""
    expr = None
    for pat, template in C.ROOT_CAUSE_RULES:
        cond = guard(text, pat) & text.rlike(_rx(pat))
        val = _templated(text, pat, template)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.lit(C.ROOT_CAUSE_DEFAULT))


def py_capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def impact(text: Column) -> Column:
    """First matching rule, stripped, then first letter up and the rest down."""
    expr = None
    for pat, template in C.IMPACT_RULES:
        cond = guard(text, pat) & text.rlike(_rx(pat))
        val = py_capitalize(py_strip(_templated(text, pat, template)))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.lit(C.IMPACT_DEFAULT))


def _known_victim_pattern() -> str:
    names = "|".join(re.sub(r"([.$^*+?()\[\]{}|\\])", r"\\\1", v) for v in C.KNOWN_VICTIMS)
    return FLAGS + f"(?<![{WORD}])({names})(?![{WORD}])"


def victim(text: Column) -> Column:
    """Leftmost known name (text casing), else the generic patterns in order."""
    known_pat = _known_victim_pattern()
    expr = F.when(text.rlike(known_pat), F.regexp_extract(text, known_pat, 1))
    reject = "^(?:" + "|".join(re.escape(p) for p in C.VICTIM_REJECT_PREFIXES) + ")"
    trail = "[" + re.escape(C.VICTIM_TRAILING_CHARS) + "]+$"
    for pat, needed in zip(C.VICTIM_RULES, C.VICTIM_GUARDS):
        rx = _rx(pat)
        cand = F.regexp_replace(py_strip(F.regexp_extract(text, rx, 1)), trail, "")
        ok = (
            (text.rlike(_rx(needed)) if needed else F.lit(True))
            & text.rlike(rx)
            & (F.length(cand) >= C.VICTIM_MIN_LEN)
            & (F.length(cand) <= C.VICTIM_MAX_LEN)
            & ~F.lower(cand).rlike(reject)
        )
        expr = expr.when(ok, cand)
    return expr.otherwise(F.lit(C.VICTIM_DEFAULT))


def fix_status(text: Column) -> Column:
    """TRUE when a fix signal is present, FALSE when only a no-fix signal, else NULL."""
    has_fix = guard(text, C.FIX_SIGNAL_PATTERN) & text.rlike(_rx(C.FIX_SIGNAL_PATTERN))
    no_fix = guard(text, C.NO_FIX_SIGNAL_PATTERN) & text.rlike(_rx(C.NO_FIX_SIGNAL_PATTERN))
    return F.when(has_fix, F.lit(True)).when(no_fix, F.lit(False)).otherwise(F.lit(None).cast("boolean"))


def extract_incident(title="title", description="description") -> Column:
    """The incident struct for one item."""
    text = incident_text(title, description)
    return F.struct(
        incident_type(text).alias("incident_type"),
        victim(text).alias("victim"),
        impact(text).alias("impact"),
        root_cause(text).alias("root_cause"),
        fix_status(text).alias("is_fixed"),
        F.lit("").alias("severity_rationale"),
        F.lit(0.0).alias("ai_score_boost"),
    )


def _tri_label(col: Column, labels: dict) -> Column:
    return F.when(col == F.lit(True), F.lit(labels[True])).when(col == F.lit(False), F.lit(labels[False])).otherwise(
        F.lit(labels[None])
    )


def fixed_label(is_fixed: Column) -> Column:
    """S31."""
    return _tri_label(is_fixed, C.FIXED_LABEL)


def fixed_display(is_fixed: Column) -> Column:
    """S31 (report wording)."""
    return _tri_label(is_fixed, C.FIXED_DISPLAY)


def status_color(is_fixed: Column) -> Column:
    """Border colour by fix status."""
    return _tri_label(is_fixed, C.STATUS_COLOR)


def type_icon(incident_type_col: Column) -> Column:
    """Icon per incident type."""
    expr = None
    for name, icon in C.TYPE_ICONS:
        cond = incident_type_col == F.lit(name)
        expr = F.when(cond, F.lit(icon)) if expr is None else expr.when(cond, F.lit(icon))
    return expr.otherwise(F.lit(C.TYPE_ICON_DEFAULT))
