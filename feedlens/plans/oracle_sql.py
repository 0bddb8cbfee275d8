"""DuckDB SQL building blocks for the oracle side of the query catalog.

These restate each operator's definition in plain SQL (window functions,
recursive CTEs, list lambdas) independently of how the Spark side is
planned. RE2 has no lookaround, so the few rules that use it are
rewritten as counts: "an occurrence of A not preceded/followed by X"
holds iff #A > #(X-adjacent A).
"""

from __future__ import annotations

import re

from .. import constants as C
from ..sources.tables import news_items_sql

NOW = "2024-01-31 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"
WORD = r"\p{L}\p{N}_"
# Python's Unicode whitespace, spelled out for RE2 (whose \s is ASCII)
PY_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(pat: str) -> str:
    return q("(?i)" + pat)


def norm_title(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^{WORD}]+', ' ', 'g'))"


def norm_url(x: str) -> str:
    return f"lower(rtrim(split_part({x}, '?', 1), '/'))"


def fingerprint(title: str, url: str) -> str:
    return f"substr(sha256(concat_ws('|', {norm_title(title)}, {norm_url(url)})), 1, 16)"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def age_hours(published: str = "published") -> str:
    return f"greatest((epoch_us({NOW_SQL}) - epoch_us({published})) / 3.6e9, 0.0)"


def contains_count(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {q(t.lower())}) THEN 1 ELSE 0 END" for t in terms) + ")"


def contains_any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t.lower())})" for t in terms) + ")"


def score_expr() -> str:
    w = C.DEFAULT_WEIGHTS
    text = "lower(concat_ws(' ', title, coalesce(description, '')))"
    hits = contains_count(text, C.DEFAULT_WATCHLIST)
    tier = " ".join(f"WHEN {t} THEN {s}::DOUBLE" for t, s in C.TIER_SHARE.items())
    return f"""round(least(
        CASE WHEN cvss_score IS NULL THEN 0.0::DOUBLE ELSE least(cvss_score, 10.0::DOUBLE) / 10.0::DOUBLE * {w['cvss_weight']}::DOUBLE END
        + {w['recency_weight']}::DOUBLE * pow(0.5::DOUBLE, {age_hours()} / 12.0::DOUBLE)
        + (CASE source_tier {tier} ELSE {C.TIER_OTHER}::DOUBLE END) * {w['source_tier_weight']}::DOUBLE
        + (CASE WHEN hn_points <= 0 THEN 0.0::DOUBLE ELSE least(ln(hn_points + 1) / ln(501), 1.0::DOUBLE) * {w['engagement_weight']}::DOUBLE END)
        + least({hits} / 3.0::DOUBLE, 1.0::DOUBLE) * {w['watchlist_weight']}::DOUBLE,
        100.0::DOUBLE), 1)"""


def cves_expr(text: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({text}, '(?i)CVE-\\p{{Nd}}{{4}}-\\p{{Nd}}{{4,7}}'), lambda x: upper(x))))"


def keywords_expr(text: str) -> str:
    from ..functions.text import known_terms

    terms = known_terms()
    lt = f"lower({text})"
    known = "list_filter([" + ", ".join(q(t) for t in terms) + f"], lambda t: contains({lt}, t))"
    words = f"list_filter(regexp_split_to_array({text}, '[^{WORD}]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{3,}}'))"
    stop = "[" + ", ".join(q(s) for s in C.NOUN_STOPWORDS) + "]"
    nouns = f"list_filter(list_transform({words}, lambda w: lower(w)), lambda w: NOT list_contains({stop}, w))"
    return f"list_sort(list_distinct(list_concat({cves_expr(text)}, {known}, {nouns})))"


def keyword_text() -> str:
    return "concat_ws(' ', title, coalesce(description, ''), array_to_string(cve_ids, ' '))"


# ---------------------------------------------------------------- incident rules

def _case(rules, default: str, value) -> str:
    parts = [f"WHEN regexp_matches(text, {rx(p)}) THEN {value(p, t)}" for p, t in rules]
    return "CASE " + " ".join(parts) + f" ELSE {q(default)} END"


def _templ(p: str, t: str) -> str:
    if "{}" not in t:
        return q(t)
    pre, post = t.split("{}", 1)
    return f"concat({q(pre)}, {py_strip(f'regexp_extract(text, {rx(p)}, 1)')}, {q(post)})"


def incident_type_sql() -> str:
    return _case(C.INCIDENT_TYPE_RULES, C.INCIDENT_TYPE_DEFAULT, lambda p, t: q(t))


def root_cause_sql() -> str:
    return _case(C.ROOT_CAUSE_RULES, C.ROOT_CAUSE_DEFAULT, _templ)


def impact_sql() -> str:
    def val(p, t):
        s = py_strip(_templ(p, t))
        return f"concat(upper(substr({s}, 1, 1)), lower(substr({s}, 2)))"

    return _case(C.IMPACT_RULES, C.IMPACT_DEFAULT, val)


def victim_sql() -> str:
    names = "|".join(re.sub(r"([.$^*+?()\[\]{}|\\])", r"\\\1", v) for v in C.KNOWN_VICTIMS)
    known = f"(?:^|[^{WORD}])({names})(?:$|[^{WORD}])"
    parts = [f"WHEN regexp_matches(text, {rx(known)}) THEN regexp_extract(text, {rx(known)}, 1)"]
    trail = C.VICTIM_TRAILING_CHARS
    reject = " OR ".join(f"starts_with(lower(c{i}), {q(p)})" for i, p in enumerate(C.VICTIM_REJECT_PREFIXES))
    for pat in C.VICTIM_RULES:
        cand = f"rtrim({py_strip(f'regexp_extract(text, {rx(pat)}, 1)')}, {q(trail)})"
        cond_reject = " OR ".join(f"starts_with(lower({cand}), {q(p)})" for p in C.VICTIM_REJECT_PREFIXES)
        parts.append(
            f"WHEN regexp_matches(text, {rx(pat)}) AND length({cand}) BETWEEN {C.VICTIM_MIN_LEN} AND {C.VICTIM_MAX_LEN} "
            f"AND NOT ({cond_reject}) THEN {cand}"
        )
    del reject
    return "CASE " + " ".join(parts) + f" ELSE {q(C.VICTIM_DEFAULT)} END"


def _count(pat: str) -> str:
    return f"len(regexp_extract_all(text, {rx(pat)}))"


def fix_status_sql() -> str:
    fix = " OR ".join(
        [
            f"{_count('patch(?:ed|es|ing)')} > {_count(r'patch(?:ed|es|ing)(?:\s+not|\s+unavailable)')}",
            f"{_count(r'patch(?:\s+is)?\s+available')} > {_count(r'(?:no|not)\spatch(?:\s+is)?\s+available')}",
            f"{_count('fix(?:ed|es)')} > {_count(r'fix(?:ed|es)(?:\s+not|\s+unavailable)')}",
            f"{_count(r'fix\s+(?:is\s+)?available')} > {_count(r'(?:no|not)\sfix\s+(?:is\s+)?available')}",
            "regexp_matches(text, "
            + rx(
                r"update(?:d|s)?\s+available|remediat(?:ed|ion)|mitigat(?:ed|ion)|workaround available|upgrade to|"
                r"upgrade available|version \d[\d\.]+ (?:addresses|fixes|resolves)|security advisory|"
                r"has been (?:fixed|patched|resolved)|released a (?:fix|patch|update)|required patch by|patch required by"
            )
            + ")",
        ]
    )
    nofix_pat = C.NO_FIX_SIGNAL_PATTERN.replace(r"\bunpatched\b", f"(?:^|[^{WORD}])unpatched(?:$|[^{WORD}])")
    nofix = f"regexp_matches(text, {rx(nofix_pat)})"
    return f"CASE WHEN ({fix}) THEN true WHEN {nofix} THEN false ELSE NULL END"


def incident_struct_cols() -> str:
    return (
        f"{incident_type_sql()} AS incident_type, {victim_sql()} AS victim, {impact_sql()} AS impact, "
        f"{root_cause_sql()} AS root_cause, {fix_status_sql()} AS is_fixed"
    )


# ---------------------------------------------------------------- common CTEs

def items_cte() -> str:
    return news_items_sql()


def scored_cte(src: str = "news_items", name: str = "scored") -> str:
    return f"{name} AS (SELECT *, {score_expr()} AS score FROM {src})"


def exact_cte(src: str, name: str = "canon") -> str:
    """Exact dedup by fingerprint: winner = (tier, seq) minimum; pos = first arrival."""
    return f"""
    {name}_fp AS (SELECT *, {fingerprint('title', 'url')} AS fp FROM {src}),
    {name} AS (
      SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY fp ORDER BY source_tier, seq) AS rn,
               min(seq) OVER (PARTITION BY fp) AS pos,
               count(*) OVER (PARTITION BY fp) AS n_copies
        FROM {name}_fp) WHERE rn = 1)"""


def exact_attr_cte(src_fp: str, name: str = "exact_attr") -> str:
    """Sequential rule via running minimum: prefix-minimum rows leave the
    canonical slot when the next prefix minimum arrives."""
    return f"""
    {name}_a AS (
      SELECT fp, seq, source_tier, source_name,
             min(source_tier) OVER (PARTITION BY fp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min
      FROM {src_fp}),
    {name}_b AS (SELECT *, (prev_min IS NULL OR source_tier < prev_min) AS is_pm FROM {name}_a),
    {name} AS (
      SELECT fp, seq, source_name,
             CASE WHEN is_pm THEN lead(seq) OVER (PARTITION BY fp, is_pm ORDER BY seq) ELSE seq END AS ord
      FROM {name}_b)"""


def ascii_twin(x: str) -> str:
    """One byte per character: DuckDB's levenshtein counts bytes. Merging letters only lowers the distance."""
    return f"regexp_replace({x}, '[^ -~]', '#', 'g')"


def lcs_sql(a: str, b: str) -> str:
    """LCS length by dynamic programming over list lambdas."""
    return f"""list_reduce(
        string_split({b}, ''),
        lambda prev, c: list_reduce(
            range(1, length({a}) + 1),
            lambda acc, j: list_append(acc, CASE WHEN substr({a}, j::INT, 1) = c THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END),
            [0]),
        list_transform(range(0, length({a}) + 1), lambda x: 0))[-1]"""


def fuzzy_ctes(canon: str, threshold: float = C.DEFAULT_SIMILARITY_THRESHOLD) -> str:
    """Greedy leader scan over distinct normalised titles (recursive CTE)."""
    th = float(threshold)
    return f"""
    fz_items AS (
      SELECT *, source_tier AS r_tier, -epoch_us(published) AS r_neg_pub, pos AS r_pos, {norm_title('title')} AS nt
      FROM {canon}),
    fz_first AS (
      SELECT * FROM (
        SELECT nt, fp AS first_fp, r_tier, r_neg_pub, r_pos AS tid,
               row_number() OVER (PARTITION BY nt ORDER BY r_tier, r_neg_pub, r_pos) AS rn
        FROM fz_items) WHERE rn = 1),
    fz_titles AS (SELECT *, row_number() OVER (ORDER BY r_tier, r_neg_pub, tid) AS k FROM fz_first),
    fz_cand AS (
      SELECT a.tid AS a, b.tid AS b, a.nt AS ta, b.nt AS tb, length(a.nt) + length(b.nt) AS tot
      FROM fz_titles a JOIN fz_titles b ON a.tid < b.tid
      WHERE abs(length(a.nt) - length(b.nt)) <= floor((length(a.nt) + length(b.nt)) * {(100 - th) / 100}) + 1
        AND levenshtein({ascii_twin('a.nt')}, {ascii_twin('b.nt')}) <= floor((length(a.nt) + length(b.nt)) * {(100 - th) / 100}) + 1),
    fz_pairs AS (
      SELECT a, b FROM (SELECT a, b, tot, CASE WHEN tot = 0 THEN 0 ELSE {lcs_sql('ta', 'tb')} END AS lcs FROM fz_cand)
      WHERE CASE WHEN tot = 0 THEN 100.0 ELSE (1.0 - (tot - 2 * lcs)::DOUBLE / tot::DOUBLE) * 100.0 END >= {th}),
    fz_adj AS (SELECT a AS x, b AS y FROM fz_pairs UNION ALL SELECT b AS x, a AS y FROM fz_pairs),
    fz_scan AS (
      WITH RECURSIVE scan(k, leaders) AS (
        SELECT 0::BIGINT, []::BIGINT[]
        UNION ALL
        SELECT s.k + 1,
               CASE WHEN EXISTS (SELECT 1 FROM fz_adj j WHERE j.x = t.tid AND list_contains(s.leaders, j.y))
                    THEN s.leaders ELSE list_append(s.leaders, t.tid) END
        FROM scan s JOIN fz_titles t ON t.k = s.k + 1)
      SELECT leaders FROM scan ORDER BY k DESC LIMIT 1),
    fz_leader_titles AS (SELECT unnest(leaders) AS tid FROM fz_scan),
    fz_title_map AS (
      SELECT t.nt, t.tid,
             CASE WHEN t.tid IN (SELECT tid FROM fz_leader_titles) THEN t.tid
                  ELSE (SELECT l.tid FROM fz_adj j JOIN fz_titles l ON l.tid = j.y
                        WHERE j.x = t.tid AND l.tid IN (SELECT tid FROM fz_leader_titles)
                        ORDER BY l.k LIMIT 1) END AS leader_tid
      FROM fz_titles t),
    fz_groups AS (
      SELECT i.*, f.first_fp AS leader_fp, (i.fp = f.first_fp) AS is_leader
      FROM fz_items i JOIN fz_title_map m ON m.nt = i.nt JOIN fz_first f ON f.tid = m.leader_tid)"""


# ---------------------------------------------------------------- topics

def py_title_sql(x: str) -> str:
    chars = f"string_split({x}, '')"
    return (
        f"array_to_string(list_transform({chars}, lambda c, i: CASE WHEN i = 1 OR NOT regexp_full_match({chars}[i - 1], "
        f"'[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]') THEN upper(c) ELSE lower(c) END), '')"
    )


def topic_ctes(src: str) -> str:
    """Keywords, clique pairs (>= 2 shared), components by recursive
    reachability, and per-cluster summaries over ``src`` (needs item, score,
    r_tier, r_neg_pub, r_pos, title, description, cve_ids)."""
    return f"""
    tp_items AS (SELECT *, {keywords_expr(keyword_text())} AS keywords FROM {src}),
    tp_kw AS (SELECT item, unnest(keywords) AS kw FROM tp_items),
    tp_pairs AS (
      SELECT a.item AS a, b.item AS b, count(*) AS n_shared
      FROM tp_kw a JOIN tp_kw b ON a.kw = b.kw AND a.item < b.item
      GROUP BY a.item, b.item HAVING count(*) >= {C.CLUSTER_MIN_SHARED}),
    tp_edges AS (SELECT a AS x, b AS y FROM tp_pairs UNION ALL SELECT b AS x, a AS y FROM tp_pairs),
    tp_reach AS (
      WITH RECURSIVE r(node, label) AS (
        SELECT x, x FROM tp_edges
        UNION
        SELECT e.y, r.label FROM r JOIN tp_edges e ON e.x = r.node)
      SELECT node, min(label) AS comp FROM r GROUP BY node),
    tp_members AS (
      SELECT i.*, coalesce(c.comp, -1) AS comp, c.comp IS NULL AS is_other
      FROM tp_items i LEFT JOIN tp_reach c ON c.node = i.item),
    tp_freq AS (
      SELECT comp, kw, count(*) AS cnt FROM (SELECT comp, unnest(keywords) AS kw FROM tp_members WHERE NOT is_other)
      GROUP BY comp, kw),
    tp_names AS (SELECT comp, first(kw ORDER BY cnt DESC, kw ASC) AS name_kw FROM tp_freq GROUP BY comp),
    tp_shared AS (
      SELECT comp, list(kw ORDER BY cnt DESC, kw ASC)[1:{C.CLUSTER_SHARED_SHOWN}] AS shared_keywords
      FROM tp_freq WHERE cnt >= 2 GROUP BY comp),
    tp_summary AS (
      SELECT comp, is_other, count(*) AS size, max(score) AS top_score,
             first(item ORDER BY score DESC, r_tier, r_neg_pub, r_pos) AS lead_item,
             first(r_tier ORDER BY score DESC, r_tier, r_neg_pub, r_pos) AS l_tier,
             first(r_neg_pub ORDER BY score DESC, r_tier, r_neg_pub, r_pos) AS l_neg,
             first(r_pos ORDER BY score DESC, r_tier, r_neg_pub, r_pos) AS l_pos
      FROM tp_members GROUP BY comp, is_other),
    tp_clusters AS (
      SELECT s.*,
             CASE WHEN s.is_other THEN {q(C.CLUSTER_OTHER_NAME)}
                  WHEN starts_with(n.name_kw, 'CVE-') THEN upper(n.name_kw)
                  ELSE {py_title_sql('n.name_kw')} END AS name,
             CASE WHEN s.is_other THEN []::VARCHAR[] ELSE coalesce(sh.shared_keywords, []::VARCHAR[]) END AS shared_keywords,
             row_number() OVER (ORDER BY s.top_score DESC, s.is_other, -s.top_score, s.l_tier, s.l_neg, s.l_pos) AS cluster_rank
      FROM tp_summary s LEFT JOIN tp_names n ON n.comp = s.comp LEFT JOIN tp_shared sh ON sh.comp = s.comp)"""


def topic_input_cte(name: str = "topic_src") -> str:
    """Exact-dedup survivors, scored, at or above the default minimum score."""
    return f"""
    {name}_s AS (SELECT *, {score_expr()} AS score FROM canon),
    {name} AS (
      SELECT *, pos AS item, source_tier AS r_tier, -epoch_us(published) AS r_neg_pub, pos AS r_pos
      FROM {name}_s WHERE score >= {C.DEFAULT_MIN_SCORE})"""


# ---------------------------------------------------------------- composite reports

def window_cte(hours: int, categories: list[str] | None, name: str = "win") -> str:
    cond = f"published >= {NOW_SQL} - INTERVAL {hours} HOUR"
    if categories:
        cond += " AND source_category IN (" + ", ".join(q(c) for c in categories) + ")"
    return f"{name} AS (SELECT * FROM news_items WHERE {cond})"


def survivors_ctes(threshold: float) -> str:
    """Exact + fuzzy dedup over ``win``; attribution in long form; scores."""
    return ",\n".join(
        [
            exact_cte("win").strip(),
            exact_attr_cte("canon_fp").strip(),
            fuzzy_ctes("canon", threshold).strip(),
            """attr AS (
      SELECT g.fp, 0 AS stage, a.ord AS o1, 0::BIGINT AS o2, 0::BIGINT AS o3, a.source_name
      FROM fz_groups g JOIN exact_attr a ON a.fp = g.fp WHERE g.is_leader AND a.ord IS NOT NULL
      UNION ALL
      SELECT leader_fp AS fp, 1 AS stage, r_tier::BIGINT AS o1, r_neg_pub AS o2, r_pos AS o3, source_name
      FROM fz_groups WHERE NOT is_leader)""",
            """attr_list AS (
      SELECT fp, count(*) AS n_dup, list(source_name ORDER BY stage, o1, o2, o3) AS names FROM attr GROUP BY fp)""",
            f"""surv AS (
      SELECT g.*, coalesce(l.n_dup, 0) AS n_dup, coalesce(l.names, []::VARCHAR[]) AS names, {score_expr()} AS score
      FROM fz_groups g LEFT JOIN attr_list l ON l.fp = g.fp WHERE g.is_leader)""",
        ]
    )


def age_label_sql(a: str) -> str:
    return (
        f"CASE WHEN {a} < 1 THEN concat(floor({a} * 60)::BIGINT, 'm ago') WHEN {a} < 24 THEN concat(round_even({a}, 0)::BIGINT, 'h ago') "
        f"ELSE concat(round_even({a} / 24, 0)::BIGINT, 'd ago') END"
    )


def severity_sql() -> str:
    return (
        "CASE WHEN cvss_score IS NOT NULL THEN (CASE "
        + " ".join(f"WHEN cvss_score >= {t} THEN {q(l)}" for t, l in C.SEVERITY_CVSS)
        + f" ELSE {q(C.SEVERITY_CVSS_ELSE)} END) ELSE (CASE "
        + " ".join(f"WHEN score >= {t} THEN {q(l)}" for t, l in C.SEVERITY_SCORE)
        + f" ELSE {q(C.SEVERITY_SCORE_ELSE)} END) END"
    )


def band_sql(col: str, else_label: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {t} THEN {q(l)}" for t, l in C.SCORE_BANDS) + f" ELSE {q(else_label)} END"


# ---------------------------------------------------------------- enrichment

def enrichment_ctes(resp_src: str = "responses_t") -> str:
    types = "[" + ", ".join(q(t) for t in C.ENRICH_INCIDENT_TYPES) + "]"
    keys = "[" + ", ".join(q(k) for k in C.ENRICH_REQUIRED_FIELDS) + "]"
    ws = "'^\\s+|\\s+$'"

    def text_field(k: str, default: str) -> str:
        t = f"json_type(j, '$.{k}')"
        v = f"(j->>'$.{k}')"
        falsy = (
            f"{v} IS NULL OR {v} = '' OR ({t} = 'BOOLEAN' AND {v} = 'false') "
            f"OR ({t} IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') AND TRY_CAST({v} AS DOUBLE) = 0) "
            f"OR ({t} = 'ARRAY' AND {v} = '[]') OR ({t} = 'OBJECT' AND {v} = '{{}}')"
        )
        return f"CASE WHEN {falsy} THEN {q(default)} ELSE {v} END"

    num = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
    return f"""
    en_resp AS (SELECT seq, min(raw) AS raw FROM {resp_src} GROUP BY seq),
    en_clean AS (
      SELECT seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, {ws}, '', 'g'),
                 '^```(?:json)?\\s*', ''), '\\s*```$', ''), {ws}, '', 'g') AS c
      FROM en_resp),
    en_parsed AS (SELECT seq, c, CASE WHEN json_valid(c) THEN c::JSON END AS j FROM en_clean),
    en_valid AS (
      SELECT seq, j FROM en_parsed
      WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'
        AND list_has_all(json_keys(j), {keys})
        AND json_type(j, '$.incident_type') = 'VARCHAR' AND list_contains({types}, j->>'$.incident_type')
        AND (json_type(j, '$.ai_score_boost') IN {num} OR json_type(j, '$.ai_score_boost') = 'BOOLEAN')),
    en_fields AS (
      SELECT seq,
             {text_field('incident_type', C.INCIDENT_TYPE_DEFAULT)} AS incident_type,
             {text_field('victim', C.VICTIM_DEFAULT)} AS victim,
             {text_field('impact', C.IMPACT_DEFAULT)} AS impact,
             {text_field('root_cause', C.ROOT_CAUSE_DEFAULT)} AS root_cause,
             CASE WHEN json_type(j, '$.is_fixed') = 'BOOLEAN' THEN (j->>'$.is_fixed') = 'true'
                  WHEN json_type(j, '$.is_fixed') = 'VARCHAR' AND lower(j->>'$.is_fixed') IN ('true', 'false') THEN lower(j->>'$.is_fixed') = 'true'
                  WHEN json_type(j, '$.is_fixed') IN {num} AND TRY_CAST(j->>'$.is_fixed' AS DOUBLE) = 1 THEN true
                  WHEN json_type(j, '$.is_fixed') IN {num} AND TRY_CAST(j->>'$.is_fixed' AS DOUBLE) = 0 THEN false
                  ELSE NULL END AS is_fixed,
             {text_field('severity_rationale', '')} AS severity_rationale,
             coalesce(least(greatest(CASE WHEN json_type(j, '$.ai_score_boost') = 'BOOLEAN'
                                          THEN CASE WHEN (j->>'$.ai_score_boost') = 'true' THEN 1.0 ELSE 0.0 END
                                          ELSE TRY_CAST(j->>'$.ai_score_boost' AS DOUBLE) END, 0.0), 20.0), 0.0) AS ai_score_boost
      FROM en_valid)"""
