"""Text scalar functions as native column expressions.

Python's regex classes are Unicode-aware; Java's are ASCII unless asked.
Patterns here spell the classes out (``\\p{L}``, ``\\p{Nd}``) or use the
``(?U)`` flag so both sides agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

WORD_CLASS = r"\p{L}\p{N}_"          # Python's Unicode \w
# Python's Unicode whitespace (str.isspace), spelled out so Java agrees
PY_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CVE_PATTERN = r"(?i)CVE-\p{Nd}{4}-\p{Nd}{4,7}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove all leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(x), f"^{PY_WS}+|{PY_WS}+$", "")


def strip_html(x) -> Column:
    """Tags → single space, then strip."""
    return py_strip(F.regexp_replace(_c(x), r"<[^>]+>", " "))


def collapse_truncate(x, n: int = C.DESCRIPTION_MAX) -> Column:
    """Runs of whitespace → one space, keep the first ``n`` characters."""
    return F.substring(F.regexp_replace(_c(x), f"{PY_WS}+", " "), 1, n)


def normalize_title(x) -> Column:
    """Lower, non-word runs → space, trim."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), f"[^{WORD_CLASS}]+", " "))


def normalize_url(x) -> Column:
    """Cut at the first '?', strip trailing '/', lower."""
    return F.lower(F.rtrim(F.substring_index(_c(x), "?", 1), F.lit("/")))


def fingerprint(title, url) -> Column:
    """First 16 hex chars of sha256(norm_title || '|' || norm_url)."""
    return F.substring(F.sha2(F.concat_ws("|", normalize_title(title), normalize_url(url)), 256), 1, 16)


SAFE_URL_PATTERN = r"^(?i)https?://[^/?#]+"


def safe_url(x) -> Column:
    """Keep the url when its scheme is http(s) and it has an authority."""
    u = _c(x)
    return F.when(u.rlike(SAFE_URL_PATTERN), u)


def extract_cves(x) -> Column:
    """Distinct upper-cased CVE ids, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_c(x), F.lit(CVE_PATTERN), 0), F.upper)))


def capitalized_nouns(x) -> Column:
    """Whole words shaped ``[A-Z][a-z]{3,}``, lower-cased, minus stop words.

    A ``\\b…\\b`` match is exactly a maximal run of word characters, so we
    split on non-word runs and test each run; no lookaround needed.
    """
    words = F.split(_c(x), f"[^{WORD_CLASS}]+")
    caps = F.filter(words, lambda w: w.rlike(r"^[A-Z][a-z]{3,}$"))
    stop = F.array(*[F.lit(s) for s in C.NOUN_STOPWORDS])
    return F.array_except(F.transform(caps, F.lower), stop)


def known_terms() -> list[str]:
    seen: list[str] = []
    for t in C.THREAT_ACTORS + C.ATTACK_TYPES + C.PRODUCTS:
        if t not in seen:
            seen.append(t)
    return seen


def known_term_hits(lower_text: Column, terms: list[str] | None = None) -> Column:
    """Dictionary terms contained in the (already lower-cased) text.

    The text is named once and tested for every term: Spark writes a column's whole expression in place of its name
    when it moves a filter, so a name for each term would make it compute the text anew for each.
    """
    terms = known_terms() if terms is None else terms
    return F.flatten(F.transform(F.array(lower_text), lambda x: F.array_compact(F.array(*[F.when(x.contains(t), F.lit(t)) for t in terms]))))


def extract_keywords(text) -> Column:
    """CVE ids ∪ dictionary terms ∪ capitalised nouns (sorted set)."""
    t = _c(text)
    return F.array_sort(
        F.array_union(F.array_union(extract_cves(t), known_term_hits(F.lower(t))), capitalized_nouns(t))
    )


def keyword_text(title="title", description="description", cve_ids="cve_ids") -> Column:
    return F.concat_ws(" ", _c(title), _c(description), F.array_join(_c(cve_ids), " "))


def py_title(x) -> Column:
    """Python ``str.title()``: upper after a non-cased char, lower after a cased one.

    Characters meet the one before them in two arrays side by side, so a word's cost grows with its length, not its square.
    """
    chars = F.split(_c(x), "")
    before = F.concat(F.array(F.lit("")), chars)  # one longer: its last element meets no character and is not joined
    titled = F.zip_with(chars, before, lambda c, b: F.when(b.rlike(r"^[\p{Lu}\p{Ll}\p{Lt}]$"), F.lower(c)).otherwise(F.upper(c)))
    return F.array_join(titled, "")


def cluster_display_name(kw) -> Column:
    k = _c(kw)
    return F.when(k.startswith("CVE-"), F.upper(k)).otherwise(py_title(k))


def truncate_ellipsis(x, n: int, rstrip: bool = False) -> Column:
    """First ``n`` chars plus '...' when longer."""
    s = _c(x)
    head = F.substring(s, 1, n)
    if rstrip:
        head = F.regexp_replace(head, f"{PY_WS}+$", "")
    return F.concat(head, F.when(F.length(s) > n, F.lit("...")).otherwise(F.lit("")))


def first_n(arr, n: int) -> Column:
    """First ``n`` elements of an ordered list."""
    return F.slice(_c(arr), 1, n)


def contains_any(lower_text: Column, terms: list[str]) -> Column:
    """any term (lower-cased) is a substring of the lower-cased text, which is named once (see ``known_term_hits``)."""

    def any_in(x: Column) -> Column:
        cond = F.lit(False)
        for t in terms:
            cond = cond | x.contains(t.lower())
        return cond

    return F.exists(F.array(lower_text), any_in)


def count_contained(lower_text: Column, terms: list[str]) -> Column:
    """How many list entries are substrings (repeated entries count again)."""
    total = F.lit(0)
    for t in terms:
        total = total + F.when(lower_text.contains(t.lower()), 1).otherwise(0)
    return total
