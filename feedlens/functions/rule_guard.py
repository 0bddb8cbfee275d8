"""Literal pre-checks for regex rules.

Every top-level alternative of a rule needs some run of plain literal
characters (or one of a mandatory group's alternatives) to be present. A
``contains`` test on the lower-cased text for those literals is a
necessary condition for the regex, so it can run first and skip the
regex scan on texts that cannot match. Characters whose case folding
reaches ASCII letters but that ``lower()`` leaves alone (ſ, ı, İ) switch
the pre-check off for that row, so the combined test stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIT = set("abcdefghijklmnopqrstuvwxyz0123456789 -")

def _split_top(p):
    parts, depth, cur, i, cls = [], 0, "", 0, False
    while i < len(p):
        ch = p[i]
        if ch == "\\":
            cur += p[i:i+2]; i += 2; continue
        if cls:
            if ch == "]": cls = False
        elif ch == "[": cls = True
        elif ch == "(": depth += 1
        elif ch == ")": depth -= 1
        elif ch == "|" and depth == 0:
            parts.append(cur); cur = ""; i += 1; continue
        cur += ch; i += 1
    parts.append(cur)
    return parts

def _runs(alt):
    runs, cur, i = [], "", 0
    def brk():
        nonlocal cur
        if cur: runs.append(cur)
        cur = ""
    while i < len(alt):
        ch = alt[i]
        nxt = alt[i+1] if i + 1 < len(alt) else ""
        if ch == "\\":
            brk(); i += 2
            if i < len(alt) and alt[i] in "?*+{": brk(); i += 1
            continue
        if ch == "[":
            brk(); j = alt.index("]", i + 1); i = j + 1
            if i < len(alt) and alt[i] in "?*+{": i += 1
            continue
        if ch == "(":
            brk(); depth = 0; j = i
            while True:
                c = alt[j]
                if c == "\\": j += 2; continue
                if c == "(": depth += 1
                elif c == ")":
                    depth -= 1
                    if depth == 0: break
                j += 1
            i = j + 1
            if i < len(alt) and alt[i] in "?*+{": i += 1
            continue
        low = ch.lower()
        if low in LIT and ch.isascii():
            if nxt and (nxt in "?*" or nxt == "{"):
                brk(); i += 2 if nxt in "?*" else alt.index("}", i) + 1 - i; continue
            if nxt and nxt == "+":
                cur += low; brk(); i += 2; continue
            cur += low; i += 1; continue
        brk(); i += 1
    brk()
    return runs

def _mandatory_groups(alt):
    out, i = [], 0
    while i < len(alt):
        ch = alt[i]
        if ch == "\\":
            i += 2; continue
        if ch == "[":
            i = alt.index("]", i + 1) + 1; continue
        if ch == "(":
            depth, j = 0, i
            while True:
                c = alt[j]
                if c == "\\": j += 2; continue
                if c == "(": depth += 1
                elif c == ")":
                    depth -= 1
                    if depth == 0: break
                j += 1
            body = alt[i + 1:j]
            if body.startswith("?:"):
                body = body[2:]
            elif body.startswith("?"):
                body = None  # lookaround: not a consuming requirement
            after = alt[j + 1] if j + 1 < len(alt) else ""
            if body is not None and not (after and after in "?*{"):
                out.append(body)
            i = j + 1; continue
        i += 1
    return out


def literals(pattern, min_len=3):
    lits = []
    for alt in _split_top(pattern):
        runs = [r for r in _runs(alt) if len(r.strip()) >= min_len]
        if runs:
            lits.append(max(runs, key=len))
            continue
        sub = None
        for g in _mandatory_groups(alt):
            sub = literals(g, min_len)
            if sub:
                break
        if not sub:
            return None
        lits.extend(sub)
    return lits


FOLD_RISK = "[\u017f\u0131\u0130]"


def guard(text: Column, pattern: str) -> Column:
    """A cheap necessary condition for ``text rlike (?i)pattern``."""
    lits = literals(pattern)
    if not lits:
        return F.lit(True)
    low = F.lower(text)
    cond = text.rlike(FOLD_RISK)
    for lit in dict.fromkeys(lits):
        cond = cond | low.contains(lit)
    return cond
