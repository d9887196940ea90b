"""Complaint-rule compiler: ordered regex rules -> one native column expression.

A rule set is a list of (category, [patterns]) in priority order.  All its patterns become
one regex, a trie of their letters behind a look-ahead, that scans a text once and yields at
every word where some pattern begins the longest text any of them matches there
(``found``).  Whatever a pattern matches in the text it matches, first match first, in these
short pieces, so the category, the keywords and their order are read from them: a
``CASE WHEN pieces RLIKE <the category's patterns> ...`` chain whose first match wins.  All
of it is evaluated by the JVM regex engine inside codegen - no Python per row.  ``(?U)``
makes ``\\w`` and ``\\b`` Unicode-aware, as in Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (DASHBOARD_RULES, DEFAULT_ROUTING, DEFAULT_SEVERITY, NO_COMPLAINT,
                      NO_COMPLAINT_TEXTS, NOTEBOOK_RULES, OTHER_CATEGORY, ROUTING, SEVERITY)

RULE_SETS = {"dashboard": DASHBOARD_RULES, "notebook": NOTEBOOK_RULES}


def rules(name: str = "dashboard", fix_pnr: bool = False) -> list[tuple[str, list[str]]]:
    """A rule set by name.  ``fix_pnr`` lower-cases the upper-case PNR pattern of the
    dashboard set, which otherwise can never match lower-cased text."""
    out = [(cat, list(pats)) for cat, pats in RULE_SETS[name]]
    if fix_pnr:
        out = [(cat, [p.lower() if p == r"\bPNR\b" else p for p in pats]) for cat, pats in out]
    return out


def category_regex(patterns: Sequence[str]) -> str:
    return "(?U)" + "|".join(f"(?:{p})" for p in patterns)


_ATOM = re.compile(r"\\w[*+]|\\b|.\??")


def rule_trie(rule_set: Sequence[tuple[str, Sequence[str]]]) -> str:
    """One regex for all patterns of a rule set, common beginnings written once.

    A pattern is a word boundary, letters (one may be optional) or ``\\w`` runs, and a word
    boundary.  At a branch letters come before ``\\w`` runs and an end comes last, so the
    longest pattern that fits is the one found.
    """
    root: dict = {}
    for _, patterns in rule_set:
        for p in patterns:
            atoms = _ATOM.findall(p)
            if "".join(atoms) != p or atoms[0] != r"\b" or atoms[-1] != r"\b" or r"\b" in atoms[1:-1]:
                raise ValueError(f"not a pattern between word boundaries: {p}")
            node = root
            for a in atoms[1:]:
                node = node.setdefault(a, {})

    def text(node: dict) -> str:
        ways = [a + text(node[a]) for a in sorted(node, key=lambda a: (a == r"\b", a.startswith(r"\w"), a))]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""
    return text(root)


def found(text: Column, rule_set: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """What the rules find in lower(text), in order, one piece to a line (null text: null)."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b(?=({rule_trie(rule_set)}))"), F.lit(1))
    return F.array_join(pieces, "\n")


def category_of(pieces: Column, rule_set: Sequence[tuple[str, Sequence[str]]],
                other: str = OTHER_CATEGORY) -> Column:
    """T1 from ``found`` pieces: the first category (priority order) with a pattern in them."""
    expr = F.when(pieces.isNull() | (pieces == ""), F.lit(other))
    for cat, pats in rule_set:
        expr = expr.when(pieces.rlike(category_regex(pats)), F.lit(cat))
    return expr.otherwise(F.lit(other))


def classify(text: Column, rule_set: Sequence[tuple[str, Sequence[str]]],
             other: str = OTHER_CATEGORY) -> Column:
    """First category (priority order) with a pattern found in lower(text).

    As one expression; where the pieces are needed again (``tag``), keep them as a column.
    """
    return F.element_at(F.transform(F.array(found(text, rule_set)), lambda p: category_of(p, rule_set, other)), 1)


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def classify_notebook(text: Column, rule_set=None) -> Column:
    """Notebook variant - trimmed lower text; '', 'nan', 'no' -> 'No Complaint'."""
    rule_set = rule_set or rules("notebook")
    t = strip(F.lower(F.coalesce(text.cast("string"), F.lit("nan"))))
    return F.when(t.isin(*NO_COMPLAINT_TEXTS), F.lit(NO_COMPLAINT)).otherwise(classify(t, rule_set))


def keywords_of(pieces: Column, rule_set: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """T5 from ``found`` pieces: the first match of every pattern, distinct and sorted."""
    hits = [F.regexp_substr(pieces, F.lit("(?U)" + p)) for _, pats in rule_set for p in pats]
    none = F.array().cast("array<string>")
    return F.when(pieces.isNull() | (pieces == ""), none).otherwise(
        F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))))


def matched_keywords(text: Column, rule_set: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """T5: the first match of every pattern of every category, distinct and sorted."""
    return F.element_at(F.transform(F.array(found(text, rule_set)), lambda p: keywords_of(p, rule_set)), 1)


def _lookup(mapping: dict, key: Column, default: str) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def severity(category: Column) -> Column:
    """Severity of a category, Low when not listed."""
    return _lookup(SEVERITY, category, DEFAULT_SEVERITY)


def routing_team(category: Column) -> Column:
    """T4: routing team of a category."""
    return _lookup({k: v[0] for k, v in ROUTING.items()}, category, DEFAULT_ROUTING[0])


def routing_action(category: Column) -> Column:
    """T4: suggested action of a category."""
    return _lookup({k: v[1] for k, v in ROUTING.items()}, category, DEFAULT_ROUTING[1])


def has_complaint(text: Column, mode: str = "length") -> Column:
    """the four definitions of 'this booking has a complaint'.

    nonempty - not NULL and not '';  not_no - also not 'No';  length - length > 0
    (NULL -> false);  stripped - trimmed lower text not in {'nan', 'none', ''}.
    """
    if mode == "nonempty":
        cond = text.isNotNull() & (text != "")
    elif mode == "not_no":
        cond = text.isNotNull() & (text != "") & (text != "No")
    elif mode == "length":
        cond = F.length(text) > 0
    elif mode == "stripped":
        cond = text.isNotNull() & ~strip(F.lower(text)).isin("nan", "none", "")
    else:
        raise ValueError(f"unknown complaint mode {mode!r}")
    return F.coalesce(cond, F.lit(False))
