"""Lexical normalisation and tokens as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column, collapse_hyphen: bool = True, keep: str = "+#.") -> Column:
    """Lower case, hyphens, slashes and underscores to blanks, only letters, digits and ``keep``; null is empty."""
    kept = "".join("\\" + x if x in r"\]^-[&" else x for x in keep if not (collapse_hyphen and x in "-/_"))
    # one pass: runs of white space and of all that isn't kept become one blank
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}{kept}]+", " "))


def tokens(text: Column, collapse_hyphen: bool = False) -> Column:
    """Array of tokens. Hyphens stay inside tokens unless ``collapse_hyphen``."""
    c = normalize(text) if collapse_hyphen else normalize(text, collapse_hyphen=False, keep="+#.-")
    return F.array_remove(F.split(c, " "), "")


def normalize_py(text: str | None, collapse_hyphen: bool = True, keep: str = "+#.") -> str:
    """The same for a query that the driver holds."""
    c = (text or "").lower()
    if collapse_hyphen:
        c = re.sub("[-/_]+", " ", c)
    c = "".join(x if x.isalnum() or x.isspace() or x in keep else " " for x in c)
    return " ".join(c.split())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_tokens(norm: Column) -> Column:
    """Number of tokens of a normalised text."""
    return F.when(norm == "", 0).otherwise(F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("int")


def spaced(norm: Column) -> Column:
    """A normalised text with two blanks between tokens and one around, so that occurrences of ``" token "`` don't overlap."""
    return F.concat(F.lit(" "), F.replace(norm, F.lit(" "), F.lit("  ")), F.lit(" "))


def times(wide: Column, token: str) -> Column:
    """How often a token is in a :func:`spaced` text, by two byte searches."""
    part = f" {token} "
    return ((F.octet_length(wide) - F.octet_length(F.replace(wide, F.lit(part), F.lit("")))) / len(part.encode())).cast("int")


def query_terms(query: str, collapse_hyphen: bool = False) -> list[str]:
    """Distinct tokens of a query, sorted."""
    keep = "+#." if collapse_hyphen else "+#.-"
    return sorted(set(normalize_py(query, collapse_hyphen, keep).split()))


def keyword_pattern(keyword: str, case_insensitive: bool = True, whole_term: bool = True) -> str:
    """Java pattern of a keyword on normalised text."""
    norm = normalize_py(keyword)
    if not norm:
        raise ValueError("a keyword must hold a letter or a digit")
    body = r"\s+".join(re.sub(r"([\\.^$|?*+()\[\]{}#])", r"\\\1", w) for w in norm.split())
    if whole_term:
        body = rf"(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])"
    return ("(?i)" if case_insensitive else "") + body


def contains_ci(query: str, *cols: Column) -> Column:
    """Case-insensitive literal substring of any column; nulls don't match."""
    q = query.lower()
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(q)), F.lit(False))
    return hit
