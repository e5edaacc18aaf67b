"""URL filters: allow and block rules first, then a weighted vocabulary.

Rules are (host, path) pairs: a rule fits its host and all subdomains where the URL's path starts
with the rule's path; the longest fitting rule decides. Where none fits, an Aho-Corasick automaton
finds all terms of the vocabulary in the whole lower-cased URL in one pass. A hit counts only
between boundaries (no ASCII letter or digit next to it). One strict term, or ``SOFT_HITS`` distinct
soft terms, block the URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path, so no rule fits; the
vocabulary still sees its text (null: allow). Upper case A-Z counts as lower case. Repeated rows
are judged alike. An empty table gives an empty result, an empty vocabulary no hits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.shipping import map_in_arrow
from stemma.llm.common import table

#: Fixed values of the contract: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The rules of the SQL, which is left as it was: it blocks net/de/, where the contract allows.
SQL_RULES = tuple(("block", h, p) if (h, p) == ("net", "/de/") else (verdict, h, p) for verdict, h, p in RULES)
#: Terms of which one is enough.
STRICT = (
    "adult", "bets", "bitch", "camgirls", "casino", "casinos", "escort", "escorts", "gambling", "hardcore", "hentai",
    "malware", "milf", "nude", "nudes", "phishing", "pills", "poker", "porn", "porno", "roulette", "sex", "slots",
    "spam", "torrent", "viagra", "warez", "xxx",
)
#: Terms that are suspicious only together.
SOFT = (
    "ads", "banner", "bet", "bonus", "cams", "cash", "cheap", "click", "coupon", "crack", "dating", "deal", "deals",
    "discount", "download", "farm", "free", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "money", "offer",
    "pharma", "pharmacy", "popup", "prize", "promo", "rich", "sale", "seo", "sponsor", "track", "tracker", "traffic",
    "win", "winner", "x",
)
SOFT_HITS = 2
#: Terms of a vocabulary at most: every Python worker holds them all (some 200 bytes a term).
MOST_TERMS = 2_000_000
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for term in soft:
        made.add_word(term, (len(term), term, False))
    for term in strict:
        made.add_word(term, (len(term), term, True))
    made.make_automaton()
    return made


def hits(url: str | None, made: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and distinct soft terms of a lower-cased URL, between boundaries."""
    if not url or not len(made):
        return 0, 0
    found: tuple[set[str], set[str]] = (set(), set())
    for end, (n, term, hard) in made.iter(url):
        start = end + 1 - n
        if (start == 0 or url[start - 1] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
            found[0 if hard else 1].add(term)
    return len(found[0]), len(found[1])


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return _lower(host), path


def best_rule(host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = None
    for verdict, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        named = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, named) if found is None else found.when(fits, named)
    return found


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table (term, weight): weight ``strict`` or ``soft``; a term with both is strict.

    Terms are lower-cased (A-Z); null and empty ones are left out. More than ``MOST_TERMS`` are refused, as each worker holds them.
    """
    used = terms.select(_lower(F.col("term")).alias("term"), "weight").where("length(term) > 0 and weight in ('strict', 'soft')")
    got = used.groupBy("term").agg(F.max(F.col("weight") == "strict").alias("hard")).limit(MOST_TERMS + 1).collect()
    if len(got) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(sorted(r["term"] for r in got if r["hard"])), tuple(sorted(r["term"] for r in got if not r["hard"]))


def apply(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), terms: DataFrame | None = None) -> DataFrame:
    """``keep`` columns with host, path, rule, n_strict, n_soft, verdict.

    ``terms`` is a vocabulary as :func:`vocabulary` takes it, instead of ``STRICT`` and ``SOFT``. A kept column of one of the new names
    comes out as ``own_`` and that name.
    """
    new = {"host", "path", "rule", "n_strict", "n_soft", "verdict"}
    pages = pages.select(*[F.col(c).alias(f"own_{c}" if c in new else c) for c in keep if c != url], F.col(url).alias("__link"))
    keep = tuple(f"own_{c}" if c in new else c for c in keep)
    if url in keep:
        pages = pages.withColumn(url, F.col("__link"))
    url = "__link"
    strict, soft = (STRICT, SOFT) if terms is None else vocabulary(terms)
    held = pages.sparkSession.sparkContext.broadcast((strict, soft))
    seen = pages.select(*keep, F.struct(F.col(url).alias("url"), _lower(F.col(url)).alias("low")).alias("__u"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    added = ["__url", "n_strict", "n_soft"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(*held.value)
        for b in batches:
            raw, low = b.column(b.num_columns - 1).flatten()
            found = [hits(u, made) for u in low.to_pylist()]
            cols = [*b.columns[:-1], raw, *(pa.array([f[k] for f in found], pa.int32()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], *added])

    counted = seen.transform(map_in_arrow, count, f"{kept}, __url string, n_strict int, n_soft int")
    host, path = host_and_path(F.col("__url"))
    judged = counted.withColumns({"host": host, "path": path}).withColumn("__r", best_rule(F.col("host"), F.col("path")))
    bad = (F.col("n_strict") > 0) | (F.col("n_soft") >= SOFT_HITS)
    verdict = F.coalesce(F.col("__r")["verdict"], F.when(bad, "block").otherwise("allow"))
    return judged.select(*keep, "host", "path", F.col("__r")["rule"].alias("rule"), "n_strict", "n_soft", verdict.alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: host, path, rule and verdict of every URL."""
    return apply(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rules = sorted(SQL_RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: " ".join(f"when {fits.format(h=r[1], p=r[2])} then '{pick(r)}'" for r in rules)
    hit = "regexp_matches(low, '(^|[^a-z0-9])({t})([^a-z0-9]|$)')"
    count = lambda terms: " + ".join(f"{hit.format(t=t)}::int" for t in terms)
    return f"""
with u as (select page_id, coalesce(url, '') as url, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') as low from pages),
r as (select *, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from u),
h as (select *, regexp_extract(rest, '^[^/?#]*', 0, 's') as raw_host from r),
p as (
  select page_id, low, translate(raw_host, '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*', 0, 's') as path from h),
c as (select *, ({count(STRICT)})::int as n_strict, ({count(SOFT)})::int as n_soft from p)
select page_id, host, path, case {case(lambda r: r[1] + r[2])} end as rule, n_strict, n_soft,
  case {case(lambda r: r[0])} when n_strict > 0 or n_soft >= {SOFT_HITS} then 'block' else 'allow' end as verdict
from c"""


ORACLE_SQL = _sql()
