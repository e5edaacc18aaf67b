"""Paged queries of bibliographic services through a transport that the caller gives.

Nothing here opens a connection: a transport is a function (url, params) -> :class:`Reply`. Services want one polite client, so
pages are asked for one after another; what they hold is landed in files and parsed by Spark.
"""

from __future__ import annotations

import email.utils
import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.sources import providers, records, tables

#: Where the services answer.
ATOM = "http://export.arxiv.org/api/query"
CROSSREF = "https://api.crossref.org"
DATACITE = "https://api.datacite.org/dois"
ZENODO = "https://zenodo.org/api/records"
DOI = "https://doi.org"
PAGE, DELAY, RETRIES, ROWS = 100, 3.0, 6, 1000


@dataclass
class Reply:
    status: int
    text: str = ""
    headers: dict[str, str] = field(default_factory=dict)


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds to wait that a Retry-After header asks for: a number or a date."""
    if not value:
        return None
    if re.fullmatch(r"\d+(\.\d+)?", value.strip()):
        return float(value)
    try:
        at = email.utils.parsedate_to_datetime(value).timestamp()
    except ValueError:
        return None
    return max(0.0, at - (time.time() if now is None else now))


@dataclass
class Client:
    """Asks again after 429 and 5xx: after the time that the service names, else after doubling waits."""

    transport: Callable[[str, dict], Reply]
    retries: int = RETRIES
    delay: float = DELAY
    sleep: Callable[[float], None] = time.sleep

    def get(self, url: str, params: dict | None = None) -> str | None:
        """The text of an answer; None where there is nothing (404)."""
        for k in range(self.retries + 1):
            got = self.transport(url, params or {})
            if got.status == 200:
                return got.text
            if got.status == 404:
                return None
            if got.status != 429 and got.status < 500:
                break
            if k < self.retries:
                named = retry_after({n.lower(): v for n, v in got.headers.items()}.get("retry-after"))
                self.sleep(self.delay * 2**k if named is None else named)
        raise OSError(f"{url} answered {got.status}")


def atom_params(ids: list[str] | None = None, search: str | None = None, start: int = 0, most: int = PAGE, by: str = "submittedDate", order: str = "descending") -> dict:
    if not ids and not search:
        raise ValueError("neither ids nor a search")
    out: dict = {"start": start, "max_results": most}
    if ids:
        out["id_list"] = ",".join(ids)
    if search:
        out |= {"search_query": search, "sortBy": by, "sortOrder": order}
    return out


def atom_entries(feed: str) -> list[str]:
    """The entries of a feed, each as XML of its own."""
    return re.findall(r"(?s)<entry\b.*?</entry>", feed)


def atom_pages(client: Client, search: str | None = None, ids: list[str] | None = None, limit: int | None = None, page: int = PAGE, **order) -> Iterator[str]:
    """Entries page after page, until a page isn't full; a pause between pages."""
    start = 0
    while limit is None or start < limit:
        most = page if limit is None else min(page, limit - start)
        some = atom_entries(client.get(ATOM, atom_params(ids, search, start, most, **order)) or "")
        yield from some
        start += len(some)
        if len(some) < most:
            return
        client.sleep(client.delay)


def filters(given: str | dict | None) -> str | None:
    """``name:value`` pairs, joined by commas, of a text of such pairs or a dictionary; pairs without a value are errors."""
    if not given:
        return None
    pairs = list(given.items()) if isinstance(given, dict) else [tuple(p.strip().split(":", 1)) for p in given.split(",")]
    if any(len(p) != 2 or not p[0] or not str(p[1]) for p in pairs):
        raise ValueError(f"not a filter: {given}")
    return ",".join(f"{k}:{v}" for k, v in pairs)


def crossref_works(client: Client, given: str | dict | None = None, query: str | None = None, limit: int = 20) -> list[str]:
    params = {"filter": filters(given), "query": query, "rows": limit}
    answer = client.get(f"{CROSSREF}/works", {k: v for k, v in params.items() if v is not None})
    return [json.dumps(x) for x in json.loads(answer or "{}").get("message", {}).get("items", [])]


def crossref_journal(client: Client, issn: str, limit: int | None = None, rows: int = ROWS, since: str | None = None) -> Iterator[str]:
    """All works of a journal, by cursor."""
    cursor, n = "*", 0
    while cursor and (limit is None or n < limit):
        params = {"cursor": cursor, "rows": rows if limit is None else min(rows, limit - n)}
        if since:
            params["filter"] = filters({"from-pub-date": since})
        message = json.loads(client.get(f"{CROSSREF}/journals/{issn}/works", params) or "{}").get("message", {})
        items = message.get("items", [])
        yield from map(json.dumps, items)
        n += len(items)
        cursor = message.get("next-cursor") if items else None


def crossref_message(client: Client, doi: str) -> str | None:
    answer = client.get(f"{CROSSREF}/works/{doi}")
    return None if answer is None else json.dumps(json.loads(answer)["message"])


def doi_payloads(client: Client, dois: Iterable[str]) -> Iterator[tuple[str, str, str]]:
    """(doi, provider, payload): the first service's message where it has one, else all that the others have."""
    for doi in dois:
        message = crossref_message(client, doi)
        if message is not None:
            yield doi, "crossref", message
            continue
        tries = [("doi_org_html", f"{DOI}/{doi}", {}), ("doi_org_csl", f"{DOI}/{doi}", {"accept": "application/vnd.citationstyles.csl+json"}), ("datacite", f"{DATACITE}/{doi}", {})]
        if m := re.search(r"zenodo\.(\d+)$", doi, re.I):
            tries.append(("zenodo", f"{ZENODO}/{m[1]}", {}))
        for provider, url, params in tries:
            got = client.get(url, params)
            if got:
                yield doi, provider, got


def land(spark: SparkSession, rows: Iterable[tuple], schema: str, path: str, most: int = 10_000) -> DataFrame:
    """Rows that come one by one as a table at ``path``; the driver holds ``most`` of them at a time."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    for some in batched(rows, most):
        spark.createDataFrame(list(some), schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def atom_records(spark: SparkSession, client: Client, **query) -> DataFrame:
    """Records of a search or of ids."""
    landed = land(spark, ((e,) for e in atom_pages(client, **query)), "xml string", tables.scratch(spark, "atom"))
    return providers.atom_entries(landed)


def doi_records(spark: SparkSession, client: Client, dois: Iterable[str]) -> DataFrame:
    """Records of DOIs that any service knows, in the schema of records."""
    landed = land(spark, doi_payloads(client, dois), "doi string, provider string, payload string", tables.scratch(spark, "dois"))
    return parse_payloads(landed)


def parse_payloads(landed: DataFrame) -> DataFrame:
    """Records of (doi, provider, payload): the first service's message alone, else the fields of the others by rank."""
    of = lambda p: landed.where(F.col("provider") == p)
    crossref = providers.crossref_messages(of("crossref").select(F.col("payload").alias("json")))
    json_ = lambda p: of(p).select("doi", F.col("payload").alias("json"))
    page = of("doi_org_html").select("doi", F.col("payload").alias("html"), F.concat(F.lit(f"{DOI}/"), "doi").alias("url"))
    merged = providers.merge_messages(providers.html_meta(page), providers.csl(json_("doi_org_csl")), providers.datacite(json_("datacite")), providers.zenodo(json_("zenodo")))
    answered = of("crossref").select(F.lower("doi").alias("__d")).distinct()
    merged = merged.join(answered, F.lower("doi") == F.col("__d"), "left_anti").where("title is not null")
    others = providers.as_records(merged)
    return crossref.unionByName(others).select(*records.SCHEMA.names)
