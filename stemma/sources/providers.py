"""Parsers of bibliographic payloads: Atom entries, Crossref and DataCite JSON, HTML metadata.

All are column expressions over a string column, so a feed of any size is parsed where it is read.
Fetching is left to the caller: whatever lands payloads in a table or folder will do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import checks, ids
from stemma.functions.shipping import spread
from stemma.sources.records import SCHEMA

#: Rank of a provider when messages of one DOI are merged.
RANKS = {"crossref": 5, "doi_org_html": 4, "doi_org_csl": 3, "datacite": 2, "zenodo": 1}
#: Formats beyond those that a cast to timestamp reads.
_FORMATS = ("yyyy/MM/dd", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd HH:mm:ssZ")


def timestamp(text: Column) -> Column:
    """A UTC timestamp from any of several formats; up to seven digits are days since 1970-01-01."""
    t = F.trim(text)
    days = F.when(t.rlike(r"^\d{1,7}$"), F.date_add(F.lit("1970-01-01").cast("date"), t.try_cast("int")).cast("timestamp"))
    return F.coalesce(days, t.try_cast("timestamp"), *[F.try_to_timestamp(t, F.lit(f)) for f in _FORMATS])


def _dates(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("pub_date"), "month": F.month("pub_date"), "day": F.dayofmonth("pub_date")})


_TEXTS = ("id", "title", "summary", "published", "doi", "journal_ref", "comment")
ATOM = (
    f"entry array<struct<{','.join(f'{n}:array<string>' for n in _TEXTS)},author:array<struct<name:array<string>>>,"
    "category:array<struct<_term:string>>,link:array<struct<_rel:string,_href:string>>>>, _VALUE string"
)
_XML = {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false", "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"}


def atom_entries(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Records of Atom entries, one entry a row. Each is parsed once; broken ones, and rows of several entries, are errors."""
    plain = F.regexp_replace(F.regexp_replace(F.col(xml), r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", ""), r"<(/?)\w+:", "<$1")
    body = ids.null_if_blank(F.regexp_replace(plain, r"(?s)^\s*(<\?xml.*?\?>)?\s*(<!DOCTYPE[^\[>]*>)?", ""))
    # in an element around it, so that the root's name counts and what follows the root is seen
    x = spread(df).withColumn("__x", body).withColumn("__m", F.from_xml(F.concat(F.lit("<x>"), "__x", F.lit("</x>")), ATOM, _XML))
    several = (F.size("__m.entry") > 1) | (F.trim(F.regexp_replace("__m._VALUE", r"\s+", " ")) != "")
    e = F.when(several, F.raise_error(F.concat(F.lit("not one entry: "), F.substring("__x", 1, 200)))).otherwise(F.get("__m.entry", F.lit(0)))
    x = x.withColumn("__e", e)
    listed = lambda name: F.when(F.col("__x").isNotNull(), F.coalesce(f"__e.{name}", F.array()))

    def one(name: str) -> Column:
        # elements inside a text come as markup; only then, and where a text has the sign itself, XPath says what the text is
        raw = F.get(f"__e.{name}", F.lit(0))
        return ids.null_if_blank(F.when(raw.contains("<"), F.xpath_string("__x", F.lit(f"/entry/{name}"))).otherwise(raw))

    versioned = F.regexp_replace(one("id"), "^.*/", "")
    base = F.regexp_extract(versioned, r"^([^v]+)v(\d+)$", 1)
    base = F.when(base != "", base).otherwise(versioned)
    cats = F.filter(F.transform(listed("category"), lambda c: c["_term"]), lambda t: t.isNotNull())
    href = lambda keep: F.get(F.filter("__e.link", keep), F.lit(0))["_href"]
    names = F.flatten(F.transform(listed("author"), lambda a: F.filter(F.coalesce(a["name"], F.array()), lambda n: F.length(n) > 0)))
    authors = F.when(F.exists(names, lambda n: n.contains("<")), F.xpath("__x", F.lit("/entry/author/name/text()"))).otherwise(names)
    doi, journal = one("doi"), one("journal_ref")
    landing = href(lambda link: link["_rel"] == "alternate")
    out = x.select(
        F.concat(F.lit("arxiv:"), base).alias("ref_id"), F.lit("arxiv").alias("source"), base.alias("source_id"),
        F.when(journal.isNotNull(), "article").otherwise("unpublished").alias("entry_type"),
        one("title").alias("title"), one("summary").alias("abstract"), F.array_join(authors, "; ").alias("authors"), authors.alias("authors_list"),
        timestamp(one("published")).alias("pub_date"), doi.alias("doi"), landing.alias("url"), landing.alias("url_landing"),
        href(lambda link: (link["_rel"] == "related") | link["_href"].contains("pdf")).alias("url_pdf"), F.get(cats, F.lit(0)).alias("subject_primary"),
        F.array_join(cats, " ").alias("subject_all"), versioned.alias("arxiv_id_versioned"), base.alias("arxiv_id_base"),
        F.regexp_extract(versioned, r"v(\d+)$", 1).try_cast("int").alias("arxiv_version"), F.get(cats, F.lit(0)).alias("arxiv_primary_category"),
        F.array_join(cats, " ").alias("arxiv_categories_raw"), one("comment").alias("arxiv_comment"), journal.alias("arxiv_journal_ref"),
        F.concat(F.lit("doi:"), doi).alias("linked_doi_ref_id"), F.col(xml).alias("raw_entry"),
    )
    return checks.align(_dates(out), SCHEMA)


_DATE = "struct<`date-parts`:array<array<int>>>"
MESSAGE = (
    "source string, DOI string, title array<string>, author array<struct<given:string,family:string,name:string>>, "
    f"`published-print` {_DATE}, `published-online` {_DATE}, issued {_DATE}, created {_DATE}, `container-title` array<string>, publisher string, "
    "volume string, issue string, page string, abstract string, URL string, ISBN array<string>, ISSN array<string>, link array<struct<URL:string>>, "
    "subject array<string>"
)


def crossref_messages(df: DataFrame, json: str = "json") -> DataFrame:
    """Records of Crossref messages, one a row; of the dates print comes before online, issued and created."""
    m = df.select(F.from_json(json, MESSAGE).alias("m"), F.col(json).alias("raw_entry")).where("m is not null")
    f = lambda name: ids.null_if_blank(F.col(f"m.`{name}`"))
    first = lambda name: ids.null_if_blank(F.get(F.col(f"m.`{name}`"), F.lit(0)))
    person = lambda a: F.coalesce(ids.null_if_blank(F.concat_ws(" ", ids.null_if_blank(a["given"]), ids.null_if_blank(a["family"]))), a["name"])
    people = F.filter(F.transform("m.author", person), lambda x: F.length(x) > 0)

    def date(name: str) -> Column:
        parts = F.get(F.col(f"m.`{name}`.`date-parts`"), F.lit(0))
        at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(1))
        return F.when(F.get(parts, F.lit(0)).isNotNull(), F.make_timestamp(F.get(parts, F.lit(0)), at(1), at(2), F.lit(0), F.lit(0), F.lit(0)))

    doi, landing = f("DOI"), F.coalesce(f("URL"), F.concat(F.lit("https://doi.org/"), f("DOI")))
    codes = lambda name: ids.null_if_blank(F.array_join(F.array_distinct(f"m.{name}"), "; "))
    out = m.select(
        F.concat(F.lit("doi:"), doi).alias("ref_id"), F.coalesce(f("source"), F.lit("crossref")).alias("source"), doi.alias("source_id"),
        F.lit("article").alias("entry_type"), first("title").alias("title"), f("abstract").alias("abstract"),
        F.coalesce(F.array_join(people, "; "), F.lit("")).alias("authors"), people.alias("authors_list"),
        F.coalesce(date("published-print"), date("published-online"), date("issued"), date("created")).alias("pub_date"),
        first("container-title").alias("journal"), first("container-title").alias("container_title"), f("publisher").alias("publisher"),
        f("volume").alias("volume"), f("issue").alias("issue"), f("page").alias("pages"), doi.alias("doi"), codes("ISBN").alias("isbn"), codes("ISSN").alias("issn"),
        landing.alias("url"), landing.alias("url_landing"), ids.null_if_blank(F.get("m.link.URL", F.lit(0))).alias("url_pdf"),
        first("subject").alias("subject_primary"), F.coalesce(F.array_join(F.array_distinct("m.subject"), "; "), F.lit("")).alias("subject_all"), "raw_entry",
    )
    return checks.align(_dates(out), SCHEMA)


DATACITE = (
    "data struct<attributes:struct<titles:array<struct<title:string>>,creators:array<struct<name:string,givenName:string,familyName:string>>,"
    "publicationYear:int,publisher:string,container:struct<title:string,volume:string,issue:string>,descriptions:array<struct<description:string>>,url:string,"
    "subjects:array<struct<subject:string>>>>"
)
ZENODO = (
    "metadata struct<title:string,creators:array<struct<name:string>>,publication_date:string,description:string,journal:struct<title:string,volume:string,"
    "issue:string,pages:string>,keywords:array<string>>, links struct<html:string>"
)
_PARTS = ("title", "authors", "pub_date", "container_title", "publisher", "volume", "issue", "pages", "abstract", "url", "isbn", "issn", "subject_all")


def datacite(df: DataFrame, json: str = "json", doi: str = "doi") -> DataFrame:
    a = F.col("m.data.attributes")
    people = F.transform(a["creators"], lambda c: F.coalesce(ids.null_if_blank(F.concat_ws(" ", c["givenName"], c["familyName"])), c["name"]))
    year = F.make_timestamp(a["publicationYear"], F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return df.select(F.col(doi).alias("doi"), F.from_json(json, DATACITE).alias("m")).select(
        "doi", F.lit("datacite").alias("source"), F.get(a["titles"]["title"], F.lit(0)).alias("title"), F.array_join(people, "; ").alias("authors"),
        year.alias("pub_date"), a["container"]["title"].alias("container_title"), a["publisher"].alias("publisher"), a["container"]["volume"].alias("volume"),
        a["container"]["issue"].alias("issue"), F.lit(None).cast("string").alias("pages"), F.get(a["descriptions"]["description"], F.lit(0)).alias("abstract"),
        F.coalesce(a["url"], F.concat(F.lit("https://doi.org/"), "doi")).alias("url"), F.lit(None).cast("string").alias("isbn"),
        F.lit(None).cast("string").alias("issn"), F.array_join(F.array_distinct(a["subjects"]["subject"]), "; ").alias("subject_all"),
    )


def zenodo(df: DataFrame, json: str = "json", doi: str = "doi") -> DataFrame:
    m = F.col("m.metadata")
    return df.select(F.col(doi).alias("doi"), F.from_json(json, ZENODO).alias("m")).select(
        "doi", F.lit("zenodo").alias("source"), m["title"].alias("title"), F.array_join(m["creators"]["name"], "; ").alias("authors"),
        timestamp(m["publication_date"]).alias("pub_date"), m["journal"]["title"].alias("container_title"), F.lit("Zenodo").alias("publisher"),
        m["journal"]["volume"].alias("volume"), m["journal"]["issue"].alias("issue"), m["journal"]["pages"].alias("pages"), m["description"].alias("abstract"),
        F.col("m.links.html").alias("url"), F.lit(None).cast("string").alias("isbn"), F.lit(None).cast("string").alias("issn"),
        F.array_join(m["keywords"], "; ").alias("subject_all"),
    )


def meta_map(html: Column) -> Column:
    """Map of a page's meta names (lower case) to arrays of contents, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, r"(?is)(?:name|property)\s*=\s*[\"']([^\"']*)", 1))
    value = lambda t: F.trim(F.regexp_extract(t, r"(?is)content\s*=\s*([\"'])(.*?)\1", 2))
    pairs = F.filter(F.transform(tags, lambda t: F.struct(name(t).alias("k"), value(t).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def first_meta(meta: Column, *names: str) -> Column:
    return F.coalesce(*[F.get(F.element_at(meta, n), F.lit(0)) for n in names])


def html_meta(df: DataFrame, html: str = "html", doi: str = "doi", url: str = "url") -> DataFrame:
    """Bibliographic fields of a landing page's meta tags, each from the first name that is there."""
    m = df.select(F.col(doi).alias("doi"), F.col(url).alias("__url"), meta_map(F.col(html)).alias("m"))
    g = lambda *n: first_meta(F.col("m"), *n)
    joined = lambda n: F.array_join(F.array_distinct(F.element_at("m", n)), "; ")
    first_page, last_page = g("citation_firstpage"), g("citation_lastpage")
    return m.select(
        "doi", F.lit("doi_org_html").alias("source"), g("citation_title", "og:title", "twitter:title", "dc.title").alias("title"), joined("citation_author").alias("authors"),
        timestamp(F.regexp_replace(g("citation_publication_date", "citation_date", "dc.date"), "/", "-")).alias("pub_date"),
        g("citation_journal_title", "citation_conference_title", "citation_venue", "dc.source").alias("container_title"),
        g("citation_publisher", "dc.publisher", "og:site_name").alias("publisher"), g("citation_volume").alias("volume"), g("citation_issue").alias("issue"),
        F.when(first_page.isNotNull() & last_page.isNotNull(), F.concat_ws("-", first_page, last_page)).otherwise(F.coalesce(first_page, last_page)).alias("pages"),
        g("citation_abstract", "description", "dc.description").alias("abstract"),
        F.coalesce(g("citation_url", "citation_pdf_url", "og:url"), F.col("__url")).alias("url"), joined("citation_isbn").alias("isbn"),
        joined("citation_issn").alias("issn"), joined("citation_keywords").alias("subject_all"),
    )


def merge_messages(*messages: DataFrame) -> DataFrame:
    """One row a DOI: each field from the highest-ranked provider that has it. Crossref alone counts where it answered."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), messages).withColumn("__doi", F.lower("doi"))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("source")), F.lit(0))
    every = every.withColumn("__rank", rank)
    top = every.groupBy("__doi").agg(F.max("__rank").alias("__top"))
    every = every.join(top, "__doi").where((F.col("__top") < RANKS["crossref"]) | (F.col("__rank") == F.col("__top")))
    best = lambda c: F.max_by(F.col(c), F.when(ids.null_if_blank(F.col(c).cast("string")).isNotNull(), F.col("__rank"))).alias(c)
    return every.groupBy("__doi").agg(best("doi"), best("source"), *[best(c) for c in _PARTS if c in every.columns]).drop("__doi")


CSL = (
    "title string, author array<struct<given:string,family:string,literal:string>>, issued struct<`date-parts`:array<array<int>>>, `container-title` string, "
    "publisher string, volume string, issue string, page string, abstract string, URL string, ISBN string, ISSN string, categories array<string>"
)


def csl(df: DataFrame, json: str = "json", doi: str = "doi") -> DataFrame:
    """Bibliographic fields of citation style JSON."""
    m = df.select(F.col(doi).alias("doi"), F.from_json(json, CSL).alias("m"))
    f = lambda name: ids.null_if_blank(F.col(f"m.`{name}`"))
    people = F.transform("m.author", lambda a: F.coalesce(ids.null_if_blank(F.concat_ws(" ", a["given"], a["family"])), a["literal"]))
    parts = F.get(F.col("m.issued.`date-parts`"), F.lit(0))
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(1))
    day = F.when(F.get(parts, F.lit(0)).isNotNull(), F.make_timestamp(F.get(parts, F.lit(0)), at(1), at(2), F.lit(0), F.lit(0), F.lit(0)))
    return m.select(
        "doi", F.lit("doi_org_csl").alias("source"), f("title").alias("title"), F.array_join(people, "; ").alias("authors"), day.alias("pub_date"),
        f("container-title").alias("container_title"), f("publisher").alias("publisher"), f("volume").alias("volume"), f("issue").alias("issue"), f("page").alias("pages"),
        f("abstract").alias("abstract"), F.coalesce(f("URL"), F.concat(F.lit("https://doi.org/"), "doi")).alias("url"), f("ISBN").alias("isbn"), f("ISSN").alias("issn"),
        F.array_join(F.array_distinct("m.categories"), "; ").alias("subject_all"),
    )


def as_records(messages: DataFrame) -> DataFrame:
    """Merged messages as records."""
    out = messages.withColumns(
        {
            "ref_id": F.concat(F.lit("doi:"), "doi"), "source_id": F.col("doi"), "entry_type": F.lit("article"), "journal": F.col("container_title"), "url_landing": F.col("url"),
            "authors_list": F.split("authors", "; "),
        }
    )
    return checks.align(_dates(out), SCHEMA)
