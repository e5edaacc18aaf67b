"""Parsing, rendering, research-table, digest and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stemma.functions import vocab
from stemma.operators import digest, research, upsert
from stemma.plans.tables import read
from stemma.sources import bibtex, providers, tables
from stemma.streaming import ingest


def html_links(spark, d):
    h = F.col("html")
    return read(spark, d, "pages").select(
        "page_id",
        F.regexp_extract(h, r"(?is)<title>([^<]*)", 1).alias("title"),
        F.regexp_extract(h, r'<html[^>]*\slang="([^"]*)"', 1).alias("lang"),
        F.regexp_count(h, F.lit("<a href=")).alias("n_links"),
        F.size(providers.meta_map(h)).alias("n_meta"),
    )


def event_props(spark, d):
    return read(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _parts(spark, d):
    p = read(spark, d, "part")
    return p.select(
        F.format_string("source:%d", "p_partkey").alias("ref_id"), F.col("p_partkey").cast("string").alias("source_id"), F.lit("manual").alias("source"),
        F.when(F.col("p_size") < 25, "article").otherwise("book").alias("entry_type"), F.col("p_name").alias("title"), F.concat(F.col("p_brand"), F.lit("; "), F.col("p_type")).alias("authors"),
        F.col("p_size").alias("year"), F.col("p_brand").alias("publisher"), F.col("p_type").alias("journal"),
    )


def bibtex_render(spark, d):
    return bibtex.render(_parts(spark, d))


def bibtex_round_trip(spark, d):
    made = bibtex.render(_parts(spark, d).withColumn("doi", F.concat(F.lit("10.1000/P"), "source_id")))
    return made.select("ref_id", bibtex.ref_id(F.col("bibtex"), F.lit("key")).alias("found"), bibtex.field(F.col("bibtex"), "title").alias("title"))


def crossref_parse(spark, d):
    p = read(spark, d, "part")
    author = F.array(F.struct(F.lit("Jane").alias("given"), F.col("p_brand").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.col("p_type").alias("family")))
    message = F.struct(
        F.format_string("10.1000/%d", "p_partkey").alias("DOI"), F.array("p_name").alias("title"), author.alias("author"), F.array("p_type").alias("container-title"),
        F.struct(F.array(F.array(F.col("p_size") + 1970)).alias("date-parts")).alias("issued"), F.array("p_brand", "p_brand").alias("ISSN"),
    )
    out = providers.crossref_messages(p.select(F.to_json(message).alias("json")))
    return out.select("ref_id", "source", "title", "authors", F.col("pub_date").cast("date").cast("string").alias("day"), "journal", "issn", "url")


def atom_parse(spark, d):
    o = read(spark, d, "orders")
    xml = F.format_string(
        "<entry xmlns='http://www.w3.org/2005/Atom' xmlns:arxiv='http://arxiv.org/schemas/atom'><id>http://arxiv.org/abs/2401.%05dv%d</id><title>T %d</title>"
        "<published>%sT00:00:00Z</published><author><name>A %d</name></author><author><name>B</name></author><category term='%s'/><category term='cs.DB'/>"
        "<link rel='alternate' href='http://arxiv.org/abs/x'/><link rel='related' href='http://arxiv.org/pdf/x'/></entry>",
        "o_orderkey", F.col("o_orderkey") % 5 + 1, "o_custkey", F.col("o_orderdate").cast("date").cast("string"), "o_custkey", "o_orderpriority",
    )
    out = providers.atom_entries(o.select(xml.alias("xml")))
    return out.select("ref_id", "arxiv_version", "title", "authors", "year", "month", "day", "subject_primary", "subject_all", "url_pdf", "entry_type")


def vocabulary(spark, d):
    o = read(spark, d, "orders")
    words = F.element_at(F.create_map(*[F.lit(x) for x in ("1-URGENT", "Field Experiment", "2-HIGH", "case-study", "3-MEDIUM", "ML", "5-LOW", "no such type")]), F.col("o_orderpriority"))
    return o.select("o_orderkey", words.alias("raw")).select("o_orderkey", vocab.normalize(F.col("raw"), vocab.PAPER_TYPES).alias("paper_type"))


def _findings(spark, d, where):
    rows = read(spark, d, "lineitem").where(where).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("effect_size"), F.max("l_returnflag").alias("method"))
    return research.FINDINGS.normalize(rows.select(F.col("l_orderkey").cast("string").alias("ref_id"), F.col("l_linenumber").cast("string").alias("finding_id"), "effect_size", "method"))


def findings_merge_on_read(spark, d):
    main, delta = _findings(spark, d, "l_linestatus = 'O'"), _findings(spark, d, "l_returnflag = 'R'")
    return upsert.merge_on_read(main, delta, research.FINDINGS.keys).select("ref_id", "finding_id", "effect_size", "method", "paper_type")


def findings_problems(spark, d):
    rows = _findings(spark, d, "l_linestatus = 'O'").withColumn("finding_id", F.when(F.col("effect_size") > 45, F.lit("")).otherwise(F.col("finding_id")))
    return research.FINDINGS.problems(rows).groupBy("ref_id", "problem").agg(F.count("*").alias("n"))


def _history(spark, d):
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("ref_id"), (F.col("turn") + 1).cast("int").alias("digest_revision"), F.col("role").alias("updated_at"), F.col("text").alias("summary"))


def digest_latest(spark, d):
    return digest.latest(_history(spark, d)).select("ref_id", "digest_revision", F.md5("summary").alias("summary"))


def digest_append(spark, d):
    h = _history(spark, d)
    new = digest.latest(h).where("updated_at = 'user'").withColumn("summary", F.lit("again"))
    return digest.append(h, new).select("ref_id", "digest_revision", F.coalesce("derived_from_revision", F.lit(0)).alias("derived_from_revision"), F.md5("summary").alias("summary"))


def _events(spark, d):
    # streams need every column nullable
    schema = StructType([StructField(f.name, f.dataType, True) for f in read(spark, d, "events").schema])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return ingest.files(spark, f"{d}/events.parquet", schema)
    return ingest.files(spark, d, schema, glob="events.parquet")  # the glob fits names of files, not of folders


def stream_daily_counts(spark, d):
    out = tables.scratch(spark, "daily")
    ingest.run_to_table(ingest.windowed_counts(_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", by=["event_type"]), out, f"{out}-log").awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n")


def stream_latest(spark, d):
    out = tables.scratch(spark, "latest")
    rows = _events(spark, d).select("user_id", "event_id", "event_type")
    ingest.upsert_into(rows, out, ["user_id"], "event_id", f"{out}-log").awaitTermination()
    return spark.read.parquet(out)


QUERIES = {
    f.__name__: f
    for f in (
        html_links, event_props, bibtex_render, bibtex_round_trip, crossref_parse, atom_parse, vocabulary, findings_merge_on_read, findings_problems, digest_latest,
        digest_append, stream_daily_counts, stream_latest,
    )
}

_F = """
f as (
  select l_orderkey::varchar as ref_id, l_linenumber::varchar as finding_id, max(l_quantity) filter ({w}) as effect_size, max(l_returnflag) filter ({w}) as method, 'unknown' as paper_type
  from lineitem where {w} group by l_orderkey, l_linenumber)"""
_P = "p as (select *, case when p_size < 25 then 'article' else 'book' end as kind from part)"

ORACLE_SQL = {
    "html_links": r"""select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title, regexp_extract(html, '<html[^>]*\slang="([^"]*)"', 1) as lang,
  len(regexp_extract_all(html, '<a href='))::int as n_links, len(regexp_extract_all(html, '<meta\s[^>]*content='))::int as n_meta from pages""",
    "event_props": "select (props::json->>'k')::int as k, count(*) as n, round(sum(value), 2) as total from events group by 1",
    "bibtex_render": f"""with {_P}
select 'source:' || p_partkey as ref_id, '@' || kind || '{{' || p_partkey || ', title = {{' || regexp_replace(p_name, '([&%$#_])', '\\\\\\1', 'g') || '}},' || chr(10)
  || '  author = {{' || regexp_replace(p_brand || ' and ' || p_type, '([&%$#_])', '\\\\\\1', 'g') || '}},' || chr(10) || '  year = {{' || p_size || '}},' || chr(10)
  || case when kind = 'article' then '  journal = {{' || p_type || '}}' else '  publisher = {{' || p_brand || '}}' end || chr(10) || '}}' as bibtex from p""",
    "bibtex_round_trip": "select 'source:' || p_partkey as ref_id, 'doi:10.1000/P' || p_partkey as found, regexp_replace(p_name, '([&%$#_])', '\\\\\\1', 'g') as title from part",
    "crossref_parse": """select 'doi:10.1000/' || p_partkey as ref_id, 'crossref' as source, p_name as title, 'Jane ' || p_brand || '; ' || p_type as authors,
  (p_size + 1970) || '-01-01' as day, p_type as journal, p_brand as issn, 'https://doi.org/10.1000/' || p_partkey as url from part""",
    "atom_parse": """select printf('arxiv:2401.%05d', o_orderkey) as ref_id, (o_orderkey % 5 + 1)::int as arxiv_version, 'T ' || o_custkey as title, 'A ' || o_custkey || '; B' as authors,
  year(o_orderdate)::int as year, month(o_orderdate)::int as month, day(o_orderdate)::int as day, o_orderpriority as subject_primary, o_orderpriority || ' cs.DB' as subject_all,
  'http://arxiv.org/pdf/x' as url_pdf, 'unpublished' as entry_type from orders""",
    "vocabulary": """select o_orderkey, case o_orderpriority when '1-URGENT' then 'empirical_experimental' when '2-HIGH' then 'empirical_case_study' when '3-MEDIUM' then 'computational'
  else 'unknown' end as paper_type from orders""",
    "findings_merge_on_read": f"""with {_F.format(w="l_linestatus = 'O'")}, {_F.format(w="l_returnflag = 'R'").replace("f as", "g as", 1)}
select f.* from f left join g on f.ref_id = g.ref_id and f.finding_id = g.finding_id where g.ref_id is null union all select * from g""",
    "findings_problems": f"""with {_F.format(w="l_linestatus = 'O'")}
select ref_id, 'finding_id is blank' as problem, count(*) as n from f where effect_size > 45 group by 1""",
    "digest_latest": """select ref_id, digest_revision, summary from (
  select conv_id::varchar as ref_id, (turn + 1)::int as digest_revision, md5(text) as summary, row_number() over (partition by conv_id order by turn desc, role desc) as n from conversations)
where n = 1""",
    "digest_append": """with h as (select conv_id::varchar as ref_id, (turn + 1)::int as digest_revision, role, text from conversations),
l as (select *, row_number() over (partition by ref_id order by digest_revision desc, role desc) as n from h)
select ref_id, digest_revision, 0 as derived_from_revision, md5(text) as summary from h
union all select ref_id, digest_revision + 1, digest_revision, md5('again') from l where n = 1 and role = 'user'""",
    "stream_daily_counts": "select ts::date::varchar as day, event_type, count(*) as n from events group by 1, 2",
    "stream_latest": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1",
}
