"""Upsert, reference, status, coverage and graph queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions import ids
from stemma.operators import graph, references, upsert
from stemma.plans.tables import read


def _incoming(spark, d):
    c = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return c.withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2)).withColumn("c_custkey", F.col("c_custkey") + 5)


def upsert_rows(spark, d):
    return upsert.upsert(read(spark, d, "customer"), _incoming(spark, d), ["c_custkey"])


def upsert_changes(spark, d):
    return upsert.changed_keys(read(spark, d, "customer"), _incoming(spark, d), "c_custkey")


def _versions(spark, d):
    old = read(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("journal"),
        F.when(F.col("c_nationkey") < 12, F.lit("kept")).alias("note"), (F.col("c_nationkey") % 4).alias("version"),
    )
    new = read(spark, d, "customer").where("c_acctbal < 5000").select(
        (F.col("c_custkey") + 20).alias("key"), F.upper("c_name").alias("title"), F.col("c_mktsegment").alias("journal"),
        F.lit("new").alias("note"), F.lit(2).alias("version"),
    )
    return upsert.merge(old, new, "key", "version")


def merge_records(spark, d):
    return _versions(spark, d)[0]


def merge_conflicts(spark, d):
    return _versions(spark, d)[1].where("field <> 'version'")


def keep_last(spark, d):
    return upsert.keep_last(read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


def latest_order(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return references.latest(o, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey"))


def prefer_complete(spark, d):
    docs = read(spark, d, "documents").withColumn("key", F.md5("text"))
    return upsert.prefer_complete(docs, ["key"], order=["doc_id"]).select("doc_id", "key")


def pair_upsert(spark, d):
    pairs = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    new = read(spark, d, "lineitem").where("l_quantity = 1").groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    return upsert.upsert_pairs(pairs, new, "l_partkey", "l_suppkey")


def find_parts(spark, d):
    p = read(spark, d, "part")
    found = references.find(p, query="brand#1", columns=("p_name", "p_brand", "p_type"), substrings={"p_type": "a"}, p_size=[1, 5, 10, 15, 20, 25, 30])
    return found.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def ambiguous(spark, d):
    return references.ambiguous(read(spark, d, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


def entity_collections(spark, d):
    o = read(spark, d, "orders")
    links = o.select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderpriority").alias("collection_id"), F.col("o_orderdate").alias("recorded_at"))
    entity = o.select(F.col("o_orderkey").alias("ref_id"), F.col("o_custkey").alias("entity_id"))
    return references.entity_collections(links, entity)


def collection_concat(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("collections"))


def _status(spark, d):
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), "o_orderstatus")
    return references.status(people, {"md": orders, "digest": orders.where("o_orderstatus = 'F'")})


def status(spark, d):
    return _status(spark, d)


def missing(spark, d):
    return references.missing(_status(spark, d), "digest").select("entity_id")


def enrichment(spark, d):
    return references.enrichment_candidates(_status(spark, d)).select("entity_id", "reason", "eligible")


def compare_status(spark, d):
    fresh = _status(spark, d).select("entity_id", "n_md")
    stored = read(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count("*").alias("n_md"))
    return references.compare_status(fresh, stored, "entity_id")


def orphans(spark, d):
    docs = read(spark, d, "documents")
    return references.orphans(docs.select("doc_id", "lang"), read(spark, d, "labels"), "doc_id")


def diagnostics(spark, d):
    pairs = read(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return references.diagnostics(ambiguous=references.ambiguous(pairs, "l_partkey", "l_suppkey"), orphans=orphans(spark, d), stale=compare_status(spark, d))


def coverage(spark, d):
    out = references.coverage(read(spark, d, "documents").select("doc_id", "lang", "source"), read(spark, d, "labels"), "doc_id", ["lang", "source"])
    return out.withColumn("coverage", F.round("coverage", 6))


def date_stats(spark, d):
    e = read(spark, d, "events")
    parts = [references.date_stats(e, "ts", by).select(F.lit(by).alias("by"), F.col("bucket").cast("string").alias("bucket"), "n") for by in ("day", "month", "year")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def missing_days(spark, d):
    return references.missing_days(read(spark, d, "events").where("event_type = 'purchase' and value > 150"), "ts").select(F.col("day").cast("string").alias("day"))


def entities(spark, d):
    o = read(spark, d, "orders").select(F.format_string("arxiv:%06d", "o_orderkey").alias("ref_id"))
    pairs = read(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.format_string("%06d", "l_orderkey").alias("arxiv_id")).agg(F.format_string("10.1/%d", F.min("l_partkey")).alias("doi"))
    docs = pairs.select(F.concat(F.lit("doi:"), "doi").alias("ref_id"))
    return references.entities(o.unionByName(docs), pairs)


def assign_collections(spark, d):
    records = read(spark, d, "part").select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("journal"), F.concat_ws("; ", F.col("p_size").cast("string"), "p_type").alias("issn"))
    brands = records.select(F.col("journal").alias("title")).distinct().where("title < 'Brand#3'")
    by_title = brands.select(F.concat(F.lit("c_"), "title").alias("collection_id"), "title", F.array().cast("array<string>").alias("issns"), F.lit(2).alias("seq"))
    by_issn = spark.createDataFrame([("sizes", None, ["7", "8"], 1)], "collection_id string, title string, issns array<string>, seq int")
    return references.assign_collections(records, by_title.unionByName(by_issn))


def id_routes(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 4 == 0, F.format_string("arXiv:%04d.%05dv%d", k % 10000, k, k % 9 + 1))
        .when(k % 4 == 1, F.format_string("https://doi.org/10.1000/AB%d", k))
        .when(k % 4 == 2, F.format_string("%04d.%05d", k % 10000, k))
        .otherwise(F.format_string("isbn:978-%010d", k))
    )
    rows = o.select("o_orderkey", raw.alias("raw"))
    c = F.col("raw")
    return rows.select(
        "o_orderkey", ids.route(c).alias("route"), ids.bare_arxiv(c).alias("arxiv"), ids.arxiv_version(c).alias("version"), ids.bare_doi(F.when(c.contains("doi"), c)).alias("doi"),
        ids.isbn_ref_id(c).alias("isbn"), ids.shard_year(c).alias("shard"), ids.digest_key(c).alias("digest_key"), ids.record_slug(F.lit(None).cast("string"), c).alias("slug"),
    )


def _edges(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = read(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("source_ref_id"), F.lead("l_partkey").over(w).cast("string").alias("target_ref_id"),
        F.col("l_linenumber").alias("anchor_rank"), F.col("l_returnflag").alias("anchor_role"),
        F.when(F.col("l_linestatus") == "O", "builds_on").otherwise("contrasts").alias("relationship"),
    )
    return rows.where("target_ref_id is not null and source_ref_id <> target_ref_id").withColumn("anchor_ref_id", F.col("target_ref_id"))


def graph_edges(spark, d):
    e = _edges(spark, d)
    kind = graph.edge_type(F.col("relationship"), F.col("anchor_role"))
    return e.groupBy("source_ref_id", "target_ref_id").agg(F.count("*").alias("n"), F.min(kind).alias("edge_type"))


def graph_reachable(spark, d):
    roots = spark.createDataFrame([("1",)], "id string")
    return graph.reachable(_edges(spark, d), roots, 2)


def graph_reachable_both(spark, d):
    roots = spark.createDataFrame([("1",), ("7",)], "id string")
    return graph.reachable(_edges(spark, d), roots, 1, both=True)


def graph_nodes(spark, d):
    return graph.build(_edges(spark, d), ["1"], max_nodes=50)[0]


def graph_kept_edges(spark, d):
    e = graph.build(_edges(spark, d), ["1"], max_nodes=50)[1]
    return e.select("source_ref_id", "target_ref_id", "anchor_rank", "edge_type")


def graph_overlay(spark, d):
    e = _edges(spark, d)
    first = F.row_number().over(Window.partitionBy("source_ref_id", "target_ref_id").orderBy("anchor_rank", "anchor_role", "relationship"))
    base = e.withColumn("n", first).where("n = 1").select("source_ref_id", "target_ref_id", "anchor_rank", "relationship")
    hand = base.where("anchor_rank = 1").select("source_ref_id", "target_ref_id", F.lit("compares_with").alias("relationship"), F.col("target_ref_id").cast("long").alias("seq"))
    return graph.overlay(base, hand)


def page_slugs(spark, d):
    return read(spark, d, "pages").select("page_id", ids.record_slug(F.lit(None).cast("string"), F.col("url")).alias("slug"))


QUERIES = {
    f.__name__: f
    for f in (
        upsert_rows, upsert_changes, merge_records, merge_conflicts, keep_last, latest_order, prefer_complete, pair_upsert, find_parts, ambiguous,
        entity_collections, collection_concat, status, missing, enrichment, compare_status, orphans, diagnostics, coverage, date_stats, missing_days, entities,
        assign_collections, id_routes, page_slugs, graph_edges, graph_reachable, graph_reachable_both, graph_nodes, graph_kept_edges, graph_overlay,
    )
}

_INC = "inc as (select * replace (round(c_acctbal + 1, 2) as c_acctbal, c_custkey + 5 as c_custkey) from customer where c_mktsegment = 'BUILDING')"
_MERGE = """
o as (select c_custkey as key, c_name as title, case when c_acctbal > 0 then c_mktsegment end as journal, case when c_nationkey < 12 then 'kept' end as note, c_nationkey % 4 as version from customer),
i as (select c_custkey + 20 as key, upper(c_name) as title, c_mktsegment as journal, 'new' as note, 2 as version from customer where c_acctbal < 5000),
j as (
  select coalesce(o.key, i.key) as key, o.key is null as io, i.key is null as oo, coalesce(i.version < o.version, false) as older,
    o.title as ot, i.title as it, o.journal as oj, i.journal as ij, o.note as ono, i.note as ino, o.version as ov, i.version as iv
  from o full join i on o.key = i.key)"""
_ST = """
s as (
  select c_custkey as entity_id, count(o_orderkey) as n_md, count(*) filter (o_orderstatus = 'F') as n_digest
  from customer left join orders on c_custkey = o_custkey group by 1)"""
_CMP = """
st as (select o_custkey as entity_id, count(*) as n_md from orders where o_orderpriority <> '1-URGENT' group by 1),
cmp as (
  select coalesce(s.entity_id, st.entity_id) as entity_id,
    case when st.entity_id is null then 'missing' when s.entity_id is null then 'orphan' when s.n_md is distinct from st.n_md then 'stale' end as issue
  from s full join st on s.entity_id = st.entity_id)"""
_AMB = """
amb as (
  select 'l_partkey' as side, l_partkey::varchar as id, count(distinct l_suppkey) as n from lineitem group by all having count(distinct l_suppkey) > 1
  union all
  select 'l_suppkey', l_suppkey::varchar, count(distinct l_partkey) from lineitem group by all having count(distinct l_partkey) > 1)"""
_EDGE = """
e0 as (
  select l_partkey::varchar as s, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)::varchar as t,
    l_linenumber as r, l_returnflag as role, case when l_linestatus = 'O' then 'builds_on' else 'contrasts' end as rel from lineitem),
e as (select *, case when rel = 'builds_on' then 'foundation' else 'comparison' end as kind from e0 where t is not null and s <> t)"""
_BOTH = "b as (select distinct s, t from e), u as (select s, t from b union select t, s from b)"



def _walk(root: str = "1", most: int = 50) -> str:
    """Two hops of the bounded walk, unrolled: up and down, then down and up; n4 has all nodes."""

    def step(k: int, here: str, there: str, frontier: str, depth: int) -> str:
        return f"""
c{k} as (
  select {there} as id, row_number() over (order by min((r, s, t)), {there}) as place from e
  where {here} in ({frontier}) and {there} not in (select id from n{k - 1}) group by {there}),
a{k} as (select id from c{k} where place <= {most} - (select count(*) from n{k - 1})),
n{k} as (select * from n{k - 1} union all select id, {depth} from a{k})"""

    return f"n0 as (select '{root}' as id, 0 as depth)," + ",".join(
        (
            step(1, "s", "t", f"'{root}'", 1), step(2, "t", "s", f"'{root}'", 1),
            step(3, "t", "s", "select id from a2", 2), step(4, "s", "t", "select id from a1", 2),
        )
    )


ORACLE_SQL = {
    "upsert_rows": f"with {_INC} select * from customer where c_custkey not in (select c_custkey from inc) union all select * from inc",
    "upsert_changes": f"""with {_INC}
select c_custkey, 'added' as change from inc where c_custkey not in (select c_custkey from customer)
union all select c_custkey, 'removed' from customer where c_custkey not in (select c_custkey from inc)""",
    "merge_records": f"""with {_MERGE}
select key, case when oo or (ot is not null and older) then ot when io or it is not null then it else ot end as title,
  case when oo or (oj is not null and (older or ij is null)) then oj when io or ij is not null then ij else oj end as journal,
  case when oo or ono is not null then ono else ino end as note,
  case when oo or older then ov else iv end as version from j""",
    "merge_conflicts": f"""with {_MERGE}
select key, 'title' as field, ot as old, it as new from j where not io and not oo and not older and ot <> it
union all select key, 'journal', oj, ij from j where not io and not oo and not older and oj <> ij""",
    "keep_last": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1",
    "latest_order": "select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1",
    "prefer_complete": "select doc_id, key from (select doc_id, md5(text) as key, row_number() over (partition by md5(text) order by (lang is not null and lang <> '')::int + (source is not null and source <> '')::int desc, doc_id) as n from documents) where n = 1",
    "pair_upsert": """with p as (select distinct l_partkey, l_suppkey from lineitem), n as (select l_partkey, min(l_suppkey) as l_suppkey from lineitem where l_quantity = 1 group by 1)
select * from p where l_partkey not in (select l_partkey from n) and l_suppkey not in (select l_suppkey from n) union all select distinct l_partkey, l_suppkey from n""",
    "find_parts": """select p_partkey, p_name, p_brand, p_type, p_size from part
where p_size in (1, 5, 10, 15, 20, 25, 30) and contains(lower(p_type), 'a')
  and (contains(lower(p_name), 'brand#1') or contains(lower(p_brand), 'brand#1') or contains(lower(p_type), 'brand#1'))""",
    "ambiguous": f"with {_AMB} select * from amb",
    "entity_collections": "select o_custkey as entity_id, o_orderpriority as collection_id, max(o_orderdate) as recorded_at from orders group by 1, 2",
    "collection_concat": "select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as collections from orders group by 1",
    "status": f"with {_ST} select entity_id, n_md, n_md > 0 as has_md, n_digest, n_digest > 0 as has_digest from s",
    "missing": f"with {_ST} select entity_id from s where n_digest = 0",
    "enrichment": f"with {_ST} select entity_id, case when n_md = 0 then 'missing_md' when n_digest > 0 then 'digest_exists' else 'ready' end as reason, n_md > 0 and n_digest = 0 as eligible from s",
    "compare_status": f"with {_ST}, {_CMP} select * from cmp where issue is not null",
    "orphans": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "diagnostics": f"""with {_AMB}, {_ST}, {_CMP}
select (select count(*) from amb) as n_ambiguous, (select count(*) from documents where doc_id not in (select doc_id from labels)) as n_orphans,
  (select count(*) from cmp where issue is not null) as n_stale""",
    "coverage": """select lang, source, count(*) as total, count(l.doc_id) as done, count(*) - count(l.doc_id) as missing, round(count(l.doc_id) / count(*), 6) as coverage
from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id group by 1, 2""",
    "date_stats": " union all ".join(f"select '{b}' as by, date_trunc('{b}', ts)::date::varchar as bucket, count(*) as n from events group by 2" for b in ("day", "month", "year")),
    "missing_days": """with x as (select distinct ts::date as day from events where event_type = 'purchase' and value > 150)
select day::varchar as day from (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from x) where day not in (select day from x)""",
    "entities": """with o as (select printf('%06d', o_orderkey) as a from orders),
p as (select printf('%06d', l_orderkey) as a, '10.1/' || min(l_partkey) as doi from lineitem where l_linenumber = 1 group by 1),
x as (select 'arxiv:' || a as ref_id, 'arxiv:' || a as entity_id from p union all select 'doi:' || doi, 'arxiv:' || a from p),
b as (select ref_id, min(entity_id) as linked from x group by 1),
r as (select 'arxiv:' || a as ref_id from o union select 'doi:' || doi from p)
select r.ref_id, coalesce(linked, r.ref_id) as entity_id from r left join b on r.ref_id = b.ref_id""",
    "assign_collections": "select p_partkey as ref_id, case when p_size in (7, 8) then 'sizes' when p_brand < 'Brand#3' then 'c_' || p_brand else 'unclassified_doi' end as collection_id from part",
    "id_routes": r"""with r as (
  select o_orderkey, o_orderkey % 4 as m, case o_orderkey % 4
    when 0 then printf('arXiv:%04d.%05dv%d', o_orderkey % 10000, o_orderkey, o_orderkey % 9 + 1)
    when 1 then 'https://doi.org/10.1000/AB' || o_orderkey
    when 2 then printf('%04d.%05d', o_orderkey % 10000, o_orderkey)
    else printf('isbn:978-%010d', o_orderkey) end as raw from orders),
a as (
  select *, regexp_replace(raw, '^arXiv:', '') as b from r),
x as (select *, case when m in (0, 2) and regexp_matches(b, '^\d{4}\.\d{4,5}(v\d+)?$') then regexp_replace(b, 'v\d+$', '') end as arxiv from a)
select o_orderkey, case when m = 1 then 'doi' when arxiv is not null then 'arxiv_id' else 'isbn' end as route, arxiv,
  coalesce(try_cast(nullif(regexp_extract(raw, 'v(\d+)$', 1), '') as int), 0) as version, case when m = 1 then '10.1000/ab' || o_orderkey end as doi,
  case when m = 3 then 'isbn:' || replace(substr(raw, 6), '-', '') end as isbn,
  case when regexp_matches(b, '^\d{4}\.\d{4,5}') then case when substr(b, 1, 2)::int >= 90 then '19' else '20' end || substr(b, 1, 2) else 'unknown' end as shard,
  lower(regexp_replace(regexp_replace(raw, '^arXiv:', ''), '^isbn:', '')) as digest_key,
  regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from x""",
    "page_slugs": "select page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from pages",
    "graph_edges": f"with {_EDGE} select s as source_ref_id, t as target_ref_id, count(*) as n, min(kind) as edge_type from e group by 1, 2",
    "graph_reachable": f"""with recursive {_EDGE}, w(id, depth) as (select '1', 0 union select e.t, w.depth + 1 from w join e on e.s = w.id where w.depth < 2)
select id, min(depth) as depth from w group by id""",
    "graph_reachable_both": f"""with recursive {_EDGE}, {_BOTH}, w(id, depth) as (select unnest(['1', '7']), 0 union select u.t, w.depth + 1 from w join u on u.s = w.id where w.depth < 1)
select id, min(depth) as depth from w group by id""",
    "graph_nodes": f"""with {_EDGE}, {_walk()}
select id, depth, depth = 0 as is_root, true as traversable, 'cached' as node_type from n4""",
    "graph_kept_edges": f"""with {_EDGE}, {_walk()},
g as (select *, row_number() over (partition by s, t order by r, kind) as place from e where s in (select id from n4) and t in (select id from n4))
select s as source_ref_id, t as target_ref_id, r as anchor_rank, kind as edge_type from g where place = 1""",
    "graph_overlay": f"""with {_EDGE}, f as (select *, row_number() over (partition by s, t order by r, role, rel) as n from e),
b as (select s, t, r, rel from f where n = 1)
select s as source_ref_id, t as target_ref_id, r as anchor_rank, rel as relationship from b where r <> 1
union all select s, t, row_number() over (partition by s order by t::bigint), 'compares_with' from b where r = 1""",
}
