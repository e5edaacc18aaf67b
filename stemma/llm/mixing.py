"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every source sends its documents in a fixed shuffled order (by MD5 of the id), at most twice over.
A document's virtual finish time is its source's words up to and with it, divided by the source's
target. All documents are ordered by finish time and the mix ends where the budget, the sum of
the targets, is used up; the first that doesn't fit ends it. So a source's words come within one
document of its target.

Nothing orders a whole source in one task: running sums are taken within (source, hash range)
groups and offset by the ranges before. The end of the mix is found by narrowing a histogram over
finish times (at most ``BINS`` sums at a time on the driver) and ordering the last 2**-23 of it. Targets are
computed over one row a source in one task, which bears some millions of sources.

Defined cases: null or empty text has size 0 and is taken 0 words. Null source is a source and
comes last. Repeated rows each count. A null id hashes as its text. No words at all: targets 0.
An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions.shipping import spread
from stemma.llm.common import materialize, table, words

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Hash ranges per source for running sums.
RANGES = 1024
BINS = 4096


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank, target) from rows of (source, size): one row per source.

    Budget by weight, each source capped at ``MOST`` times its size, the excess going to the others
    by weight until none is above: sources are ordered by cap per weight, and one is capped if the
    share that is left when all before it are capped reaches its cap. The unpartitioned windows
    run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("rank") % len(WEIGHTS) + 1)
    per = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(every),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "rest": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("total") * F.lit(BUDGET) - F.col("capped")) / F.col("rest"))
    over = F.col("cap") <= F.col("level") * F.col("weight")
    per = per.withColumn("is_capped", over)
    level = F.min(F.when(~F.col("is_capped"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)
    per = per.withColumn("final", level["level"])
    target = F.when(F.col("is_capped"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return per.select("source", "source_size", "rank", target.alias("target"))


def schedule(sizes: DataFrame) -> DataFrame:
    """``sizes`` (doc_id, source, size and, if it is there, the text hash th) with source_size, rank, target and first (finish time, first round).

    The second round's finish time is ``first + source_size / target``, computed as one division.
    """
    more = ["th"] if "th" in sizes.columns else []
    name = F.coalesce(F.col("doc_id").cast("string"), *[F.col(c).cast("string") for c in more], F.lit(""))
    keyed = sizes.withColumn("h", F.md5(name))
    keyed = keyed.withColumn("range", (F.conv(F.substring("h", 1, 4), 16, 10).cast("int") * RANGES / 65536).cast("int"))
    per = keyed.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    t = targets(sizes)
    offsets = (
        per.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(t.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), "offset", "source_size", "rank", "target")
    )
    run = F.sum("size").over(
        Window.partitionBy("source", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        keyed.withColumn("run", run)
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
        .withColumn("cum", F.col("run") + F.col("offset"))
        .select("doc_id", "source", "size", "source_size", "rank", "target", "cum", *more)
    )


def _finish(k: int):
    """Finish time in round k (0 or 1)."""
    return F.when(F.col("target") > 0, (F.col("cum") + k * F.col("source_size")) / F.col("target"))


def cut(rows: DataFrame) -> tuple[float, int]:
    """(finish time, source rank) of the last document of the mix; both order all that have words."""
    entries = rows.where("size > 0").select(
        "rank", "size", F.explode(F.array(*[_finish(k) for k in range(MOST)])).alias("at")
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    left, lo, width = BUDGET * total, 0.0, 1.0 / 2048
    for _ in range(2):
        cell = F.least(F.floor((F.col("at") - F.lit(lo)) / F.lit(width)), F.lit(BINS))
        sums = entries.where(F.col("at") >= F.lit(lo)).groupBy(cell.alias("cell")).agg(F.sum("size").alias("n"))
        picked = None
        for c, n in sorted(map(tuple, sums.collect())):  # at most BINS + 1 rows
            if n > left:
                picked = c
                break
            left -= n
        if picked is None:
            return float("inf"), 0
        if picked == BINS:  # beyond the grid: few and coarse documents, of which none was over before
            lo, width = lo + BINS * width, float("inf")
            break
        lo, width = lo + picked * width, width / BINS
    last = (-1.0, -1)
    inside = entries.where((F.col("at") >= F.lit(lo)) & (F.col("at") < F.lit(lo + width))).orderBy("at", "rank")
    for at, rank, n in inside.select("at", "rank", "size").toLocalIterator():  # 2**-23 of finish time
        if n > left:
            break
        left -= n
        last = (at, rank)
    return last if last[0] >= 0 else (lo, -1)


def mix(sizes: DataFrame) -> DataFrame:
    """``sizes`` (doc_id, source, size) with source_size, target and taken (words; repeats counted)."""
    rows = materialize(schedule(sizes), "schedule")
    at, rank = cut(rows)
    taken = F.lit(0).cast("long")
    for k in range(MOST):
        f = _finish(k)
        fits = (f < F.lit(at)) | ((f == F.lit(at)) & (F.col("rank") <= F.lit(rank)))
        taken = taken + F.when(fits & (F.col("size") > 0), F.col("size")).otherwise(F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *[c for c in ("th",) if c in rows.columns])


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, th) of every row; th is a hash of the text."""
    return spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("th"))


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix has them: a row once for each time that it is taken, the others not at all.

    Documents without words are no part of a mix. Rows are matched by id, text hash and their place among the
    rows of both, so repeated ids keep their own verdicts, and rows with a null id are spread by their texts.
    """
    # the key is never null, and the window, the join and the verdicts share its partitioning: the texts move once
    row = lambda df, th: df.withColumns({"__mx_id": F.coalesce("doc_id", F.lit(0)), "__mx_null": F.col("doc_id").isNull(), "__mx_th": th})
    place = F.row_number().over(Window.partitionBy("__mx_id", "__mx_null", "__mx_th").orderBy("source"))
    verdict = row(mix(materialize(sizes(docs), "sizes")), F.col("th")).withColumn("n", place).where("taken > 0")
    verdict = verdict.select(
        F.col("__mx_id").alias("__mx_v"), F.col("__mx_null").alias("__mx_w"), F.col("__mx_th").alias("__mx_u"), F.col("n").alias("__mx_m"),
        F.expr("cast(taken / size as int)").alias("__mx_times"),
    )
    marked = row(docs, F.xxhash64("text")).withColumn("__mx_n", place)
    same = (F.col("__mx_id") == F.col("__mx_v")) & (F.col("__mx_null") == F.col("__mx_w")) & (F.col("__mx_th") == F.col("__mx_u"))
    out = marked.join(verdict, same & (F.col("__mx_n") - F.col("__mx_m") == 0))
    out = out.withColumn("__mx_round", F.explode(F.sequence(F.lit(1), F.col("__mx_times"))))
    return out.select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: what the mix takes of every document."""
    narrow = materialize(sizes(table(spark, sf_dir, "documents")), "sizes")
    return mix(narrow).drop("source", "th")


ORACLE_SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5(coalesce(doc_id::varchar, '')) as h from documents),
p as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rk
  from d group by source),
q as (select *, ([{", ".join(map(str, WEIGHTS))}])[(rk % {len(WEIGHTS)} + 1)::int] as weight, source_size * {MOST} as cap from p),
r as (
  select *, sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cap::double / weight, rk rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over (order by cap::double / weight, rk rows between current row and unbounded following) as rest from q),
l as (select *, (total::double * {BUDGET} - capped::double) / rest::double as level from r),
c as (select *, cap <= level * weight as is_capped from l),
f as (select min(struct_pack(x := cap::double / weight, y := rk, z := level)) filter (not is_capped) as s from c),
t as (
  select source, source_size, rk, case when is_capped then cap::double else (select s.z from f) * weight end as target from c),
s as (
  select d.*, t.source_size, t.rk, t.target,
    sum(size) over (partition by d.source order by h, doc_id, size rows unbounded preceding) as cum
  from d join t on d.source is not distinct from t.source),
e as (
  select doc_id, h, rk, size, k, (cum::double + k * source_size) / target as fin
  from s, (select unnest(range({MOST})) as k) where target > 0 and size > 0),
x as (
  select doc_id, h, rk, size, sum(size) over (order by fin, rk rows unbounded preceding) as used,
    (select sum(size)::double from d) * {BUDGET} as budget from e),
y as (select doc_id, rk, size, sum(size)::bigint as taken from x where used <= budget group by all)
select s.doc_id, s.size, s.source_size, s.target, coalesce(taken, 0)::bigint as taken
from s left join y on s.doc_id = y.doc_id and s.rk = y.rk and s.size = y.size
"""
