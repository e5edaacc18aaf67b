"""Quality rules with thresholds that follow the data. DataFrame functions only.

Base rules are fixed. The others have no fixed cutoff and compare a document with its own language
and source: each measure's values go into a mergeable quantile sketch (counts on a log-linear grid: 64
exact values, then 32 cells per power of two, so a quantile is at most 1/32 too low). A document
fails where a measure lies above ``q75 + FENCE * spread`` of its group. The spread is ``q75 - q25``
of the group or, if that is wider, of its language: a group that copies of one document fill has next to no
spread of its own, and mustn't reject the rest for it. As sketches merge by adding counts, groups of fewer than
``MIN_GROUP`` documents use the sketch of their language, and languages as small as that the sketch of
all. A measure without any spread, even over the language, has no threshold there.

Defined cases: null text counts as no words (base_failed). Null lang or source is a group of its
own. Repeated rows are judged each for itself and alike. An empty table gives an empty result.
Other columns are carried along by :func:`apply` and never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions.shipping import spread
from stemma.llm.common import NOT_SPACE, let, materialize, table, words

#: Measures: name, numerator, denominator, scale.
MEASURES = (
    ("marks", "n_marks", "word_chars", 1000),
    ("capitals", "n_capitals", "word_chars", 1000),
    ("word_length", "word_chars", "n_words", 100),
)
FENCE = 4
MIN_GROUP = 30
#: ASCII punctuation and symbols.
MARKS = r"[!-/:-@\[-`{-~]"
#: Up to so many thresholds rows are broadcast (about 60 bytes each); more are joined by salted keys.
BROADCAST_ROWS = 50_000
SALTS = 32
_S = "__qr"


def text_stats(text: Column) -> Column:
    """Struct of the counts that the rules use, from the whole text."""
    text = F.coalesce(text, F.lit(""))

    def repeated(w: Column) -> Column:
        """Words inside 3-word windows that occur twice or more."""
        n = F.size(w)
        hashes = F.when(
            n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        ).otherwise(F.array().cast("array<bigint>"))

        def positions(h: Column) -> Column:
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
            return let(
                pairs,
                lambda p: F.sort_array(
                    F.transform(
                        F.filter(
                            p,
                            lambda s, j: F.when(j > 0, p[j - 1]["x"] == s["x"]).otherwise(F.lit(False))
                            | F.when(j < F.size(p) - 1, p[j + 1]["x"] == s["x"]).otherwise(F.lit(False)),
                        ),
                        lambda s: s["i"],
                    )
                ),
            )

        def covered(p: Column) -> Column:
            steps = F.transform(
                p, lambda x, k: F.when(k == F.size(p) - 1, F.lit(3)).otherwise(F.least(F.lit(3), p[k + 1] - x))
            )
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                let(positions(h), covered)
            ),
        )

    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)),
        lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    )
    per_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated(w).alias("n_repeat_words"),
        ),
    )
    return let(
        F.struct(per_words.alias("w"), lines.alias("l")),
        lambda s: F.struct(
            s["w"]["n_words"].alias("n_words"),
            s["w"]["word_chars"].alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            s["l"].alias("n_dup_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
            F.regexp_count(text, F.lit(MARKS)).cast("long").alias("n_marks"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        ),
    )


def _measures(stats: Column) -> list[Column]:
    """Scaled whole numbers, null where the denominator is 0."""
    out = []
    for name, top, bottom, scale in MEASURES:
        out.append(F.when(stats[bottom] > 0, F.floor(stats[top] * scale / stats[bottom]).cast("long")).alias(name))
    return out


def _cell(x: Column) -> Column:
    """Lower edge of the sketch's cell of a whole number >= 0."""
    shift = F.length(F.bin(x)) - 6
    return F.when(x < 64, x).otherwise(F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, cell, n): one mergeable sketch per language, source and measure."""
    long = measured.select(
        "lang",
        "source",
        F.explode(
            F.array(*[F.struct(F.lit(m[0]).alias("measure"), F.col(m[0]).alias("x")) for m in MEASURES])
        ).alias("m"),
    )
    return (
        long.where("m.x is not null")
        .groupBy("lang", "source", F.col("m.measure").alias("measure"), _cell(F.col("m.x")).alias("cell"))
        .agg(F.count("*").alias("n"))
    )


def _quartiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys, "measure")
    run = F.sum("n").over(by.orderBy("cell"))
    total = F.sum("n").over(by)
    at = cells.withColumns({"run": run, "total": total})
    q = lambda k: F.min(F.when(F.col("run") * 4 >= F.col("total") * k, F.col("cell")))
    return (
        at.groupBy(*keys, "measure")
        .agg(F.max("total").alias("total"), q(1).alias("q25"), q(3).alias("q75"))
        .select(*keys, "measure", "total", "q75", (F.col("q75") - F.col("q25")).alias("spread"))
    )


def thresholds(cells: DataFrame) -> DataFrame:
    """(lang, source, one column per measure): the value above which a document fails."""
    own = _quartiles(cells, ["lang", "source"])
    lang = _quartiles(cells.groupBy("lang", "measure", "cell").agg(F.sum("n").alias("n")), ["lang"])
    every = _quartiles(cells.groupBy("measure", "cell").agg(F.sum("n").alias("n")), [])
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), *[F.col(c).alias(f"l_{c}") for c in ("total", "q75", "spread")])
    every = every.select("measure", *[F.col(c).alias(f"a_{c}") for c in ("q75", "spread")])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")), "left").join(every, "measure", "left")
    wide = F.when(F.col("l_total") >= MIN_GROUP, F.col("l_spread")).otherwise(F.col("a_spread"))
    at = lambda own_, lang_, all_: F.when(F.col("total") >= MIN_GROUP, own_).when(F.col("l_total") >= MIN_GROUP, lang_).otherwise(all_)
    centre = at(F.col("q75"), F.col("l_q75"), F.col("a_q75"))
    spread = at(F.greatest("spread", wide), F.col("l_spread"), F.col("a_spread"))
    fence = F.when(spread > 0, centre + FENCE * spread)
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m[0], fence)).alias(f"max_{m[0]}") for m in MEASURES])


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def judge(rows: DataFrame, limits: DataFrame, lang: str, source: str, stats: str) -> DataFrame:
    """Add the boolean column ``__qr_kept``. ``rows`` has its group in two columns and the counts in a struct."""
    names = [f"max_{m[0]}" for m in MEASURES]
    limits = limits.select(
        F.col("lang").alias(f"{_S}_l"), F.col("source").alias(f"{_S}_s"), *[F.col(n).alias(f"{_S}_{n}") for n in names]
    )
    on = F.col(lang).eqNullSafe(F.col(f"{_S}_l")) & F.col(source).eqNullSafe(F.col(f"{_S}_s"))
    if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(limits), on, "left")
    else:  # a source may hold a third of the rows: its key is dealt over SALTS
        limits = limits.withColumn(f"{_S}_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(f"{_S}_r", F.pmod(F.xxhash64(F.col(stats)), F.lit(SALTS)).cast("int"))
        joined = rows.join(limits, on & (F.col(f"{_S}_r") == F.col(f"{_S}_k")), "left")

    def fails(s: Column) -> Column:
        out = base_failed(s)
        for value, m in zip(_measures(s), MEASURES, strict=True):
            out = out | F.coalesce(value > F.col(f"{_S}_max_{m[0]}"), F.lit(False))
        return out

    extra = [c for c in joined.columns if c.startswith(f"{_S}_") and c not in rows.columns] + [f"{_S}_r"]
    return joined.withColumn(f"{_S}_kept", let(F.col(stats), lambda s: ~fails(s))).drop(*extra)


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` with two more columns: ``__qr_stats`` (struct of counts) and ``__qr_kept``.

    The texts are counted once, written with their counts, and never shuffled.
    """
    counted = materialize(spread(docs).select("*", text_stats(F.col("text")).alias(f"{_S}_stats")), "counted")
    cells = materialize(sketches(counted.select("lang", "source", *_measures(F.col(f"{_S}_stats")))), "sketches")
    return judge(counted, materialize(thresholds(cells), "thresholds"), "lang", "source", f"{_S}_stats")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    narrow = spread(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", text_stats(F.col("text")).alias(f"{_S}_stats"))
    narrow = materialize(narrow, "stats")
    cells = sketches(narrow.select("lang", "source", *_measures(F.col(f"{_S}_stats"))))
    out = judge(narrow, materialize(thresholds(materialize(cells, "sketches")), "thresholds"), "lang", "source", f"{_S}_stats")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(
        "doc_id",
        *[F.col(f"{_S}_stats")[c].alias(c) for c in counts],
        base_failed(F.col(f"{_S}_stats")).alias("base_failed"),
        F.col(f"{_S}_kept").alias("kept"),
    )


def _cell_sql(x: str) -> str:
    return f"case when {x} < 64 then {x} else ({x} >> (length(bin({x})) - 6)) << (length(bin({x})) - 6) end"


_QUARTILES_SQL = """
    select {keys} measure, max(total) as total, min(case when run * 4 >= total * 3 then cell end) as q75,
      min(case when run * 4 >= total * 3 then cell end) - min(case when run * 4 >= total then cell end) as spread
    from (select *, sum(n) over (partition by {keys} measure order by cell) as run, sum(n) over (partition by {keys} measure) as total
          from {cells})
    group by {keys} measure"""

ORACLE_SQL = rf"""
with d as (
  select doc_id, lang, source, row_number() over () as rid, coalesce(text, '') as text from documents),
w as (
  select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls, text, doc_id, lang, source from d),
tok as (select rid, unnest(ws) as word, unnest(range(len(ws))) as pos from w),
tri as (
  select rid, pos, word, lead(word, 1) over (partition by rid order by pos) as w2, lead(word, 2) over (partition by rid order by pos) as w3
  from tok),
rep as (select rid, pos, count(*) over (partition by rid, word, w2, w3) as n from tri where w3 is not null),
cov as (
  select rid, count(distinct pos + o) as n_rep from rep, (select unnest([0, 1, 2]) as o) where n > 1 group by rid),
s as (
  select doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_rep, 0)::bigint as n_repeat_words,
    len(regexp_extract_all(text, '{MARKS}'))::bigint as n_marks, len(regexp_extract_all(text, '[A-Z]'))::bigint as n_capitals
  from w left join cov using (rid)),
m as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    {", ".join(f"case when {b} > 0 then ({t} * {k}) // {b} end as {n}" for n, t, b, k in MEASURES)} from s),
long as (
  {" union all ".join(f"select lang, source, '{n}' as measure, {_cell_sql(n)} as cell from m where {n} is not null" for n, *_ in MEASURES)}),
cells as (select lang, source, measure, cell, count(*) as n from long group by all),
lcells as (select lang, measure, cell, sum(n) as n from cells group by all),
acells as (select measure, cell, sum(n) as n from cells group by all),
own as ({_QUARTILES_SQL.format(keys="lang, source,", cells="cells")}),
bylang as ({_QUARTILES_SQL.format(keys="lang,", cells="lcells")}),
every as ({_QUARTILES_SQL.format(keys="", cells="acells")}),
lim as (
  select o.lang, o.source, o.measure,
    case when o.total >= {MIN_GROUP} then o.q75 when b.total >= {MIN_GROUP} then b.q75 else e.q75 end as centre,
    case when o.total >= {MIN_GROUP} then greatest(o.spread, case when b.total >= {MIN_GROUP} then b.spread else e.spread end)
      when b.total >= {MIN_GROUP} then b.spread else e.spread end as width,
    case when width > 0 then centre + {FENCE} * width end as top
  from own o left join bylang b on o.lang is not distinct from b.lang and o.measure = b.measure
    left join every e on o.measure = e.measure),
wide as (
  select lang, source, {", ".join(f"max(case when measure = '{m[0]}' then top end) as max_{m[0]}" for m in MEASURES)} from lim group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or {" or ".join(f"coalesce({m[0]} > max_{m[0]}, false)" for m in MEASURES)}) as kept
from m left join wide x on m.lang is not distinct from x.lang and m.source is not distinct from x.source
"""
