"""Keyed upserts, version-aware record merges, and the deduplications around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions import checks, ids
from stemma.sources import tables

#: Fields of which a difference is no conflict.
QUIET = ("note", "authors_list", "raw_entry")


def held(column: str, kind: str) -> str:
    """Whether a column of a type holds something, as SQL: not null, and not an empty string or list."""
    if kind == "string":
        return f"coalesce(length({column}) > 0, false)"
    return f"coalesce(size({column}) > 0, false)" if kind.startswith(("array", "map")) else f"{column} is not null"


def filled(df: DataFrame, name: str) -> Column:
    """Whether a field holds something."""
    return F.expr(held(f"`{name}`", df.schema[name].dataType.simpleString()))


def completeness(df: DataFrame, fields: list[str] | None = None) -> Column:
    """Number of fields that hold something."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return F.expr(" + ".join(f"cast({held(f'`{n}`', kinds[n])} as int)" for n in fields or df.columns))


def prefer_complete(df: DataFrame, keys: list[str], version: str | None = None, order: list | None = None) -> DataFrame:
    """One row a key: highest version, then most complete, then ``order``.

    Without a key of its own a row is left alone.
    """
    by = [F.coalesce(F.col(version), F.lit(0)).desc()] if version else []
    w = Window.partitionBy(*keys).orderBy(*by, F.desc("__full"), *(order or []))
    named = df.withColumn("__full", completeness(df))
    known = named.where(F.greatest(*[F.col(k).isNotNull() for k in keys], F.lit(False)))
    first = known.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.unionByName(named.where(~F.greatest(*[F.col(k).isNotNull() for k in keys], F.lit(False)))).drop("__full")


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the highest ``seq`` of each key; an aggregate with map-side combination, no sort."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r"))
    return out.select(*keys, "__r.*").select(*df.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Replace by composite key: existing rows whose key comes in go; of repeated incoming keys the first by ``seq`` stays.

    Without ``seq`` nothing says which is first, so a repeated incoming key is an error. A null key part equals an empty one.
    """
    part = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    mark = lambda df: df.withColumns({f"__k{i}": part(k) for i, k in enumerate(keys)})
    names = [f"__k{i}" for i in range(len(keys))]
    if seq is None:
        checks.require_unique(mark(incoming).select(*names), *names)
        return _replaced(mark(existing), mark(incoming), names)
    return _replaced(mark(existing), keep_first(mark(incoming), names, seq), names)


def _replaced(existing: DataFrame, new: DataFrame, names: list[str]) -> DataFrame:
    old = existing.join(new.select(*names), names, "left_anti")
    return old.unionByName(new, allowMissingColumns=True).drop(*names)


def changed_keys(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(key, change): keys that an exchange of tables would add or remove."""
    added = incoming.select(key).distinct().join(existing.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    removed = existing.select(key).distinct().join(incoming.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def upsert_scaffold(
    existing: DataFrame, incoming: DataFrame, keys: list[str], remove_missing: bool = False, seq: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(new table, changed keys): an upsert, or a full exchange if ``remove_missing``; keys of several columns are joined by tabs."""
    if seq is None:
        checks.require_unique(incoming.select(*keys), *keys)
    else:
        incoming = keep_first(incoming, keys, seq)
    table = incoming if remove_missing else upsert(existing, incoming, keys, seq)
    whole = lambda df: df.select((F.col(keys[0]) if len(keys) == 1 else F.concat_ws("\t", *keys)).alias(keys[0]))
    changes = changed_keys(whole(existing), whole(incoming), keys[0])
    return table, changes if remove_missing else changes.where("change = 'added'")


def upsert_pairs(existing: DataFrame, incoming: DataFrame, left: str, right: str) -> DataFrame:
    """Replace on either key: an existing pair goes if its left or its right id comes in."""
    kept = existing
    for key in (left, right):
        kept = kept.join(incoming.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return kept.select(left, right).unionByName(incoming.select(left, right).distinct())


def normalize_identity(records: DataFrame) -> DataFrame:
    """Crossref rows take their DOI as id; arXiv rows lose the version suffix."""
    arxiv = F.coalesce(F.col("source") == "arxiv", F.lit(False))
    has_doi = ids.null_if_blank(F.col("doi")).isNotNull()
    base = F.regexp_replace("source_id", r"v\d+$", "")
    cross = F.coalesce(F.col("source") == "crossref", F.lit(False)) & has_doi
    return records.withColumn("source_id", F.when(arxiv, base).when(cross, F.col("doi")).otherwise(F.col("source_id"))).withColumn(
        "ref_id", F.when(arxiv, F.concat(F.lit("arxiv:"), base)).when(cross, F.concat(F.lit("doi:"), F.col("doi"))).otherwise(F.col("ref_id"))
    )


def merge(existing: DataFrame, incoming: DataFrame, key: str, version: str | None = None, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged records, conflicts (key, field, old, new)).

    A full outer join on the key. A field of the incoming row wins unless it holds nothing; if the incoming
    version is older, the existing row's fields win; a note that exists is kept. Both sides must be unique on the key.
    With ``once`` the joined rows are written to scratch space, for a caller that reads both results.
    """
    # expressions as text: built column by column they cost some thousand calls of the JVM
    fields = [c for c in existing.columns if c != key]
    kinds = {f.name: f.dataType.simpleString() for f in existing.schema}
    joined = existing.alias("e").join(incoming.alias("i"), F.expr(f"e.`{key}` = i.`{key}`"), "full")
    if once:
        joined = tables.once(joined.select(F.struct("e.*").alias("e"), F.struct("i.*").alias("i")), "merge")
    older = f"coalesce(i.`{version}` < e.`{version}`, false)" if version else "false"
    has = lambda side, name: held(f"{side}.`{name}`", kinds[name])

    def pick(name: str) -> str:
        old, new = f"e.`{name}`", f"i.`{name}`"
        keep = f"{has('e', name)} and ({older} or {str(name == 'note').lower()} or not {has('i', name)})"
        return f"case when i.`{key}` is null or ({keep}) then {old} when e.`{key}` is null or {has('i', name)} then {new} else coalesce({new}, {old}) end as `{name}`"

    merged = joined.selectExpr(f"coalesce(e.`{key}`, i.`{key}`) as `{key}`", *map(pick, fields))
    logged = [f for f in fields if f not in QUIET and not kinds[f].startswith(("array", "map", "struct"))]
    row = lambda f: f"named_struct('field', '{f}', 'old', cast(e.`{f}` as string), 'new', cast(i.`{f}` as string))"
    rows = ", ".join(f"case when {has('e', f)} and {has('i', f)} and not e.`{f}` <=> i.`{f}` then {row(f)} end" for f in logged)
    both = joined.where(f"e.`{key}` is not null and i.`{key}` is not null and not {older}")
    found = both.selectExpr(f"e.`{key}` as `{key}`", f"explode(array_compact(array({rows}))) as c")
    return merged, found.select(key, "c.field", "c.old", "c.new")


def merge_on_read(main: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Main with the delta's rows in place of its own of the same key; the delta holds a key once, as upserts made it."""
    names = [f"__k{i}" for i in range(len(keys))]
    mark = lambda df: df.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("")) for n, k in zip(names, keys, strict=True)})
    return _replaced(mark(main), mark(delta), names)
