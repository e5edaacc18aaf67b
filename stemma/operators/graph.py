"""Literature graph: anchor edges, edge types, and bounded traversal in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.sources import tables

MAX_DEPTH, MAX_NODES = 2, 100
#: The edge types, in the order in which they are tested.
EDGE_TYPES = ("foundation", "extension", "comparison", "context")


def edge_type(relationship: Column, anchor_role: Column) -> Column:
    relation, role = (F.lower(F.coalesce(c, F.lit(""))) for c in (relationship, anchor_role))
    return (
        F.when(relation.rlike("builds_on|foundation") | role.contains("foundation"), "foundation")
        .when(relation.contains("extends"), "extension")
        .when(relation.rlike("compare|contrast"), "comparison")
        .otherwise("context")
    )


def edge_types(types: list[str]) -> list[str]:
    bad = [t for t in types if t.strip().lower() not in EDGE_TYPES]
    if bad:
        raise ValueError(f"unknown edge types: {bad}")
    return [t.strip().lower() for t in types]


def from_digests(digests: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """Edges of the anchors in digests; a DOI target becomes the arXiv record that it is paired with."""
    rows = digests.select(F.col("ref_id").alias("source_ref_id"), F.explode("anchor_references").alias("a")).select(
        "source_ref_id", F.col("a.anchor_ref_id").alias("target_ref_id"), F.col("a.anchor_ref_id").alias("anchor_ref_id"), F.col("a.anchor_rank").alias("anchor_rank"),
        F.col("a.anchor_role").alias("anchor_role"), F.col("a.relationship_to_current_paper").alias("relationship"), F.col("a.confidence").alias("confidence"),
    )
    rows = rows.where(F.length("target_ref_id") > 0)
    if identity is None:
        return rows
    first = identity.groupBy(F.lower("doi").alias("__doi")).agg(F.min("arxiv_id").alias("__arxiv"))
    key = F.lower(F.regexp_replace("target_ref_id", "^doi:", ""))
    out = rows.join(first, key == F.col("__doi"), "left")
    return out.withColumn("target_ref_id", F.coalesce("__arxiv", "target_ref_id")).drop("__doi", "__arxiv")


def overlay(generated: DataFrame, manual: DataFrame, seq: str = "seq") -> DataFrame:
    """Generated edges with hand-made ones in place of those of the same ends; the last hand-made one counts."""
    ends = ["source_ref_id", "target_ref_id"]
    last = F.row_number().over(Window.partitionBy(*ends).orderBy(F.desc(seq)))
    rank = F.row_number().over(Window.partitionBy("source_ref_id").orderBy(seq))
    hand = manual.withColumn("anchor_rank", rank).withColumn("__n", last).where("__n = 1").drop("__n", seq)
    return generated.join(hand.select(*ends), ends, "left_anti").unionByName(hand, allowMissingColumns=True)


def replace_sources(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with all of the sources that ``new`` has replaced."""
    return edges.join(new.select("source_ref_id").distinct(), "source_ref_id", "left_anti").unionByName(new, allowMissingColumns=True)


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int, both: bool = False) -> DataFrame:
    """(id, depth) of all nodes within ``max_depth`` hops: frontier joins, each node at its first hop.

    Each hop is written to the shared folder, so plans stay flat and a lost executor costs one hop.
    """
    steps = edges.select(F.col("source_ref_id").alias("a"), F.col("target_ref_id").alias("b"))
    if both:
        steps = steps.unionByName(steps.select(F.col("b").alias("a"), F.col("a").alias("b")))
    steps = steps.distinct()
    seen = roots.select(F.col(roots.columns[0]).alias("id")).distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = steps.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        frontier = tables.once(frontier, "hop")
        seen = seen.unionByName(frontier)
    return seen


def build(
    edges: DataFrame, roots: list[str], cached: DataFrame | None = None, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES,
    include: list[str] | None = None, exclude: list[str] | None = None, up: list[str] | None = None, down: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, edges, meta) of a bidirectional walk bounded by hops and nodes.

    Up follows source to target, down target to source; odd hops go up first. Only cached nodes are expanded.
    Candidates come in the order of rank, source, target; those beyond the budget are counted, not added. The node set is
    bounded by ``max_nodes``, so it is the driver's; edges never leave the executors but for a hop's candidates, cut to the budget.
    """
    if include and exclude:
        raise ValueError("include and exclude together")
    spark = edges.sparkSession
    typed = edges.withColumn("edge_type", edge_type(F.col("relationship"), F.col("anchor_role")))
    if include:
        typed = typed.where(F.col("edge_type").isin(edge_types(include)))
    if exclude:
        typed = typed.where(~F.col("edge_type").isin(edge_types(exclude)))
    starts = list(dict.fromkeys([*roots, *(up or []), *(down or [])]))
    depth = {r: 0 for r in starts}
    frontier = {"up": {*roots, *(up or [])}, "down": {*roots, *(down or [])}}
    open_ = None if cached is None else cached.select(F.col(cached.columns[0]).alias("id"))
    truncated = 0
    for hop in range(1, max_depth + 1):
        grown: dict[str, set] = {"up": set(), "down": set()}
        for way in ("up", "down") if hop % 2 else ("down", "up"):
            if not frontier[way]:
                continue
            here, there = ("source_ref_id", "target_ref_id") if way == "up" else ("target_ref_id", "source_ref_id")
            hits = typed.where(F.col(here).isin(sorted(frontier[way])) & ~F.col(there).isin(sorted(depth)))
            if open_ is not None:
                hits = hits.join(open_.select(F.col("id").alias(here)), here, "left_semi")
            # the first place of each candidate in the order of rank, source, target
            first = hits.groupBy(F.col(there).alias("id")).agg(F.min(F.struct("anchor_rank", "source_ref_id", "target_ref_id")).alias("at"))
            room = max_nodes - len(depth)
            added = [r["id"] for r in first.orderBy("at", "id").limit(max(room, 0)).collect()]
            truncated += first.count() - len(added) if len(added) == room else 0
            for i in added:
                depth[i] = hop
                grown[way].add(i)
        frontier = grown
    nodes = spark.createDataFrame([(i, d, i in starts) for i, d in depth.items()], "id string, depth int, is_root boolean")
    if open_ is not None:
        nodes = nodes.join(open_.distinct().withColumn("traversable", F.lit(True)), "id", "left").withColumn("traversable", F.coalesce("traversable", F.lit(False)))
    else:
        nodes = nodes.withColumn("traversable", F.lit(True))
    nodes = nodes.withColumn("node_type", F.when(F.col("traversable"), "cached").otherwise("external")).orderBy("depth", "id")
    kept = typed.where(F.col("source_ref_id").isin(sorted(depth)) & F.col("target_ref_id").isin(sorted(depth)))
    first = F.row_number().over(Window.partitionBy("source_ref_id", "target_ref_id", "anchor_ref_id").orderBy("anchor_rank", "edge_type"))
    kept = kept.withColumn("__n", first).where("__n = 1").drop("__n").orderBy("source_ref_id", "target_ref_id", "anchor_ref_id")
    return nodes, kept, {"nodes": len(depth), "truncated_nodes": truncated, "max_depth": max_depth, "max_nodes": max_nodes}


def described(nodes: DataFrame, records: DataFrame, edges: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """``nodes`` with titles (of the record, else of the anchor that names it) and, if given, digest details."""
    own = records.select(F.col("ref_id").alias("id"), F.col("title").alias("__t")).dropDuplicates(["id"])
    out = nodes.join(own, "id", "left")
    if "anchor_title" in edges.columns:
        named = edges.groupBy(F.col("target_ref_id").alias("id")).agg(F.min_by("anchor_title", "anchor_rank").alias("__a"))
        out = out.join(named, "id", "left").withColumn("__t", F.coalesce("__t", "__a")).drop("__a")
    out = out.withColumnRenamed("__t", "title")
    return out if details is None else out.join(details.withColumnRenamed("ref_id", "id"), "id", "left")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of linked ids (left, right): the least id reachable over pairs of either side.

    Every id takes the least component among its own and its neighbours', and that id's, round after round until nothing changes; a round is
    written once. For identity links, whose components are small.
    """
    left, right = links.columns[:2]
    both = links.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b"))
    both = tables.once(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = tables.once(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("c"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = labels.join(near, F.col("id") == F.col("a")).join(jump, "component", "left")
        fresh = tables.once(moved.select("id", F.least("component", "c", F.coalesce("further", "component")).alias("component")), "labels")
        if not fresh.join(labels, ["id", "component"], "left_anti").limit(1).count():
            return fresh
        labels = fresh
