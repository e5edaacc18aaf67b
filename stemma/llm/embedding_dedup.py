"""Embedding near-duplicates by an epsilon grid order join.

Vectors of cosine 0.9 or more are, at unit length, no further apart than EPS. Unit vectors are
turned onto principal axes (any rotation gives right results; a good one skips more), and ordered by
their grid cells of side EPS on the ``GRID`` leading axes, then by the coordinates themselves. The
order is cut into intervals of about ``BLOCK`` vectors at bounds taken from a sample. Two intervals
whose boxes on the ``BOX`` leading axes lie further apart than EPS cannot hold a link; a recursion
over runs of intervals skips such pairs, large runs first. Every pair left is compared: the
same recursion goes on inside the two sequences, and compares runs of ``LEAF`` vectors by one matrix product in double
precision of the vectors as given, scaled by powers of two so that neither large nor small components overflow. Intervals of more than
``BLOCK`` vectors are dealt into parts of about that many, each pair of parts a group of its own, so a
task's memory doesn't grow with the data.

Equal vectors are one class with a count, so copies cost nothing and never meet in a task. A task
hands on each vector's number of links and a spanning forest of links, never pairs. Where vectors
spread evenly over more axes than the grid sees, no box excludes another and each interval meets
each: the work is that of a matrix product of all with all, and a vector is sent as often as there
are intervals, which is why few are made of few vectors.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, link with
nothing: 0 links, a component of their own, kept. Vectors of different lengths don't link. Rows with a
null id are not compared: 0 links, null component, not kept. Repeated ids are one node, and their rows
count as vectors each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.shipping import map_in_arrow
from stemma.llm import graph
from stemma.llm.common import materialize, table

COSINE = 0.9
#: Largest distance at unit length, and room for rounding.
EPS = float(np.sqrt(2 - 2 * COSINE)) + 1e-6
GRID, BOX = 8, 16
#: Vectors in an interval (of few vectors, a ``LEAST``-th of them) and in a matrix product.
BLOCK, LEAST, LEAF = 8192, 16, 256
#: Intervals at most: their bounds and boxes are the driver's. Of more than ``MOST * BLOCK`` vectors the intervals come in parts.
MOST = 2048
SAMPLE = 16_384


def valid(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column.values
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that their largest components lie in [0.5, 1); cosines stay the same to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def turned(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors on the principal axes."""
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes


def order_keys(p: np.ndarray) -> np.ndarray:
    """Rows of numbers whose lexicographic order is the grid order: cells, then coordinates."""
    return np.concatenate([np.floor(p[:, :GRID] / EPS), p], axis=1)


def sort(keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys.T[::-1])


def interval(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of bounds that are not above each key."""
    lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(bounds), np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        b = bounds[np.minimum(mid, len(bounds) - 1)]
        differ = keys != b
        at = differ.argmax(axis=1)
        rows = np.arange(len(keys))
        below = differ.any(axis=1) & (keys[rows, at] < b[rows, at])
        going = lo < hi
        hi = np.where(going & below, mid, hi)
        lo = np.where(going & ~below, mid + 1, lo)
    return lo


class Boxes:
    """Boxes of runs of a sequence, each made from its halves once."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray):
        self.lows, self.highs = lows, highs
        self.made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def of(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, j) not in self.made:
            self.made[i, j] = self.lows[i:j].min(axis=0), self.highs[i:j].max(axis=0)
        return self.made[i, j]

    def apart(self, a: tuple[int, int], other: Boxes, b: tuple[int, int]) -> bool:
        (al, ah), (bl, bh) = self.of(*a), other.of(*b)
        gap = np.maximum(0, np.maximum(al - bh, bl - ah))
        return float(gap @ gap) > EPS * EPS


def joined(x: Boxes, y: Boxes, leaf: int, same: bool, first: tuple[int, int] | None = None) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of runs of at most ``leaf`` that may hold links; of a sequence with itself each once. ``first``: only pairs of that run of ``x``."""
    todo = [(first or (0, len(x.lows)), (0, len(y.lows)))]
    while todo:
        a, b = todo.pop()
        if a[0] == a[1] or b[0] == b[1] or same and a[0] >= b[1] or x.apart(a, y, b):
            continue
        n, m = a[1] - a[0], b[1] - b[0]
        if n <= leaf and m <= leaf:
            yield a, b
            continue
        halves = lambda r: ((r[0], (r[0] + r[1]) // 2), ((r[0] + r[1]) // 2, r[1]))
        for p in halves(a) if n > leaf else (a,):
            for q in halves(b) if m > leaf else (b,):
                if not (same and p[0] > q[0]):
                    todo.append((p, q))


def compare(x: np.ndarray, px: np.ndarray, mx: np.ndarray, y: np.ndarray, py: np.ndarray, my: np.ndarray, same: bool):
    """(links of each x, links of each y, label of all of x then y) for vectors in grid order."""
    n, m = len(x), len(y)
    x, y = scaled(x), scaled(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    cx, cy = np.zeros(n, np.int64), np.zeros(m, np.int64)
    label = np.arange(n + m)
    bx = Boxes(px[:, :BOX], px[:, :BOX])
    by = bx if same else Boxes(py[:, :BOX], py[:, :BOX])
    for (i, j), (k, l) in joined(bx, by, LEAF, same):
        cos = (x[i:j] @ y[k:l].T) / (nx[i:j, None] * ny[None, k:l])
        near = cos >= COSINE
        if same and (i, j) == (k, l):
            np.fill_diagonal(near, False)
        a, b = np.nonzero(near)
        if len(a):
            cx[i:j] += np.bincount(a, my[k:l][b], j - i).astype(np.int64)
            if not (same and (i, j) == (k, l)):
                (cx if same else cy)[k:l] += np.bincount(b, mx[i:j][a], l - k).astype(np.int64)
            a, b = label[a + i], label[b + (k if same else k + n)]
            if (a != b).any():
                label = graph.local_labels(n + m, a, b)[label]
    return cx, cy, label


def _task(t: pa.Table, axes: np.ndarray, same: bool) -> pa.Table:
    """Links of one pair of intervals' parts."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])
    vec = matrix(t["vec"].combine_chunks(), len(axes))
    p = turned(vec, axes)
    node, h, count, side = (t[c].to_numpy() for c in ("node", "h", "copies", "side"))
    order = [np.flatnonzero(side == s) for s in (0, 1)]
    order = [o[sort(np.concatenate([order_keys(p[o]), node[o][:, None].astype(float)], axis=1))] for o in order]
    if not same and not (len(order[0]) and len(order[1])):
        return out.empty_table()
    x, y = order[0], order[0] if same else order[1]
    cx, cy, label = compare(vec[x], p[x], count[x], vec[y], p[y], count[y], same)
    rows = x if same else np.concatenate([x, y])
    n = cx if same else np.concatenate([cx, cy])
    label = label[: len(rows)] % len(rows) if same else label
    hit = n > 0
    return pa.table([node[rows][hit], node[rows[label]][hit], h[rows][hit], n[hit]], schema=out)


def links(own: DataFrame, width: int) -> DataFrame:
    """(a, b, h, n): vector a, hash h, has n links in one task, and is linked through to b there.

    ``own`` (node, h, copies, vec) has one row for each distinct vector of ``width`` components.
    """
    spark = own.sparkSession
    total = own.count()
    share = min(1 << 20, (SAMPLE << 20) // max(total, 1) + 1)
    got = own.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share).select("vec").toPandas()["vec"]
    sample = np.stack(got.to_numpy()).astype(np.float64) if len(got) else np.zeros((0, width))
    unit = turned(sample, np.eye(width)) if len(sample) else sample
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1].copy() if len(unit) else np.eye(width)
    blocks = int(min(MOST, max(-(-total // BLOCK), min(LEAST, -(-total // LEAF)))))
    keys = order_keys(unit @ axes)
    keys = keys[sort(keys)]
    bounds = keys[(np.arange(1, blocks) * len(keys)) // blocks] if len(keys) else keys
    at = spark.sparkContext.broadcast((axes, bounds))  # MOST rows at most
    box = min(BOX, width)
    kind = own.schema["vec"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, bounds = at.value
        for b in batches:
            if not b.num_rows:
                continue
            p = turned(matrix(b.column(3), width), axes)
            block = interval(order_keys(p), bounds) if len(bounds) else np.zeros(len(p), np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p[:, :box].ravel()), box).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block), lists], names=["node", "h", "copies", "vec", "block", "turned"])

    placed = own.select("node", "h", "copies", "vec").transform(
        map_in_arrow, place, f"node long, h long, copies long, vec {kind}, block long, turned array<double>"
    )
    placed = materialize(placed, "intervals")
    axis = lambda k: F.element_at("turned", k + 1)
    edge = [f(axis(k)).alias(f"{n}{k}") for n, f in (("l", F.min), ("h", F.max)) for k in range(box)]
    found = placed.groupBy("block").agg(F.count("*").alias("n"), *edge).orderBy("block").collect()  # MOST rows at most
    if not found:
        return spark.createDataFrame([], "a long, b long, h long, n long")
    names = np.array([r["block"] for r in found])
    parts = np.array([-(-r["n"] // BLOCK) for r in found])
    lows, highs = (np.array([[r[f"{n}{k}"] for k in range(box)] for r in found]) for n in "lh")
    sides = spark.sparkContext.broadcast((names, parts, lows, highs))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both sides of all pairs of intervals that may hold links: an interval with those from it on."""
        names, parts, lows, highs = sides.value
        boxes = Boxes(lows, highs)
        for b in batches:
            for i in b.column(0).to_pylist():
                rest = Boxes(lows[i:], highs[i:])
                got = np.array([q[0] + i for _, q in joined(boxes, rest, 1, False, (i, i + 1))], np.int64)
                if not len(got):
                    continue
                one = lambda k, size: pa.array(np.full(size, k, np.int64))
                apart = got[got != i]
                cols = [one(names[i], len(got)), one(0, len(got)), one(i, len(got)), pa.array(got), one(parts[i], len(got)), pa.array(parts[got])]
                yield pa.RecordBatch.from_arrays(cols, names=_SIDE)
                cols = [pa.array(names[apart]), one(1, len(apart)), one(i, len(apart)), pa.array(apart), pa.array(parts[apart]), one(parts[i], len(apart))]
                yield pa.RecordBatch.from_arrays(cols, names=_SIDE)

    pairs = spark.range(0, len(names)).transform(map_in_arrow, partners, ", ".join(f"{c} long" for c in _SIDE)).withColumnRenamed("block", "p_block")
    sent = placed.drop("turned").join(pairs, F.col("block") == F.col("p_block")).withColumn("part", F.pmod(F.xxhash64("h", "node"), F.col("own")))
    # a part meets all parts of the other interval, or those of its own each once
    sent = sent.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("a") == F.col("b"), F.col("own")).otherwise(F.col("other")).cast("int") - 1)))
    swap = F.when(F.col("a") == F.col("b"), F.col("part") > F.col("with")).otherwise(F.col("side") == 1)
    sent = sent.select(
        "a", "b", F.when(swap, F.col("with")).otherwise(F.col("part")).cast("long").alias("i"), F.when(swap, F.col("part")).otherwise(F.col("with")).cast("long").alias("j"),
        swap.cast("long").alias("side"), "node", "h", "copies", "vec",
    )

    def task(key: tuple, t: pa.Table) -> pa.Table:
        a, b, i, j = (k.as_py() for k in key)
        return _task(t, at.value[0], (a, i) == (b, j))

    return sent.groupBy("a", "b", "i", "j").applyInArrow(task, "a long, b long, h long, n long")


_SIDE = ["block", "side", "a", "b", "own", "other"]


def apply(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"))
    usable = rows.where(F.col("vec_id").isNotNull() & valid(F.col("vec")))
    own = usable.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("h", F.xxhash64("vec"))
    own = materialize(own, "classes")
    widths = [r[0] for r in own.select(F.size("vec")).distinct().collect()]
    found = None
    for width in sorted(widths):
        part = materialize(links(own.where(F.size("vec") == width), width), "links")
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, h long, n long")
    labels = graph.components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("c_node"), F.col("h").alias("c_h")).agg(F.sum("n").alias("n"))
    labels = labels.withColumnRenamed("node", "l_node")
    info = (
        own.join(counts, (F.col("node") == F.col("c_node")) & (F.col("h") == F.col("c_h")), "left")
        .join(labels, F.col("node") == F.col("l_node"), "left")
        .select(
            F.col("vec").alias("i_vec"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    info = materialize(info, "info")
    # a vector may have a third of all rows; adaptive execution splits its side of the join
    joined_ = usable.join(info, F.col("vec") == F.col("i_vec")).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    others = rows.where(F.col("vec_id").isNull() | ~valid(F.col("vec"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = joined_.unionByName(others)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: links and component of every vector."""
    return apply(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
with recursive e as (
  select vec_id, embedding::double[] as v from embeddings),
u as (
  select vec_id, v from e
  where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
n as (select vec_id, v, sqrt(list_dot_product(v, v)) as r from u),
p as (
  select a.vec_id as a, b.vec_id as b from n a, n b
  where a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) / (a.r * b.r) >= {COSINE}),
c(node, root) as (
  select vec_id, vec_id from e
  union
  select p.b, c.root from c join p on c.node = p.a),
m as (select node, min(root) as component_id from c group by node),
k as (select a, count(*) as n_links from p group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from e left join k on vec_id = a left join m on vec_id = node
"""
