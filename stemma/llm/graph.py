"""Connected components of link tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import materialize


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links ``a[i]`` - ``b[i]``."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, m)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a long, b long): the smallest node reachable.

    Alternating rounds: every node hands its larger neighbours to its smallest neighbour, then its
    smaller ones. Stars are all that is left after a logarithmic number of rounds. Each round is
    written to the shared folder, so neither plan nor lineage grows. Minima are pre-aggregated
    before they are shuffled; the joins against them are plain equi-joins that adaptive execution splits
    where a hub has many links. No link is collected.
    """
    edges = (
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    edges = materialize(edges, "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        edges = materialize(_small(_large(edges)), "round")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = both.where("v > u").join(least, "u")
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
