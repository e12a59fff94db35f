"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. The minimum of each node's neighbours comes from a partial aggregate and is joined back, so that a hub's edges are never gathered into one task."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    met = both.join(least, both["a"] == least["n"])
    if large:  # neighbours above the node move to its minimum
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # neighbours below the node, and itself, move to the minimum
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): the component is its smallest node.

    Alternates large-star and small-star steps until the edges no longer change; each round is cut by a
    table in the shared folder. Self-loops and null ends are ignored, repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = materialise(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen, old = now, e
        e = materialise(_star(_star(e, True), False))
        discard(old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b"), F.col("b")).distinct())
