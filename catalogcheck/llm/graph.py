"""Connected components of an edge list, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of the edges (a, b), both long.

    Rounds of least-neighbour labels with pointer jumping: an edge between two roots hangs the larger under the
    smallest root it meets, then every node jumps to its root's root. Each round is written to the shared folder, so a
    lost executor costs one round. Labels are pre-aggregated before each shuffle, so a node with very many edges
    is one row per task. Nothing but the number of open edges comes to the driver.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    label = tk.written(nodes.select("node", F.col("node").alias("root")), "labels")
    open_ = tk.written(edges.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not open_.isEmpty():
        # edges between roots, in both directions; every root takes the least root beside it if that is smaller
        best = open_.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up"))
        best = tk.written(best, "hooks")
        # follow chains of hooks to their ends: each root points to a smaller one, so this ends
        while True:
            further = best.alias("x").join(best.alias("y"), F.col("x.up") == F.col("y.root"), "left")
            moved = tk.written(further.select("x.root", F.coalesce("y.up", "x.up").alias("up"), F.col("y.up").isNotNull().alias("moved")), "hooks")
            done = moved.filter("moved").isEmpty()
            best = moved.select("root", "up")
            if done:
                break
        label = tk.written(label.join(best, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        a = open_.join(best.withColumnRenamed("root", "a"), "a", "left").select(F.coalesce("up", "a").alias("a"), "b")
        b = a.join(best.withColumnRenamed("root", "b"), "b", "left").select("a", F.coalesce("up", "b").alias("b"))
        open_ = tk.written(b.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return label
