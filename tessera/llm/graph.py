"""Connected components by contraction, without gathering edges anywhere.

Each pass lets every vertex point at its smallest neighbour, follows the pointers to their roots by
doubling, and contracts the edges onto the roots, until no edge is left. A component is named by its
smallest vertex. Each step is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (v, root) for every vertex of an edge between different vertices."""
    e = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    done = e.select(F.col("a").alias("v"), F.col("a").alias("root")).limit(0)
    first = True
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        p = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("root")), "parents")
        while True:
            up = p.select(F.col("v").alias("root"), F.col("root").alias("above"))
            q = materialize(p.join(up, "root").select("v", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jumps")
            p = q.select("v", "root")
            if q.where("moved").isEmpty():
                break
        if first:
            done, first = p, False
        else:
            up = p.select(F.col("v").alias("root"), F.col("root").alias("above"))
            done = materialize(done.join(up, "root", "left").select("v", F.coalesce("above", "root").alias("root")), "roots")
        left, right = p.select(F.col("v").alias("a"), F.col("root").alias("ra")), p.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        e = materialize(e.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return done


def merged(label: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The labels (v, root) after more edges: only edges between roots are looked at."""
    if label is None:
        return components(edges)
    a, b = (label.select(F.col("v").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    moved = components(edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    up = moved.select(F.col("v").alias("root"), F.col("root").alias("above"))
    old = label.join(up, "root", "left").select("v", F.coalesce("above", "root").alias("root"))
    return materialize(old.union(moved.join(label.select("v"), "v", "left_anti")), "labels")
