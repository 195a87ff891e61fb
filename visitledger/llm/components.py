"""Connected components of an edge table, by contraction in Spark.

Each task first replaces its edges by the star edges of its own spanning forest. Then, in rounds, each node hooks onto its
smallest neighbour, pointers are doubled, and the edges are drawn anew between the roots, until none is left.
Every round's tables are written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.llm.common import kept

EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
FOREST = 500_000


def _forest(batches):
    """Star edges of the task's spanning forest; handed on whenever it has grown to its bound."""
    def stars():
        nodes = [n for n in above if root(n) != n]
        return pa.RecordBatch.from_arrays(
            [pa.array([root(n) for n in nodes], pa.int64()), pa.array(nodes, pa.int64())], schema=EDGE)

    def root(n):
        while above[n] != n:
            above[n] = above[above[n]]
            n = above[n]
        return n

    above: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            above.setdefault(a, a)
            above.setdefault(b, b)
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
        if len(above) > FOREST:
            yield stars()
            above.clear()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)` for every node of `edges(a, b)`; the component is its smallest node."""
    drawn = kept(edges.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    labels = kept(drawn.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn(
        "component", F.col("node")), "labels")
    while not drawn.isEmpty():
        both = drawn.union(drawn.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select(
            "node", F.least("node", "up").alias("up"))
        hooks = kept(hooks, "hooks")
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        hooks = kept(hooks.join(above, "up").select("node", F.col("upper").alias("up")), "hooks")
        moved = hooks.withColumnRenamed("node", "component")
        labels = kept(labels.join(moved, "component", "left").select(
            "node", F.coalesce("up", "component").alias("component")), "labels")
        left = hooks.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = hooks.select(F.col("node").alias("b"), F.col("up").alias("y"))
        drawn = kept(
            drawn.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
