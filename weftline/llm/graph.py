"""Connected components as joins and aggregates; nothing but a count of changes reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the least node of each component, for all nodes of edges (a, b).

    Each round points every node at the least root among its neighbours and then at that root's own
    root, until nothing changes. Roots only fall, and pointing at roots of roots halves paths, so a
    long chain takes few rounds. Aggregates are combined before each shuffle, so a node with very
    many neighbours is no single task.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    state = scratch.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots0")
    turn = 0
    while True:
        turn += 1
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = state.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        up = step.join(state.select(F.col("node").alias("low"), F.col("root").alias("above")), "low", "left")
        new = scratch.save(up.select("node", F.least("low", F.coalesce("above", "low")).alias("root"), F.col("root").alias("was")), f"roots{turn}")
        if not new.filter("root <> was").limit(1).count():
            return new.select("node", "root")
        state = new.select("node", "root")
