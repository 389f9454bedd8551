"""Connected components of a graph of 64-bit ids, as a loop of joins over shrinking tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of the edges (u, v) the smallest id it is connected with.

    Each round hooks every label to the smallest label it meets, shortens the chains of hooks, and
    contracts the edges; what is left is written below ``spark.checkpoint.dir``, so neither plans nor
    lineage grow. The number of rounds is about the logarithm of the longest path. Hooks
    are minima of groups, counted with map-side aggregation, so nodes of high degree are not gathered.
    """
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    edges = stored(edges.where("u <> v").select(*pair).distinct(), "edges")
    labels = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
    while edges.limit(1).count():
        hook = edges.groupBy("v").agg(F.min("u").alias("u"))
        # two jumps: a label's hook's hook; hooks always go down, so this cannot cycle
        for _ in range(2):
            up = hook.select(F.col("v").alias("w"), F.col("u").alias("top"))
            hook = hook.join(up, F.col("u") == F.col("w"), "left").select("v", F.coalesce("top", "u").alias("u"))
        hook = stored(hook, "hooks")
        to = hook.select(F.col("v").alias("from"), F.col("u").alias("to"))
        labels = stored(
            labels.join(to, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels"
        )
        ends = edges
        for end in ("u", "v"):
            ends = ends.join(to, F.col(end) == F.col("from"), "left").withColumn(end, F.coalesce("to", end)).drop("from", "to")
        edges = stored(ends.where("u <> v").select(*pair).distinct(), "edges")
    return labels
