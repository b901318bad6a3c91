"""Connected components of a link table, distributed: no link, label or component reaches the driver."""

from pyspark.sql import DataFrame, functions as F

from groundsieve.llm.common import written


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b; longs): label is the smallest node it can reach.

    Each round, a node takes the smallest label around it and then that label's own label, so paths halve; a round's
    table is written to the shared folder. A hub's links are aggregated before they are shuffled.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(most):
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hook = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        fresh = written(hook.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        labels = fresh.select("node", "label")
        if not fresh.where("label < old").limit(1).count():
            return labels
    raise RuntimeError(f"components have not settled after {most} rounds")
