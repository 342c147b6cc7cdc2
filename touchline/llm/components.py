"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for each id in links (a, b): the smallest id that links reach.

    Each round takes the smallest label among the neighbours and the label of the own label (pointer jumping), so stars need
    one round and long chains few. Labels are written to the shared folder between rounds; nothing but a flag comes to the
    driver. Loops are ignored; an empty table gives an empty one.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.table(both, "edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        above = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        step = labels.join(near, "id").join(above, "label").select("id", F.col("label").alias("old"), F.least("label", "near", "above").alias("label"))
        step = scratch.table(step, "labels")
        scratch.drop(labels)
        done = step.where("label <> old").isEmpty()
        labels = step.select("id", "label")
        labels._touchline_path = step._touchline_path
        if done:
            scratch.drop(both)
            return labels.select("id", F.col("label").alias("component_id"))
