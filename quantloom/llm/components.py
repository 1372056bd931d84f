"""Connected components of an edge table, by least labels with pointer jumping; every round is a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, new_folder, staged_in


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node that edges connect node with. Only nodes with edges have a row. A round's
    table is discarded once the next is written."""
    spark = edges.sparkSession
    at, last = new_folder(spark, "edges"), new_folder(spark, "labels")
    pairs = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = staged_in(pairs.unionAll(pairs.select(F.col("dst"), F.col("src"))).distinct(), at)
    first = both.groupBy("src").agg(F.min("dst").alias("l"))
    labels = staged_in(first.select(F.col("src").alias("node"), F.least("src", "l").alias("label")), last)
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "dst"}), "dst").groupBy("src").agg(F.min("label").alias("near"))
        near = near.withColumnsRenamed({"src": "node"})
        low = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        path = new_folder(spark, "labels")
        new = staged_in(low.join(up, "low", "left").select("node", "old", F.least("low", "up").alias("label")), path)
        discard(spark, last)
        labels, last = new.select("node", "label"), path
        if new.where("label <> old").limit(1).count() == 0:
            discard(spark, at)
            return labels
