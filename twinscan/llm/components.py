"""Connected components of a graph given as edges, on Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscan.llm.common import delete, scratch_folder


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b: long, not null); root is the smallest node reachable.

    Each round, every node takes the smallest label among its neighbours and itself (partially aggregated
    before the shuffle), and then the label of that label. The pointer step halves paths, so rounds grow with
    the logarithm of the longest one. Labels are written to the shared folder each round, which cuts lineage.
    """
    spark = edges.sparkSession
    folder = f"{scratch_folder(spark)}/twinscan-components-{uuid.uuid4().hex}"
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both.write.parquet(f"{folder}/edges")
    both = spark.read.schema("a long, b long").parquet(f"{folder}/edges")
    both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")).write.parquet(f"{folder}/0")
    done = 0
    while True:
        labels = spark.read.schema("node long, root long").parquet(f"{folder}/{done}")
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("of")).agg(F.min("root").alias("offered"))
        lower = labels.join(near, F.col("node") == F.col("of"), "left").select("node", F.col("root").alias("old"), F.least("root", "offered").alias("root"))
        above = labels.select(F.col("node").alias("via"), F.col("root").alias("up"))
        nxt = lower.join(above, F.col("root") == F.col("via"), "left").select("node", F.least("root", "up").alias("root"), "old")
        nxt.write.parquet(f"{folder}/{done + 1}")
        changed = spark.read.parquet(f"{folder}/{done + 1}").where("root <> old").limit(1).count()
        delete(spark, f"{folder}/{done}")
        done += 1
        if not changed:
            return spark.read.schema("node long, root long").parquet(f"{folder}/{done}")
