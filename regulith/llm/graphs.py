"""Connected components of an edge table, and the scratch tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulith.session import scratch_path


class Scratch:
    """Tables in the shared folder; ``drop`` removes those that later results do not read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def keep(self, df: DataFrame, label: str) -> tuple[DataFrame, str]:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def connected_components(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """(node, component) for every node of (a, b): the component is its least node. Also the path of that table.

    Rounds go on until every edge joins a node with the least node of its component. Each hangs the larger neighbours of
    a node, then the smaller ones, on the least node around it; chains shrink by half or more. Only counts travel to the
    driver.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, path = scratch.keep(edges.repartition("a").distinct(), "edges")
    while not stars(edges):
        both = edges.union(edges.select("b", "a")).repartition("a")
        heads = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        far = both.join(heads, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).repartition("a").distinct()
        heads = far.groupBy("a").agg(F.min("b").alias("m"))
        near = far.join(heads, "a")
        near = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))
        near, near_path = scratch.keep(near.where("a <> b").distinct(), "edges")
        scratch.drop(path)
        edges, path = near, near_path
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), path


def stars(edges: DataFrame) -> bool:
    """Whether every node either hangs on exactly one other node or has others hanging on it, never both."""
    sides = edges.select(F.col("a").alias("node"), F.lit(1).alias("below")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("below")).distinct())
    degrees = sides.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("n"))
    return degrees.where("below > 1 or below = 1 and n > 1").isEmpty()
