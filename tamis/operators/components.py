"""Connected components of an edge table as Spark jobs: alternating large-star and small-star rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a temporary one; on a cluster the
    executors would each have their own, so it must be set there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tamis-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "edges", paths: list[str] | None = None) -> DataFrame:
    """The rows written to a table in the shared folder and read again; its path is added to `paths`."""
    path = new_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffled(df: DataFrame) -> DataFrame:
    """The rows, joined by a shuffle of both sides. A stored table's files are many times smaller than its rows; Spark goes by
    the files, and would send the rows to the driver to broadcast them."""
    return df.hint("merge")


def _with_least(edges: DataFrame, paths: list[str]) -> DataFrame:
    """(u, v, least): least is the smallest of u and all its neighbours: a partial aggregate and a join. The aggregate is
    stored, so that the join has plain shuffles on both sides and Spark can split a hub's rows."""
    least = stored(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")), "least", paths)
    return edges.join(shuffled(least), "u")


def components(edges: DataFrame, max_rounds: int = 50, tables: list[str] | None = None) -> DataFrame:
    """edges (a, b), any orderable type -> (node, component): the least node that it is connected with.

    Nodes are those of some edge between different nodes. Every round writes its edges to the shared folder, so an
    executor's loss costs one round at most; the tables of earlier rounds are removed. The last one's path is added to
    `tables`, for a caller who removes it once the result is written.
    """
    paths: list[str] = []
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), paths=paths)
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # Large star: every larger neighbour is tied to the least of the neighbourhood.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, paths).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are tied to the least of them.
        met = _with_least(large, paths)
        small = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        now = stored(small, paths=paths)
        for path in paths[:-1]:
            remove_path(edges.sparkSession, path)
        del paths[:-1]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if tables is not None:
        tables += paths
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
