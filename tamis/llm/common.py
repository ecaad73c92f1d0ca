"""Shared helpers of the training-data operators: text keys, row keys and tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.components import remove_path, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = "\t\n\x0b\x0c\r "


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def wide_hash(text: Column) -> list[Column]:
    """Two 64-bit hashes of different seeds, together a 128-bit key."""
    return [F.xxhash64(text), F.xxhash64(F.lit(0x5BD1E995), text)]


def col(*names: str) -> Column:
    """A column by its exact name, whatever characters that holds; more names lead into its fields."""
    return F.col(".".join("`" + n.replace("`", "``") + "`" for n in names))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """The rows written to a table in the shared folder and read again: a cut in the lineage that outlives executors. Its path
    is added to `paths`, whose tables the caller removes once nothing reads them."""
    path = new_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Entries of each of the two generations of a cache; some 40 MB each.
CACHE = 200_000


class ChunkCache:
    """chunk -> value in two generations: what is used moves to the young one, and the old one is dropped when it is full."""

    def __init__(self, make, limit: int = CACHE):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def have(self, chunks: set[bytes]) -> dict[bytes, object]:
        young, old = self.young, self.old
        missing = []
        for c in chunks.difference(young):
            v = old.get(c)
            if v is None:
                missing.append(c)
            else:
                young[c] = v
        if missing:
            young.update(zip(missing, self.make(missing)))
        if len(young) > self.limit:
            self.young, self.old = {}, young
        return young
