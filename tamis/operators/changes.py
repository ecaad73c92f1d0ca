"""What changed between two versions of a table: a feed of inserts, updates and deletes with both sides.

Versions are kept in as many buckets, sorted by key, so that comparing them merges bucket with bucket and shuffles nothing.
A feed applied to the old version gives the new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_version(df: DataFrame, name: str, key: str, *, buckets: int, path: str | None = None) -> DataFrame:
    """Stores a version as the catalog's table `name`, in buckets of the key, and returns it; `path` is its folder where it
    isn't the warehouse's. A table that large needs as many buckets as tasks should merge it."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def change_feed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """JSN-2, UPS-5: (key, change, before, after) of the keys whose rows differ: change is insert, update or delete; before and
    after are the rows as structs, null where there is none. Both versions have the same columns and a key once; values are
    compared as they are, nulls as equal, and a null key is a key. Maps can't be compared."""
    row = F.struct(*(f"`{c}`" for c in old.columns))
    a = old.select(F.col(key).alias("_a"), row.alias("before"))
    b = new.select(F.col(key).alias("_b"), F.struct(*(f"`{c}`" for c in old.columns)).alias("after"))
    # Equal keys keep the buckets; the row without a key on either side is one at most.
    met = a.filter("_a is not null").join(b.filter("_b is not null"), F.col("_a") == F.col("_b"), "full_outer")
    no_key = a.filter("_a is null").limit(1).join(b.filter("_b is null").limit(1), F.lit(True), "full_outer")
    both = met.unionByName(no_key)
    change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(F.coalesce("_a", "_b").alias(key), change.alias("change"), "before", "after")


def apply_feed(old: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The version after a feed: rows that it names go, and those that it brings come."""
    named = feed.select(F.col(key).alias("_key"))
    stay = old.join(named, old[key].eqNullSafe(F.col("_key")), "left_anti")
    return stay.unionByName(feed.filter("after is not null").select("after.*"))


def reset_where_changed(feed: DataFrame, watched: list[str], reset: dict[str, object]) -> DataFrame:
    """UPS-5: the feed with columns of `after` set anew where an update changes one of the watched columns: what was worked out
    from a record is worked out again."""
    hit = F.col("before").isNotNull() & F.col("after").isNotNull()
    differs = F.lit(False)
    for c in watched:
        differs = differs | ~F.col(f"before.`{c}`").eqNullSafe(F.col(f"after.`{c}`"))
    after = F.col("after")
    for c, value in reset.items():
        after = after.withField(f"`{c}`", F.lit(value).cast(feed.schema["after"].dataType[c].dataType))
    return feed.withColumn("after", F.when(hit & differs, after).otherwise(F.col("after")))
