"""Feeds between versions, and what their plan shuffles."""

from pyspark.sql import functions as F

from tamis.operators.changes import apply_feed, change_feed, reset_where_changed, write_version

SCHEMA = "id long, name string, tags array<string>, n struct<a:int>, state string"
OLD = [(1, "a", ["x"], (1,), "done"), (2, "b", None, None, "done"), (3, "c", [], (3,), "done"), (4, None, ["x", None], (None,), "done"), (None, "none", None, None, "done")]
NEW = [(1, "a", ["x"], (1,), "done"), (2, "B", None, None, "done"), (4, None, ["x", "y"], (None,), "done"), (5, "e", None, None, None), (None, "other", None, None, "done")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_feed_turns_the_old_version_into_the_new_one(spark):
    old, new = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (OLD, NEW))
    feed = change_feed(old, new, "id")
    assert sorted((r["id"] or 0, r["change"]) for r in feed.collect()) == [(0, "update"), (2, "update"), (3, "delete"), (4, "update"), (5, "insert")]
    one = {r["id"]: r for r in feed.collect()}
    assert one[2]["before"]["name"] == "b" and one[2]["after"]["name"] == "B" and one[3]["after"] is None and one[5]["before"] is None
    assert rows(apply_feed(old, feed, "id")) == rows(new) and rows(apply_feed(new, change_feed(new, old, "id"), "id")) == rows(old)
    assert change_feed(old, old, "id").count() == 0 and rows(apply_feed(old.limit(0), change_feed(old.limit(0), new, "id"), "id")) == rows(new)
    again = {r["id"]: r["after"]["state"] for r in reset_where_changed(feed, ["name"], {"state": "new"}).filter("change != 'delete'").collect()}
    assert again == {2: "new", 4: "done", 5: None, None: "new"}


def test_versions_in_buckets_are_merged_without_a_shuffle(spark, tmp_path):
    base = spark.range(500).withColumn("v", F.col("id") % 7)
    later = base.filter("id % 10 != 0").withColumn("v", F.when(F.col("id") % 11 == 0, -1).otherwise(F.col("v"))).union(spark.range(900, 905).withColumn("v", F.lit(0)))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old, new = (write_version(df, name, "id", buckets=4, path=str(tmp_path / name)) for df, name in ((base, "version_a"), (later, "version_b")))
        feed = change_feed(old, new, "id")
        plan = feed._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "Exchange hashpartitioning" not in plan
        assert feed.groupBy("change").count().count() == 3 and rows(apply_feed(old, feed, "id")) == rows(later)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        for name in ("version_a", "version_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
