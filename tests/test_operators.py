"""Table operators, sources, sinks and streams on small hand-written tables."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from tamis.operators import core as O
from tamis.operators.components import components
from tamis.sources import pages as P
from tamis.sources import sinks, tables
from tamis.streaming import records as R


def test_quota():
    assert O.quota(100, 50, 0.22, 15) == 29
    assert O.quota(100, 50, 0.25, 25) == 34
    assert O.quota(0, 50, 0.22, 15) == 50
    assert O.quota(100, 0, 0.22, 15) == 0


def test_quota_rows_are_the_same_either_way(spark):
    df = spark.createDataFrame([(i, i * 7 % 5, i % 3 == 0) for i in range(90)], "ord int, score int, c boolean").repartition(5)
    order = [F.desc("score"), F.asc("ord")]
    ways = [sorted(tuple(r) for r in O.limit_share(df, F.col("c"), order, 0.1, 4, most_at_once=m).collect()) for m in (0, 1000)]
    first = sorted((i for i in range(90) if i % 3 == 0), key=lambda i: (-(i * 7 % 5), i))[: O.quota(60, 30, 0.1, 4)]
    assert ways[0] == ways[1] and [r[0] for r in ways[0] if r[2]] == sorted(first)


def test_first_per_breaks_ties_by_order(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), (None, 2, 2), (None, 1, 3)], "k string, s int, ord int")
    assert {(r["k"], r["ord"]) for r in O.first_per(df, "k", [F.desc("s"), F.asc("ord")]).collect()} == {("a", 0), (None, 2)}


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_linkage_is_transitive_in_any_order(spark, order):
    rows = [(1, ["k1"]), (2, ["k2"]), (3, ["k1", "k2"])]
    df = spark.createDataFrame([rows[i] for i in order] + [(9, []), (10, [None, ""])], "id long, keys array<string>")
    assert {(r["id"], r["entity"]) for r in O.link_records(df, "id", "keys").collect()} == {(1, 1), (2, 1), (3, 1), (9, 9), (10, 10)}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(100, i) for i in range(101, 160)]
    found = components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_upsert(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    current = spark.createDataFrame([(1, "a", "won", "note", ["r0"]), (2, "b", "", None, None)], "id long, name string, stage string, notes string, run_ids array<string>")
    current = current.withColumns({"first_seen": F.lit("2024-01-01").cast("timestamp"), "last_seen": F.lit("2024-01-01").cast("timestamp")})
    incoming = spark.createDataFrame([(1, "A", 0), (3, "c", 1), (3, None, 2), (3, "C", 3)], "id long, name string, ord int")
    found = {r["id"]: r for r in O.upsert(current, incoming, key="id", run_id="r1", now=now).collect()}
    assert (found[1]["name"], found[1]["stage"], found[1]["notes"], found[1]["run_ids"], found[1]["change"]) == ("A", "won", "note", ["r0", "r1"], "updated")
    assert (found[2]["stage"], found[2]["change"]) == ("new", "kept")
    assert (found[3]["name"], found[3]["run_ids"], found[3]["change"]) == ("C", ["r1"], "created")
    assert found[1]["first_seen"] < found[1]["last_seen"]


def test_due_reasons(spark):
    df = spark.createDataFrame([(None, False, False, 10), ("2024-01-01 00:00:00", True, False, 10), ("2024-01-01 01:00:00", True, False, 10), ("2023-12-29 00:00:00", False, True, 80)], "last string, contactless boolean, hot boolean, complete int")
    due = O.due_reason(F.lit("2024-01-02").cast("timestamp"), F.col("last").cast("timestamp"), F.col("contactless"), F.col("hot"), F.col("complete"))
    assert [r["due"] for r in df.select(due.alias("due")).collect()] == ["never", "contactless", None, "scheduled"]


HTML = """<html><head><title>Acme &amp; Co</title><meta name="description" content="About us"><script>var x = "a@b.com"</script></head>
<body><p>Write to maria@acme.com or +44 20 7946 0958.<a href="/contact">Contact</a> <a href="https://www.linkedin.com/in/a-b">In</a>
<form action="/send" method="POST"><input name="email"><textarea name="message"></textarea></form></body>"""


def test_page_extract(spark):
    df = spark.createDataFrame([(1, "https://acme.com/team", HTML), (2, None, None)], "page_id long, url string, html string")
    one, two = P.with_contacts(P.extract_pages(df)).orderBy("page_id").collect()
    assert (one["title"], one["description"], one["links"]) == ("Acme & Co", "About us", ["https://acme.com/contact", "https://www.linkedin.com/in/a-b"])
    assert (one["emails"], one["phones"], one["direct_links"]) == (["maria@acme.com"], ["+44 20 7946 0958"], ["https://www.linkedin.com/in/a-b"])
    assert [f["action"] for f in one["contact_forms"]] == ["https://acme.com/send"]
    assert (two["title"], two["links"], two["emails"]) == ("", [], [])


def test_json_store_and_corrupt_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"id": "a", "score": 3}, {"id": "b"}]))
    (tmp_path / "bad.json").write_text("{not json")
    good, bad = tables.json_store(spark, str(tmp_path))
    assert {(r["id"], r["score"]) for r in good.collect()} == {("a", 3), ("b", None)}
    assert bad.count() == 1


def test_log_tail_and_file_metadata(spark, tmp_path):
    (tmp_path / "run.log").write_text("one\n\ntwo\nthree\n")
    assert [r["value"] for r in tables.log_tail(spark, str(tmp_path / "run.log"), 2).collect()] == ["three", "two"]
    assert tables.file_metadata(spark, str(tmp_path)).first()["length"] == 15


def test_exports_and_replacement(spark, tmp_path):
    df = spark.range(10).withColumn("name", F.concat(F.lit("n,"), "id"))
    sinks.write_exports(df, {"small": F.col("id") < 3, "even": F.col("id") % 2 == 0}, str(tmp_path / "views"))
    assert {r["export_view"]: r["count"] for r in spark.read.parquet(str(tmp_path / "views")).groupBy("export_view").count().collect()} == {"small": 3, "even": 5}
    table = str(tmp_path / "table")
    sinks.replace_table(df, table)
    sinks.replace_table(sinks.read_table(spark, table).filter("id < 5"), table)
    assert sinks.read_table(spark, table).count() == 5 and sinks.versions(spark, table) == [1, 2]
    sinks.replace_table(df.limit(3), table)
    assert sinks.read_table(spark, table).count() == 3 and sinks.versions(spark, table) == [2, 3]
    sinks.write_csv(df.limit(1), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).first()["value"] == '0,"n,0"'


def test_a_crash_at_any_step_leaves_the_table_whole(spark, tmp_path):
    table, df = str(tmp_path / "table"), spark.range(10)
    sinks.replace_table(df, table)
    # While the next version is written: some files, no commit.
    (tmp_path / "table" / "v2").mkdir()
    (tmp_path / "table" / "v2" / "part-0.parquet").write_bytes(b"half")
    assert sinks.read_table(spark, table).count() == 10
    sinks.replace_table(df.filter("id < 4"), table)
    assert sinks.read_table(spark, table).count() == 4 and sinks.versions(spark, table) == [1, 2]
    # After the commit, before old versions go.
    spark.range(2).write.parquet(f"{table}/v3")
    assert sinks.read_table(spark, table).count() == 2
    sinks.replace_table(df, table)
    assert sinks.read_table(spark, table).count() == 10 and sinks.versions(spark, table) == [3, 4]


def test_json_and_archive(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "id long, name string")
    sinks.write_json(df, str(tmp_path / "json"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "json")).collect()) == ['{"id":1,"name":null}', '{"id":2,"name":"b"}']
    left = sinks.archive_before(df, F.col("id") == 2, str(tmp_path / "old"))
    assert [r["id"] for r in left.collect()] == [1] and [r["id"] for r in spark.read.parquet(str(tmp_path / "old/rejected")).collect()] == [2]
    assert len(sinks.report_lines(spark.range(1500), "t")) == 1504


def test_ranks_and_round_robin_without_a_limit(spark):
    df = spark.range(50).select("id", F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 3).cast("string")).alias("b"))
    found = {r["id"]: r["rank"] for r in O.ranked(df, [F.desc("id")]).collect()}
    assert found == {i: 50 - i for i in range(50)}
    for offset in (0, 5):
        whole = [(r["id"], r["turn"]) for r in O.round_robin(df, "b", F.lit(0), [F.asc("id")], offset=offset).collect()]
        some = [(r["id"], r["turn"]) for r in O.round_robin(df, "b", F.lit(0), [F.asc("id")], offset=offset, limit=12).collect()]
        assert len(whole) == 50 and some == whole[:12]


def test_cooldown_and_stale_workers(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-01-01 23:00:00"), (3, "2024-01-01 10:00:00")], "id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    now = F.lit("2024-01-02").cast("timestamp")
    assert [r["id"] for r in df.filter(R.cooled_down(now, F.col("at"), 8)).orderBy("id").collect()] == [1, 3]
    assert sorted(r["id"] for r in R.stale(df, now, "at", 90).collect()) == [1, 3]


def test_stream_upsert_and_first_seen(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    empty = spark.createDataFrame([], "id long, name string, stage string, notes string, run_ids array<string>, first_seen timestamp, last_seen timestamp")
    for n, batch in enumerate(([(1, "a", 0), (2, "b", 1)], [(2, "B", 2), (3, "c", 3)])):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "name": x, "ord": o}) for i, x, o in batch))
        stream = spark.readStream.schema("id long, name string, ord int").json(str(source))
        R.upsert_stream(stream, table, str(tmp_path / "cp"), key="id", now=lambda: F.lit("2024-01-01").cast("timestamp"), empty=empty).awaitTermination()
    found = {r["id"]: (r["name"], r["run_ids"]) for r in R.read_upserted(spark, table).collect()}
    assert found == {1: ("a", ["batch-0"]), 2: ("B", ["batch-0", "batch-1"]), 3: ("c", ["batch-1"])}


def test_stream_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 05:00:00", "b"), ("2024-01-02 05:00:00", "b")]
    (tmp_path / "e.json").write_text("\n".join(json.dumps({"ts": t, "k": k}) for t, k in rows))
    stream = spark.readStream.schema("ts timestamp, k string").json(str(tmp_path))
    q = R.windowed_counts(stream, "ts", ["k"], "1 hour").writeStream.format("memory").queryName("wins").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r["window"]["start"]), r["k"], r["n"]) for r in spark.table("wins").collect()} >= {("2024-01-01 00:00:00", "a", 2)}


def test_result_anchors_are_all_outgoing_links(spark):
    hosts = {1: "own.example", 2: "two.example", 3: "three.example"}
    links = {1: [f"https://a{n % 14}.example/p" for n in range(20)] + ["https://own.example/x"], 2: ["https://two.example/y"], 3: [f"https://b.example/{n}" for n in range(3)]}
    pages = [(i, f"https://{hosts[i]}/", "<html><body>" + "".join(f'<a href="{u}">t{n}</a>' for n, u in enumerate(x)) + "</body></html>") for i, x in links.items()]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    expected = {(i, u) for i, x in links.items() for u in x if hosts[i] not in u}
    found = P.result_anchors(df).collect()
    assert sorted((r["page_id"], r["url"]) for r in found) == sorted(expected)
    assert all(r["title"] == f"t{links[r['page_id']].index(r['url'])}" for r in found)
    assert sum(r["page_id"] == 1 for r in P.result_anchors(df, 10).collect()) == 10


def test_periodic_export_writes_a_version_for_each_batch(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "export")
    source.mkdir()
    for n in range(2):
        (source / f"{n}.json").write_text(json.dumps({"id": n}))
        stream = spark.readStream.schema("id long").json(str(source))
        R.periodic_export(stream, table, str(tmp_path / "cp"), once=True).awaitTermination()
        assert [(r["id"], r["batch"]) for r in sinks.read_table(spark, table).collect()] == [(n, n)]


def test_dead_letters_and_renamed_columns(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, e int")
    assert sorted(tuple(r) for r in O.dead_letters(df, ["k"], F.col("e"), 2).collect()) == [("a", 2, 5, True), ("b", 1, 2, False)]
    rows = spark.createDataFrame([(1, " ", "x "), (2, None, None)], "i int, a string, b string")
    assert [tuple(r) for r in O.renamed(rows, {"id": "i", "name": ["a", "b"]}, {"name": "none"}).orderBy("id").collect()] == [(1, "x"), (2, "none")]


def test_linkage_sends_no_rows_to_the_driver(spark):
    """Stored tables of few bytes and many rows aren't broadcast."""
    df = spark.range(200).select("id", F.array((F.col("id") % 50).cast("string"), F.lit(None).cast("string")).alias("keys"))
    found = O.link_records(df, "id", "keys")
    assert {r["id"]: r["entity"] for r in found.collect()} == {i: i % 50 for i in range(200)}
    assert "Broadcast" not in found._jdf.queryExecution().toString()
