"""Backups, status files, long logs, titles and text views."""

import json
import os

from pyspark.sql import functions as F

from tamis.functions import qualify as Q
from tamis.functions import text as T
from tamis.sources import tables


def test_newest_backup_has_each_record_once(spark, tmp_path):
    for n, rows in enumerate([[{"id": "a", "score": 1}, {"id": "b", "score": 1}], [{"id": "a", "score": 2}, {"id": "c", "score": None}]]):
        path = tmp_path / f"backup-{n}.json"
        path.write_text("\n".join(map(json.dumps, rows)) + "\n{broken")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    found = tables.newest_backup(spark, [str(tmp_path / "backup-1.json"), str(tmp_path / "backup-0.json")])
    assert {r["id"]: r["score"] for r in found.filter("id is not null").collect()} == {"a": 2, "b": 1, "c": None}


def test_status_files(spark, tmp_path):
    (tmp_path / "enrich-status.json").write_text(json.dumps({"status": "running", "updatedAt": "2024-01-01T00:00:00Z"}, indent=1))
    (tmp_path / "smart-status.json").write_text(json.dumps({"status": "idle", "updatedAt": "2024-01-01T00:45:00Z"}))
    found = tables.status_files(spark, str(tmp_path / "*-status.json"), F.lit("2024-01-01 01:00:00").cast("timestamp"))
    assert {(r["worker"], r["status"], r["age_minutes"]) for r in found.collect()} == {("enrich", "running", 60.0), ("smart", "idle", 15.0)}


def test_log_tail_of_many_ranges(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 13)}" for i in range(500)]
    (tmp_path / "run.log").write_text("\n".join(lines) + "\n\n")
    part = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = [spark.conf.get(p) for p in part]
    spark.conf.set(part[0], "700"), spark.conf.set(part[1], "0")
    try:
        assert [r["value"] for r in tables.log_tail(spark, str(tmp_path / "run.log"), 120).collect()] == lines[:-121:-1]
    finally:
        for p, v in zip(part, old):
            spark.conf.set(p, v)


def test_titles_and_text_views(spark):
    rows = [("https://a.example/x  Gold  Trader | Some Site", "Contact: Ana. Phone: 1\nFax: 2", "x", ["t", "u"]), ("- Plain:, ", None, "", None), (None, "no marker", None, [])]
    df = spark.createDataFrame(rows, "title string, body string, name string, tags array<string>")
    out = df.select(T.clean_title("title").alias("t"), T.drop_after("body", ["phone", "fax"]).alias("b"), T.text_view("name", F.col("tags")).alias("v")).collect()
    assert [(r["t"] or "", r["v"]) for r in out] == [("Gold Trader", "x t u"), ("Plain", ""), ("", "")]
    assert [r["b"] and r["b"].split() for r in out] == [["Contact:", "Ana."], None, ["no", "marker"]]


def test_texts_that_searches_leave(spark):
    cases = {
        "Ana. YouTube creator/channel result for gold. Related titles: One; Two": "Ana. Related titles: One; Two", "A YouTube creator/channel result for x": "A Related titles:",
        "YouTube creator/channel result for a Related titles: YouTube creator/channel result for b": "Related titles: YouTube creator/channel result for b",
        'qwant web result for "forex ib" real text': "real text", "real  extracted URL from somewhere": "real", "Matched public source: x y Source pack: z. end": "z. end", "a Source pack: b. c": "a c", "Found via search; shown": "shown",
        "x TikTok public user/profile found for q. Matched forex/trading search context: gold; y": "x y", "MQL5 public signal provider matched gold": "", "Potential copy trading, signal provider, money manager or high-calibre trader lead. Hi": "Hi",
        "Extracted candidate for a\nsecond line": "Extracted candidate for a second line", "plain": "plain",
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    assert [r[0] for r in df.select(T.strip_generated("t")).collect()] == [*cases.values(), ""]


def test_due_codes_at_the_defaults(spark):
    rows = [(None, 0, False, "never"), (0.9, 0, False, None), (1.0, 34, False, "contactless_due"), (1.0, 35, True, "scheduled_due"), (2.0, 35, False, "rotation_due"), (1.9, 35, False, None), (6.0, 35, False, "scheduled_due")]
    df = spark.createDataFrame([(h, c, hot) for h, c, hot, _ in rows], "hours double, complete int, hot boolean")
    now = F.lit("2024-01-02").cast("timestamp")
    last = F.timestamp_micros(F.unix_micros(now) - (F.col("hours") * 3_600_000_000).cast("long"))
    assert [r[0] for r in df.select(Q.due_code(now, last, F.col("complete"), F.col("hot"))).collect()] == [r[3] for r in rows]


def test_pages_leave_the_parser_a_few_at_a_time():
    import pyarrow as pa

    from tamis.sources import pages as P

    html = ["<a href='https://x.example/'>x</a>" * 3, None, "<title>t</title>" + "b" * (P.CHARACTERS // 2)] * 100
    given = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["https://own.example/"] * 299 + [None]), pa.array(html)], ["page_id", "url", "html"])
    out = list(P._extract(iter([given])))
    assert [i for b in out for i in b.column("page_id").to_pylist()] == list(range(300))
    assert all(b.num_rows <= P.AT_ONCE and sum(len(html[i] or "") for i in b.column("page_id").to_pylist()) < 2 * P.CHARACTERS for b in out)
    assert out[0].to_pylist()[0]["links"] == ["https://x.example/"] * 3 and out[0].to_pylist()[1]["body"] == "" and out[0].to_pylist()[2]["title"] == "t"
