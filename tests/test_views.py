"""Quick views, download rows and the timeline."""

import json

from pyspark.sql import functions as F

from tamis.functions import views as V
from tamis.sources import sinks


def test_quick_views(spark):
    rows = [(1, "A", None, 0, 10, [], None, 0), (2, "B", "A", None, None, ["x"], "", 0), (3, "B", "B", 75, 99, None, "tel", 0), (4, None, None, 0, 76, [], "", 2), (5, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, priority string, tier string, commercial int, score int, emails array<string>, best string, n_forms int")
    hot, contact = V.is_hot("priority", "tier", "commercial", "score"), V.has_contact(df, ["emails", "best", "n_forms"])
    of = lambda view: sorted(r["id"] for r in df.filter(V.quick_view(view, hot, contact)).collect())
    assert (of("hot"), of("contactable"), of("no-contact"), of("all")) == ([1, 2, 4], [2, 3, 4], [1, 5], [1, 2, 3, 4, 5])


def test_download_rows(spark):
    form = "array<struct<page_url:string,action:string,fields:array<string>>>"
    df = spark.createDataFrame([(7, 'A, "b"', ["a@x.example", "b@x.example"], [("https://p.example", "/send", ["name", "mail"]), (None, None, None)], "web")], f"commercial_score int, name string, emails array<string>, forms {form}, bucket string")
    out = V.download_rows(df)
    assert out.columns == list(V.DOWNLOAD) and len(out.columns) == 25
    assert sinks.csv_lines(out).first()[0] == '7,web,,,,,,"A, ""b""",,,,,a@x.example; b@x.example,,,,,https://p.example -> /send (name; mail);  ->  (),,,,,,,'


def test_timeline_keeps_the_newest(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        V.append_timeline(spark.createDataFrame([(f"2024-01-0{n + 1}", n)], "at string, raw int").withColumn("extra", F.lit(n)) if n else spark.createDataFrame([("2024-01-01", 0)], "at string, raw int"), path, most=3)
    kept = sinks.read_table(spark, path)
    assert sorted((r["at"], r["raw"]) for r in kept.collect()) == [("2024-01-02", 1), ("2024-01-03", 2), ("2024-01-04", 3)]
    assert json.loads(V.summary_json(spark.createDataFrame([("x", None)], "at string, raw int")).first()[0]) == {"at": "x", "raw": None}
