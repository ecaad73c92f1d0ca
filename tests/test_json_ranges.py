"""JSON arrays in byte ranges of a few bytes against a whole parse."""

import json
import random

import pytest

from tamis.sources.json_ranges import json_records

SCHEMA = "id long, text string, tags array<string>, more struct<a:long,b:array<struct<c:string>>>"


def made(n, seed):
    rng = random.Random(seed)
    odd = ["}", "{", "[", "]", '"', "\\", "\\\\", '\\"', "},{", "é", " ", "\n", " ", "x", "", '":[']
    some = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    return [{"id": i, "text": some(), "tags": [some() for _ in range(rng.randrange(3))], "more": {"a": i, "b": [{"c": some()} for _ in range(rng.randrange(3))]}} for i in range(n)]


def plain(r):
    return {"id": r["id"], "text": r["text"], "tags": r["tags"], "more": r["more"].asDict(recursive=True) if r["more"] else None}


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, path, field=None):
    schema = spark.createDataFrame([], SCHEMA).schema
    records, files = json_records(spark, str(path), schema, field)
    return sorted((plain(r) for r in records.collect()), key=lambda r: r["id"]), {r["file"].rpartition("/")[2]: r["kind"] for r in files.collect()}


@pytest.mark.parametrize(("bytes_", "indent"), [(37, None), (300, 2), (10_000_000, None)])
def test_ranges_equal_a_whole_parse(spark, tmp_path, small_ranges, bytes_, indent):
    small_ranges(bytes_)
    rows = made(24, bytes_)
    rows[3]["text"] = "long } text \\ " * 40  # over many ranges
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    found, kinds = read(spark, tmp_path / "a.json")
    assert found == rows and kinds == {"a.json": "OK"}
    if bytes_ == 37:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 10


def test_kinds_of_files_and_whole_records_of_broken_ones(spark, tmp_path, small_ranges):
    small_ranges(60)
    rows = made(6, 1)
    whole = json.dumps(rows)
    ends = [i + 1 for i, c in enumerate(whole) if whole[:i + 1].count("{") and _parses(whole[: i + 1])]
    files = {
        "empty": "", "blank": " \n\t ", "ok": whole + "\n", "none": "[]", "bom": "﻿" + whole, "cut_in_record": whole[: ends[2] + 9], "cut_after_record": whole[: ends[3]],
        "cut_after_comma": whole[: ends[1] + 1], "object": json.dumps(rows[0]), "words": "not json", "twice": whole + "]", "goes_on": whole + " x", "numbers": "[1, 2, 3]",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    kinds = {r["file"].rpartition("/")[2]: r["kind"] for r in json_records(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema)[1].collect()}
    assert kinds == {f"{k}.json": v for k, v in dict(
        empty="EMPTY", blank="EMPTY", ok="OK", none="OK", bom="OK", cut_in_record="TRUNCATED", cut_after_record="TRUNCATED", cut_after_comma="TRUNCATED", object="INVALID", words="INVALID", twice="INVALID", goes_on="INVALID", numbers="OK",
    ).items()}
    for name, n in (("cut_in_record", 3), ("cut_after_record", 4), ("cut_after_comma", 2), ("bom", 6), ("numbers", 0)):
        assert read(spark, tmp_path / f"{name}.json")[0] == rows[:n], name


def _parses(head):
    try:
        json.loads(head + "]")
    except ValueError:
        return False
    return True


@pytest.mark.parametrize("bytes_", [45, 100_000])
def test_an_array_in_an_object(spark, tmp_path, small_ranges, bytes_):
    small_ranges(bytes_)
    rows, others = made(9, 2), [{"id": 100 + i, "text": "run"} for i in range(5)]
    store = {"note": 'a "leads":[ in a text', "runs": others, "nested": {"leads": [{"id": 500}]}, "leads": rows, "tail": [[{"id": 600}], []]}
    (tmp_path / "s.json").write_text(json.dumps(store))
    found, kinds = read(spark, tmp_path / "s.json", "leads")
    assert found == rows and kinds == {"s.json": "OK"}
    (tmp_path / "s.json").write_text(json.dumps(store)[:-30])
    assert read(spark, tmp_path / "s.json", "leads") == (rows, {"s.json": "TRUNCATED"})
    assert len(read(spark, tmp_path / "s.json", "runs")[0]) == 5 and read(spark, tmp_path / "s.json", "absent")[0] == []


def test_elements_that_are_no_objects(spark, tmp_path, small_ranges):
    small_ranges(20)
    rows = made(6, 7)
    mixed = [rows[0], [[{"id": 50}, "}"], [" a long text in an array " * 5]], rows[1], "a { text", 7, None, rows[2], [rows[3]], *rows[4:]]
    (tmp_path / "m.json").write_text(json.dumps(mixed))
    assert read(spark, tmp_path / "m.json") == ([r for r in rows if r["id"] != 3], {"m.json": "OK"})


def test_packed_files(spark, tmp_path):
    rows = made(5, 4)
    spark.createDataFrame([(json.dumps(rows),)], "v string").coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "z"))
    found, kinds = read(spark, tmp_path / "z")
    assert found == rows and set(kinds.values()) == {"OK"}
