"""Change tables and linkage by batches against one run over everything."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tamis.operators import core as O
from tamis.operators.linkage import Linkage
from tamis.sources import change_table
from tamis.sources.change_table import ChangeTable
from tamis.streaming import records as R

SCHEMA = "id long, name string, stage string, tags array<string>, most int"
RULES = {"stage": "first", "tags": "union", "most": "max"}


def batches(seed, n=5, keys=12):
    rng = random.Random(seed)
    some = lambda v: v if rng.random() < 0.7 else None
    return [[(rng.randrange(keys), some(rng.choice("abc")), some(rng.choice("xyz")), some([rng.choice("pqrs") for _ in range(rng.randrange(3))]), some(rng.randrange(9)), i) for i in range(rng.randrange(1, 15))] for _ in range(n)]


def expected(all_):
    out = {}
    for batch in all_:
        one = {}
        for key, name, stage, tags, most, _ in batch:
            row = one.setdefault(key, [None, None, None, None])
            for i, v in enumerate((name, stage)):
                row[i] = v if v is not None else row[i]
            row[2] = (row[2] or []) + [t for t in tags if t not in (row[2] or [])] if tags else row[2]
            row[3] = most if most is not None else row[3]
        for key, (name, stage, tags, most) in one.items():
            row = out.setdefault(key, [None, None, None, None])
            row[0] = name if name is not None else row[0]
            row[1] = stage if row[1] is None else row[1]
            row[2] = (row[2] or []) + [t for t in dict.fromkeys(tags) if t not in (row[2] or [])] if tags else row[2]
            row[3] = max((v for v in (row[3], most) if v is not None), default=None)
    return {k: tuple(v) for k, v in out.items()}


def rows_of(df):
    return {r["id"]: (r["name"], r["stage"], list(dict.fromkeys(r["tags"])) if r["tags"] else None, r["most"]) for r in df.collect()}


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


@pytest.mark.parametrize("fan", [2, 50])
def test_batches_merge_as_one_table(spark, tmp_path, fan):
    all_ = batches(fan)
    kept = ChangeTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], RULES, ranges=4, fan=fan)
    for n, batch in enumerate(all_):
        df = spark.createDataFrame(batch, SCHEMA + ", ord int")
        assert kept.append(df, n, F.col("ord")) and not kept.append(df, n, F.col("ord"))
        levels = [r["level"] for r in kept.runs()]
        assert all(levels.count(v) < fan for v in levels) and levels == sorted(levels, reverse=True)
    again = ChangeTable.open(spark, str(tmp_path / "t"))
    want = expected(all_)
    assert rows_of(again.read()) == want and again.upto() == len(all_) - 1
    sought = spark.createDataFrame([(k,) for k in (0, 3, 99)], "id long")
    assert rows_of(again.lookup(sought)) == {k: want[k] for k in (0, 3) if k in want}
    again.fold(everything=True)
    assert len(again.runs()) == 1 and rows_of(again.read()) == want
    assert ChangeTable.open(spark, str(tmp_path / "none")) is None


def test_lookup_reads_the_ranges_it_needs(spark, tmp_path, capsys):
    kept = ChangeTable(spark, str(tmp_path / "t"), "id long, v int", ["id"], ranges=32)
    kept.append(spark.range(1000).withColumn("v", F.lit(1)), 0)
    found = kept.lookup(spark.createDataFrame([(5,)], "id long"))
    assert [tuple(r) for r in found.collect()] == [(5, 1)]
    found.explain("formatted")
    scans = [x for x in capsys.readouterr().out.splitlines() if x.startswith("PartitionFilters")]
    assert len(scans) == 1 and re.search(r"_range#\d+ = \d+", scans[0])


def test_a_batch_costs_a_batch(spark, tmp_path):
    """Without folding, what a batch writes doesn't grow with the table."""
    kept = ChangeTable(spark, str(tmp_path / "t"), "id long, v string", ["id"], ranges=4, fan=100)
    kept.append(spark.range(20_000).withColumn("v", F.sha2(F.col("id").cast("string"), 256)), 0)
    grown = []
    for n in (1, 2, 3):
        before = size(tmp_path / "t")
        kept.append(spark.range(10).withColumn("v", F.lit("new")), n)
        grown.append(size(tmp_path / "t") - before)
    assert max(grown) < 20_000 < size(tmp_path / "t") / 10
    assert kept.read().filter("v = 'new'").count() == 10 and kept.read().count() == 20_000


@pytest.mark.parametrize("step", ["write", "commit", "fold_write", "fold_commit"])
def test_a_crash_at_any_step_loses_nothing(spark, tmp_path, step, monkeypatch):
    all_ = batches(11, n=4)
    kept = ChangeTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], RULES, ranges=2, fan=2)
    frames = [spark.createDataFrame(b, SCHEMA + ", ord int") for b in all_]
    kept.append(frames[0], 0, F.col("ord"))
    # The second batch fills level 0 and so folds: two writes, two commits.
    at = {"write": ("_write", 1), "commit": ("_put", 1), "fold_write": ("_write", 2), "fold_commit": ("_put", 2)}[step]
    calls = []
    owner = ChangeTable if at[0] == "_write" else change_table
    real = getattr(owner, at[0])

    def broken(*args, **more):
        calls.append(1)
        if len(calls) == at[1]:
            raise OSError("crash")
        return real(*args, **more)

    with monkeypatch.context() as m, pytest.raises(OSError, match="crash"):
        m.setattr(owner, at[0], broken)
        kept.append(frames[1], 1, F.col("ord"))
    there = step.startswith("fold")
    again = ChangeTable.open(spark, str(tmp_path / "t"))
    assert rows_of(again.read()) == expected(all_[: 1 + there])
    assert again.append(frames[1], 1, F.col("ord")) is not there
    for n in (2, 3):
        again.append(frames[n], n, F.col("ord"))
    assert rows_of(again.read()) == expected(all_)
    runs = {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("run-")}
    assert {r["path"] for r in again.runs()} <= runs and len(runs) <= 2 * len(again.runs()) + 2


def test_upserts_equal_the_rewriting_operator(spark, tmp_path):
    now = lambda n: F.lit(f"2024-01-0{n + 1}").cast("timestamp")
    schema = "id long, name string, stage string, notes string, run_ids array<string>, first_seen timestamp, last_seen timestamp"
    rng, current = random.Random(5), spark.createDataFrame([], schema)
    kept = ChangeTable(spark, str(tmp_path / "t"), schema, ["id"], R.UPSERT, ranges=2, fan=2)
    for n in range(3):
        rows = [(rng.randrange(6), rng.choice(["a", "b", None]), rng.choice(["", "won", None]), i) for i in range(8)]
        batch = spark.createDataFrame(rows, "id long, name string, stage string, ord int")
        kept.append(R.upsert_changes(batch, key="id", run_id=f"r{n}", now=now(n)), n)
        current = O.upsert(current, batch, key="id", run_id=f"r{n}", now=now(n)).drop("change").localCheckpoint()
    cols = ["id", "name", "stage", "run_ids", "first_seen", "last_seen"]
    plain = lambda df: sorted(tuple(r) for r in df.select(cols).collect())
    assert plain(kept.read()) == plain(current)


def records(n, seed):
    rng = random.Random(seed)
    rows = [(i, [f"k{rng.randrange(n)}" for _ in range(rng.choice([0, 1, 1, 2]))] + rng.choice([[], [None], [""]])) for i in rng.sample(range(10 * n), n)]
    return rows + [(rows[0][0], ["late-key", rows[1][1][0] if rows[1][1] else None])]


def test_linkage_by_batches_equals_one_run(spark, tmp_path):
    rows = records(40, 3)
    # A chain whose entities merge again and again, into ever smaller names.
    rows += [(900 - i, [f"c{i}", f"c{i + 1}"]) for i in range(6)]
    random.Random(0).shuffle(rows)
    kinds = "id long, keys array<string>"
    linkage = Linkage(spark, str(tmp_path / "l"), ranges=4, fan=3)
    for n in range(3):
        batch = spark.createDataFrame(rows[n::3] + [(None, ["c0"])], kinds)
        linkage.add(batch, n)
        if n == 1:
            linkage.add(batch, n)
    found = {r["id"]: r["entity"] for r in linkage.entities().collect()}
    whole = O.link_records(spark.createDataFrame(rows, kinds), "id", "keys")
    assert found == {r["id"]: r["entity"] for r in whole.collect()}
    assert found[900] == found[895] == 895


def test_a_broken_off_batch_can_be_given_again(spark, tmp_path, monkeypatch):
    kinds = "id long, keys array<string>"
    first, second = [(5, ["a"]), (6, ["b"]), (9, ["z"])], [(3, ["b", "a"]), (8, ["z", "new"]), (2, [])]
    for broken_at in ("merged",):
        linkage = Linkage(spark, str(tmp_path / broken_at), ranges=2)
        linkage.add(spark.createDataFrame(first, kinds), 0)

        def crash(*_, **__):
            raise OSError("crash")

        with monkeypatch.context() as m, pytest.raises(OSError, match="crash"):
            m.setattr(getattr(linkage, broken_at), "append", crash)
            linkage.add(spark.createDataFrame(second, kinds), 1)
        again = Linkage(spark, str(tmp_path / broken_at), ranges=2)
        again.add(spark.createDataFrame(second, kinds), 1)
        again.add(spark.createDataFrame([(1, ["new"])], kinds), 2)
        assert {r["id"]: r["entity"] for r in again.entities().collect()} == {5: 3, 6: 3, 3: 3, 9: 1, 8: 1, 1: 1, 2: 2}
