"""The leased queue: its rules step by step, and the stream against a batch replay, with restarts and disorder."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from tamis.streaming.work_queue import HOUR, OUT, Rules, Work, newest_state, replay, replay_batch, work_queue

RULES = Rules(lease=10, refresh=100, forget=1000, most=2)


def steps(messages, horizon, rules=RULES):
    w = Work()
    return [(r[0], r[2], r[3], r[4]) for r in replay(w, [(at, n, kind, worker) for n, (at, kind, worker) in enumerate(messages)], horizon, rules)], w


def test_done_work_is_due_again():
    found, w = steps([(0, "take", "a"), (5, "take", "b"), (6, "done", "b"), (7, "done", "a"), (50, "take", "b"), (107, "take", "b"), (110, "done", "b")], 150)
    assert found == [
        (0, "take", "granted", "running"), (5, "take", "busy", "running"), (6, "done", "ignored", "running"), (7, "done", "ok", "done"), (50, "take", "not_due", "done"),
        (107, "due", "deadline", "free"), (107, "take", "granted", "running"), (110, "done", "ok", "done"),
    ]
    assert w == Work("done", None, 210, 1, 0)


def test_leases_expire_and_work_that_fails_too_often_is_closed():
    found, w = steps([(0, "take", "a"), (10, "done", "a"), (12, "take", "b"), (13, "error", "b"), (14, "take", "a"), (2000, "take", "a")], 2005)
    assert found == [
        (0, "take", "granted", "running"), (10, "expired", "deadline", "free"), (10, "done", "ignored", "free"), (12, "take", "granted", "running"), (13, "error", "ok", "dead"),
        (14, "take", "closed", "dead"), (1013, "forgotten", "deadline", "new"), (2000, "take", "granted", "running"),
    ]
    assert w == Work("running", "a", 2010, 1, 0)
    found, w = steps([(0, "take", "a"), (20, "take", "b"), (21, "odd", "b"), (22, None, "b")], 40)
    assert [f[1:] for f in found] == [("take", "granted", "running"), ("expired", "deadline", "free"), ("take", "granted", "running"), ("odd", "ignored", "running"), (None, "ignored", "running"), ("expired", "deadline", "dead")]
    found, w = steps([(0, "take", "a"), (1, "reject", "a"), (2, "take", "b")], 5000)
    assert found[1:] == [(1, "reject", "ok", "rejected"), (2, "take", "closed", "rejected"), (1001, "forgotten", "deadline", "new")] and w == Work()


def messages(n, keys, seed):
    rng, at = random.Random(seed), 1_700_000_000_000
    out = []
    for i in range(n):
        at += rng.randrange(0, 4 * HOUR) // 4
        out.append((f"k{rng.randrange(keys)}", at // 1000 * 1000, i, rng.choice(["take", "take", "take", "done", "error", "reject"]), rng.choice("ab")))
    return out


def test_stream_over_restarts_equals_a_replay(spark, tmp_path):
    """Three runs from one checkpoint, with messages out of order within the watermark's delay."""
    rules = Rules(lease=10 * HOUR, refresh=6 * HOUR, forget=20 * HOUR, most=2)
    rows = messages(400, 12, 3) + [(None, 1_700_000_000_000, 900, "take", "a")]
    schema, late = "k string, ms long, seq long, kind string, worker string", 3 * HOUR
    rng = random.Random(9)
    # What comes later is at most two hours older than the newest before it.
    mixed = sorted(rows, key=lambda m: m[1] + rng.randrange(2 * HOUR))
    told = (str(tmp_path / x) for x in ("in", "out", "marks"))
    source, out, marks = told
    for part in range(3):
        some = mixed[part * 140 : (part + 1) * 140] if part < 2 else mixed[280:]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        moves = work_queue(stream, key=F.col("k"), at=F.timestamp_millis("ms"), seq=F.col("seq"), kind=F.col("kind"), worker=F.col("worker"), rules=rules, late=timedelta(milliseconds=late))
        moves.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(OUT).parquet(out)
    table = spark.createDataFrame([m for m in rows if m[0]], "key string, at long, seq long, kind string, worker string")
    horizon = max(m[1] for m in rows) - late
    expected = replay_batch(table, horizon, rules)
    key = lambda r: tuple((v is None, v) for v in r)
    got, want = (sorted((tuple(r) for r in df.collect()), key=key) for df in (found, expected))
    assert got == want
    assert {r[3] for r in got} == {"take", "done", "error", "reject", "expired", "due", "forgotten"} and {r[4] for r in got} == {"granted", "busy", "not_due", "closed", "ok", "ignored", "deadline"}
    last = {r["key"]: r for r in newest_state(found).collect()}
    for k in {m[0] for m in rows if m[0]}:
        own = [r for r in want if r[0] == k]
        newest = max(own, key=lambda r: (r[1], -1 if r[2] is None else r[2]))
        assert (last[k]["at_ms"], last[k]["status"]) == (newest[1], newest[5])


def test_state_grows_with_buckets_not_with_pieces_of_work(spark, tmp_path):
    """300 pieces of work in two buckets: odd names and kinds, more moves than leave Python at once, a late message between others."""
    rules = Rules(lease=10 * HOUR, refresh=6 * HOUR, forget=20 * HOUR, most=2)
    rows = [(f'{k}", \\\n[é', *r) for k, *r in messages(24_000, 300, 5)]
    rows += [(rows[0][0], rows[-200][1], 90_000, None, None), (rows[1][0], rows[-200][1], 90_001, '"odd", []', "a")]
    schema, late = "k string, ms long, seq long, kind string, worker string", 3 * HOUR
    told = (str(tmp_path / x) for x in ("in", "out", "marks"))
    source, out, marks = told
    progress = []
    for some in (rows[:23_500], rows[23_500:] + [(rows[0][0], rows[5][1], 90_002, "take", "b")]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        moves = work_queue(stream, key=F.col("k"), at=F.timestamp_millis("ms"), seq=F.col("seq"), kind=F.col("kind"), worker=F.col("worker"), rules=rules, late=timedelta(milliseconds=late), buckets=2)
        query = moves.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
        progress += query.recentProgress
    table = spark.createDataFrame(rows, "key string, at long, seq long, kind string, worker string")
    expected = replay_batch(table, max(m[1] for m in rows) - late, rules)
    key = lambda r: tuple((v is None, v) for v in r)
    got, want = (sorted((tuple(r) for r in df.collect()), key=key) for df in (spark.read.schema(OUT).parquet(out), expected))
    assert len(got) > 24_000 and got == want and {None, '"odd", []'} < {r[3] for r in got}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 8


def test_a_deadline_comes_where_no_message_waits(spark, tmp_path):
    """A bucket with work but no messages, then one with neither; what is forgotten leaves the state."""
    rules, t = Rules(lease=10 * HOUR, refresh=6 * HOUR, forget=20 * HOUR, most=2), 1_700_000_000_000
    schema = "k string, ms long, seq long, kind string, worker string"
    told = (str(tmp_path / x) for x in ("in", "out", "marks"))
    source, out, marks = told
    batches = [[("a", t, 1, "take", "x"), ("b", t + 5 * HOUR, 2, "take", "x")], [("b", t + 24 * HOUR, 3, "take", "x")], [("b", t + 90 * HOUR, 4, "take", "x")]]
    for some in batches:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        moves = work_queue(stream, key=F.col("k"), at=F.timestamp_millis("ms"), seq=F.col("seq"), kind=F.col("kind"), worker=F.col("worker"), rules=rules)
        query = moves.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r["at_ms"] - t) // HOUR: (r["event"], r["status"]) for r in spark.read.schema(OUT).parquet(out).collect() if r["key"] == "a"}
    assert got == {0: ("take", "running"), 10: ("expired", "free"), 30: ("forgotten", "new")}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # b's last message
