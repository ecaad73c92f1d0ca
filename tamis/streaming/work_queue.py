"""A queue of work with leases, as a stream: who may work on what, what became of it, and when it is due again.

Workers' messages come in as events of a piece of work: `take` asks for it, `done`, `reject` and `error` tell how it went.
A take is granted unless somebody holds the work, it isn't due yet or it is closed. A grant is a lease: without an answer
in time it expires and the work is free again, and a late answer, or one of a worker that doesn't hold it, is ignored. Done
work is due again after a while; rejected work, and work that was begun too often without success, is closed. What nobody
asks for any more is forgotten, so that state doesn't grow with all keys ever seen.

Pieces of work are kept in the state store by buckets of their key's hash, as what Python asks of the store and gives to
Spark costs far more than to follow a message. A bucket has event-time timers at the first message of each batch and at its
next deadline. Messages wait there until the watermark has passed them and are then followed in the order of their time and
number. So the result depends on the messages and the last watermark only: not on how they came, in which batches, or on
restarts.
`replay` is that order of things for one piece of work; it takes a message or a deadline a step.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import timedelta
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "key string, at_ms long, seq long, event string, outcome string, status string, attempts int, errors int"
NAMES = [c.split()[0] for c in OUT.split(", ")]
#: Rows leave Python as JSON, at most MOST_MOVES at once.
MOVES, MOST_MOVES = "array<struct<key:string,at_ms:long,seq:long,event:string,outcome:string,status:string,attempts:int,errors:int>>", 10_000


@dataclass(frozen=True)
class Rules:
    """Milliseconds of a lease, until done work is due again, and until idle work is forgotten; how often it may be begun."""

    lease: int = HOUR
    refresh: int = 6 * HOUR
    forget: int = 30 * 24 * HOUR
    most: int = 8


@dataclass
class Work:
    """status: new, running, free (its lease expired, or it is due again), done, error, rejected or dead; until: its deadline."""

    status: str = "new"
    worker: str | None = None
    until: int | None = None
    attempts: int = 0
    errors: int = 0


def _deadline(w: Work, rules: Rules) -> str:
    """What happens when `until` has come."""
    at = w.until
    if w.status == "running":
        w.status, w.worker, w.until = "dead" if w.attempts >= rules.most else "free", None, at + rules.forget
        return "expired"
    if w.status == "done":
        w.status, w.until, w.attempts, w.errors = "free", at + rules.forget, 0, 0
        return "due"
    w.status, w.worker, w.until, w.attempts, w.errors = "new", None, None, 0, 0
    return "forgotten"


def _message(w: Work, at: int, kind: str, worker: str | None, rules: Rules) -> str:
    if kind == "take":
        refused = {"running": "busy", "done": "not_due", "rejected": "closed", "dead": "closed"}.get(w.status)
        if refused:
            return refused
        w.status, w.worker, w.until, w.attempts = "running", worker, at + rules.lease, w.attempts + 1
        return "granted"
    if w.status != "running" or w.worker != worker or kind not in ("done", "reject", "error"):
        return "ignored"
    if kind == "error":
        w.errors += 1
    w.status = {"done": "done", "reject": "rejected", "error": "dead" if w.attempts >= rules.most else "error"}[kind]
    w.worker, w.until = None, at + (rules.refresh if kind == "done" else rules.forget)
    return "ok"


def replay(w: Work, messages: Iterable[tuple[int, int, str, str | None]], horizon: int, rules: Rules) -> Iterator[tuple]:
    """(at, seq, event, outcome, status, attempts, errors) of each message (at, seq, kind, worker), given in order, and of
    each deadline up to the horizon; `w` is left as it is then."""

    def deadlines(until: int) -> Iterator[tuple]:
        while w.until is not None and w.until <= until:
            at = w.until
            event = _deadline(w, rules)
            yield at, None, event, "deadline", w.status, w.attempts, w.errors

    for at, seq, kind, worker in messages:
        yield from deadlines(at)
        outcome = _message(w, at, kind, worker, rules)
        yield at, seq, kind, outcome, w.status, w.attempts, w.errors
    yield from deadlines(horizon)


class _Queue(StatefulProcessor):
    """The pieces of work of a bucket. A message is [key, at, seq, kind, worker] as JSON, with numbers as strings."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.followed = handle, set()
        #: {key: [status, worker, until, attempts, errors]} of all but new work, and blocks of messages joined by commas.
        self.works, self.waiting = handle.getValueState("works", "works string"), handle.getListState("waiting", "messages string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for part in rows:
            block = ",".join(part["message"])
            first.append(min(int(m[1]) for m in json.loads(f"[{block}]")))
            self.waiting.appendValue((block,))
        self.handle.registerTimer(min(first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.followed:  # by an earlier timer of this batch
            return
        self.followed.add(key)
        horizon, found = timerValues.getCurrentWatermarkInMs(), self.works.get()
        works = {k: Work(*w) for k, w in json.loads(found[0]).items()} if found else {}
        now, later = {k: [] for k, w in works.items() if w.until <= horizon}, []
        for (block,) in self.waiting.get():
            for m in json.loads(f"[{block}]"):
                at = int(m[1])
                if at <= horizon:
                    now.setdefault(m[0], []).append((at, m[2] if m[2] is None else int(m[2]), m[3], m[4]))
                else:
                    later.append((at, m))

        def moves() -> Iterator[dict]:
            for k, messages in now.items():
                w = works.setdefault(k, Work())
                for r in replay(w, sorted(messages, key=lambda m: m[:2]), horizon, self.rules):
                    yield dict(zip(NAMES, (k, *r)))
                if w.until is None:
                    del works[k]

        for part in batched(moves(), MOST_MOVES):
            yield pd.DataFrame({"moves": [json.dumps(part)]})
        if works:
            self.works.update((json.dumps({k: [w.status, w.worker, w.until, w.attempts, w.errors] for k, w in works.items()}),))
        elif found:
            self.works.clear()
        if later:
            self.waiting.put([(",".join(json.dumps(m) for _, m in later),)])
        else:
            self.waiting.clear()
        due = min([at for at, _ in later] + [w.until for w in works.values()], default=None)
        if due is not None:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def work_queue(messages: DataFrame, *, key: Column, at: Column, seq: Column, kind: Column, worker: Column, rules: Rules = Rules(), late: timedelta = timedelta(hours=1), buckets: int = 4096) -> DataFrame:
    """SUP-9, STM-4, STM-5: stream of messages -> stream of OUT, a row for each message and each deadline, once the watermark
    has passed it. Messages later than `late` are dropped. `at` (a time) and the deadlines are in milliseconds; `seq` orders
    messages of one time and should be distinct. The messages of one piece of work are followed one after the other, by
    one task, and those within `late` wait in its bucket's state. A batch reads and writes the whole state of a bucket in
    which something is due, so `buckets` should be some thousandth of the pieces of work that are remembered at a time; it
    can't change between runs from one checkpoint.

    The state store must be RocksDB's, which is set here for the session.
    """
    spark = messages.sparkSession
    spark.conf.set(*STORE)
    millis, name = F.unix_millis(at.cast("timestamp")), key.cast("string")
    # Python takes and gives few values, as each of them costs there, and every group.
    message = F.to_json(F.array(name, millis.cast("string"), seq.cast("long").cast("string"), kind.cast("string"), worker.cast("string")))
    named = messages.filter(name.isNotNull() & millis.isNotNull()).select(F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("bucket"), F.timestamp_millis(millis).alias("time"), message.alias("message"))
    timed = named.withWatermark("time", f"{int(late.total_seconds() * 1000)} milliseconds")
    moves = timed.groupBy("bucket").transformWithStateInPandas(_Queue(rules), "moves string", "Append", "EventTime")
    return moves.select(F.inline(F.from_json("moves", MOVES, {"mode": "FAILFAST"})))


def newest_state(transitions: DataFrame) -> DataFrame:
    """A row per piece of work: its last transition, with deadlines before messages of the same time."""
    place = F.struct("at_ms", F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"))
    return transitions.groupBy("key").agg(F.max_by(F.struct("at_ms", "event", "outcome", "status", "attempts", "errors"), place).alias("r")).select("key", "r.*")


def replay_batch(messages: DataFrame, horizon: int, rules: Rules = Rules()) -> DataFrame:
    """The same of a whole table (key, at, seq, kind, worker), times in milliseconds; messages after the horizon aren't there yet."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "seq"])
        rows = replay(Work(), zip(group["at"], group["seq"], group["kind"], group["worker"]), horizon, rules)
        return pd.DataFrame([(group["key"].iloc[0], *r) for r in rows], columns=NAMES).astype({"seq": "Int64"})

    return messages.filter(F.col("at") <= horizon).groupBy("key").applyInPandas(run, OUT)
