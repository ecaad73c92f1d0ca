"""Keyed tables that take a batch for the price of the batch: runs of changes, a reader that merges them, levels that fold.

A batch becomes one run: a row for each of its keys, in folders by key range (ranges of the key's hash). Runs are never
rewritten in place. What a key's row is follows from its changes by each column's rule, in the order of runs; the rules
are such that neighbouring runs can be folded into one beforehand. When a level has `fan` runs they become one of the
next level, so a row is rewritten once a level, and a reader meets at most `fan` runs a level.

The list of runs is a small file, written aside and renamed to its number; the one of the greatest number holds. A run
counts once a list names it: a crash before that leaves the former state, and the batch can be given again. Batches have
growing numbers, and one whose number is not above the last one's is passed over, so a stream's repeated batch changes
nothing. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tamis.sources.sinks import _hadoop

#: How a column's changes make its value: the last or first that isn't null, the distinct elements of all arrays in the order
#: in which they came, or the largest or smallest.
RULES = ("last", "first", "union", "max", "min")
#: Lists of runs that stay, for readers that have begun with a former one.
LISTS = 2


def _folded(rows: DataFrame, keys: list[str], place: Column, rules: dict[str, str]) -> DataFrame:
    """A row per key; `place` orders its changes. Elements of arrays are made distinct before they meet."""
    rows = rows.withColumn("_place", place)
    by = {
        "last": lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_place"))), "first": lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_place"))),
        "max": F.max, "min": F.min,
    }
    unions = [c for c, r in rules.items() if r == "union"]
    plain = [by[r](c).alias(c) for c, r in rules.items() if r != "union"]
    out = rows.groupBy(*keys).agg(*(plain or [F.first(F.lit(1)).alias("_one")])).drop("_one")
    for c in unions:
        each = rows.filter(F.col(c).isNotNull()).select(*keys, "_place", F.posexplode(c).alias("_pos", "_v"))
        each = each.groupBy(*keys, "_v").agg(F.min(F.struct("_place", "_pos")).alias("_at"))
        lists = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_l")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_l._v").alias(c))
        met = [out[k].eqNullSafe(lists[f"_k{i}"]) for i, k in enumerate(keys)]
        out = out.join(lists, reduce(Column.__and__, met), "left").drop(*(f"_k{i}" for i in range(len(keys))))
    return out.select(*keys, *rules)


def _lists(spark: SparkSession, path: str) -> list[str]:
    """The lists of runs of a table, oldest first."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at(f"{path}/list")):
        return []
    return sorted(f"{path}/list/{n}" for n in (f.getPath().getName() for f in fs.listStatus(at(f"{path}/list"))) if n.endswith(".json"))


def _read(spark: SparkSession, path: str) -> str:
    fs, at = _hadoop(spark, path)
    stream = fs.open(at(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A whole file or none: written aside, then renamed."""
    fs, at = _hadoop(spark, path)
    stream = fs.create(at(f"{path}.tmp"), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(at(f"{path}.tmp"), at(path)):
        raise OSError(f"{path} could not be committed")


class ChangeTable:
    """`keys` name a row; other columns of `schema` have a rule each (`last` where none is given). Rows lie in `ranges` folders
    by the hash of `spread`, the first key unless other key columns are named; `lookup` reads those it needs."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], rules: dict[str, str] | None = None, *, spread: list[str] | None = None, ranges: int = 64, fan: int = 8):
        self.spark, self.path, self.keys, self.ranges, self.fan = spark, path.rstrip("/"), keys, ranges, fan
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.spread = spread or keys[:1]
        given = rules or {}
        self.rules = {f.name: given.get(f.name, "last") for f in self.schema if f.name not in keys}
        if bad := [r for r in self.rules.values() if r not in RULES]:
            raise ValueError(f"unknown rules: {bad}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ChangeTable | None:
        """The table as it was defined by its writer; null where there is none."""
        path = path.rstrip("/")
        found = _lists(spark, path)
        if not found:
            return None
        d = json.loads(_read(spark, found[-1]))["table"]
        return cls(spark, path, StructType.fromJson(d["schema"]), d["keys"], d["rules"], spread=d["spread"], ranges=d["ranges"], fan=d["fan"])

    def _state(self) -> dict:
        found = _lists(self.spark, self.path)
        return json.loads(_read(self.spark, found[-1])) if found else {"upto": -1, "runs": []}

    def runs(self) -> list[dict]:
        """The committed runs, oldest first: level, seq and path."""
        return self._state()["runs"]

    def upto(self) -> int:
        """The number of the last batch; -1 before the first."""
        return self._state()["upto"]

    def _range_of(self, columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.ranges)).cast("int")

    def _write(self, folded: DataFrame) -> str | None:
        """The run's folder; null if there are no rows. Rows that have their range are dealt out by it already."""
        name = f"run-{uuid.uuid4().hex}"
        dealt = folded if "_range" in folded.columns else folded.select(*self.schema.fieldNames(), self._range_of(self.spread).alias("_range")).repartition("_range")
        dealt.write.partitionBy("_range").parquet(f"{self.path}/{name}")
        fs, at = _hadoop(self.spark, self.path)
        return name if any(f.isDirectory() for f in fs.listStatus(at(f"{self.path}/{name}"))) else None

    def _commit(self, upto: int, runs: list[dict]) -> None:
        table = {"schema": self.schema.jsonValue(), "keys": self.keys, "rules": self.rules, "spread": self.spread, "ranges": self.ranges, "fan": self.fan}
        old = _lists(self.spark, self.path)
        number = int(old[-1].rpartition("/")[2][:-5]) + 1 if old else 0
        _put(self.spark, f"{self.path}/list/{number:012d}.json", json.dumps({"upto": upto, "runs": runs, "table": table}))
        # Former lists, and runs that no list names any more: folded ones, and those of crashed writers.
        fs, at = _hadoop(self.spark, self.path)
        lists = _lists(self.spark, self.path)
        for path in lists[:-LISTS]:
            fs.delete(at(path), False)
        named = {r["path"] for path in lists[-LISTS:] for r in json.loads(_read(self.spark, path))["runs"]}
        for f in fs.listStatus(at(self.path)):
            if f.getPath().getName().startswith("run-") and f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)

    def append(self, changes: DataFrame, number: int, order: Column | None = None, single: bool = False) -> bool:
        """Adds a batch (columns that it lacks are null) as one run and folds levels that are full. Several changes of a key
        are folded first, the last that isn't null in `order` over the others; with `single` the caller sees to it that there is one row a
        key. False if the number was there already."""
        state = self._state()
        if number <= state["upto"]:
            return False
        lacking = {f.name: F.lit(None).cast(f.dataType) for f in self.schema if f.name not in changes.columns}
        whole = changes.withColumns({f.name: lacking.get(f.name, F.col(f.name).cast(f.dataType)) for f in self.schema})
        within = {c: r if r == "union" else "last" for c, r in self.rules.items()}
        plain = single and "union" not in self.rules.values()
        path = self._write(whole if plain else _folded(whole, self.keys, order if order is not None else F.lit(0), within))
        runs = state["runs"]
        if path:
            runs.append({"level": 0, "seq": max((r["seq"] for r in runs), default=-1) + 1, "path": path})
        self._commit(number, runs)
        self.fold()
        return True

    def fold(self, everything: bool = False) -> None:
        """Folds the runs of each level that has `fan` of them, or all runs into one. Runs of a level lie next to each other."""
        state = self._state()
        while runs := state["runs"]:
            level = min((r["level"] for r in runs if everything or sum(o["level"] == r["level"] for o in runs) >= self.fan), default=None)
            group = runs if everything else [r for r in runs if r["level"] == level]
            if level is None or len(group) < 2:
                return
            new = {"level": max(r["level"] for r in group) + 1, "seq": max(r["seq"] for r in group), "path": self._write(self._merged_by_range(group))}
            state["runs"] = sorted([*(r for r in runs if r not in group), new], key=lambda r: r["seq"])
            self._commit(state["upto"], state["runs"])

    def _rows(self, runs: list[dict], ranges: list[int] | None = None) -> DataFrame:
        there = StructType([*self.schema.fields, StructField("_range", IntegerType())])
        kept = [self.spark.read.schema(there).parquet(f"{self.path}/{r['path']}").withColumn("_seq", F.lit(r["seq"])) for r in runs]
        if not kept:
            return self.spark.createDataFrame([], there).withColumn("_seq", F.lit(0))
        return reduce(DataFrame.union, [k if ranges is None else k.filter(F.col("_range").isin(ranges)) for k in kept])

    def _merged(self, rows: DataFrame, runs: list[dict]) -> DataFrame:
        """Rows of one run have a key each, so nothing meets."""
        return rows if len(runs) == 1 else _folded(rows, self.keys, F.col("_seq"), self.rules)

    def _merged_by_range(self, runs: list[dict]) -> DataFrame:
        """The same with their ranges, by which they are shuffled once, as a run has a row a key and nothing to fold before."""
        return _folded(self._rows(runs).repartition("_range"), ["_range", *self.keys], F.col("_seq"), self.rules).select(*self.schema.fieldNames(), "_range")

    def read(self) -> DataFrame:
        """All rows as they are now."""
        runs = self.runs()
        return self._merged(self._rows(runs), runs).select(*self.schema.fieldNames())

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows whose `spread` columns have the values of a row of `wanted`; reads the ranges that those fall in."""
        sought = wanted.select(*self.spread).distinct()
        # At most `ranges` numbers.
        ranges = sorted(r[0] for r in sought.select(self._range_of(self.spread)).distinct().collect())
        runs = self.runs()
        rows = self._rows(runs, ranges).join(sought, self.spread, "left_semi")
        return self._merged(rows, runs).select(*self.schema.fieldNames())
