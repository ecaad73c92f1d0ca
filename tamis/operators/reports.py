"""Reports over small roll-ups: worker statistics, health issues, recommendations, source chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The counters that a worker reports for each source.
COUNTERS = ["searches", "raw", "qualified", "saved", "discarded", "duplicates", "errors", "provider_errors"]


def worker_summary(status: DataFrame, worker: str, stats: str) -> DataFrame:
    """AGG-7, AGG-16: status (worker, stats map<source, struct<counters>>) -> totals by worker, by source and over all in
    one pass, with yields per search; null is "all"."""
    rows = status.select(F.col(worker).alias("worker"), F.explode(stats).alias("source", "s"))
    present = [c for c in COUNTERS if c in rows.schema["s"].dataType.fieldNames()]
    out = rows.groupingSets([["worker"], ["source"], []], "worker", "source").agg(*(F.sum(F.coalesce(f"s.{c}", F.lit(0))).alias(c) for c in present))
    per = lambda c: F.when(F.col("searches") > 0, F.floor(100.0 * F.col(c) / F.col("searches") + 0.5) / 100).otherwise(0.0)
    return out.withColumns({f"{c}_per_search": per(c) for c in ("raw", "saved", "provider_errors") if c in present})


def reason_totals(status: DataFrame, stats: str) -> DataFrame:
    """AGG-7: the reasons' counts over all sources; stats is map<source, struct<reasons map<reason, n>>>."""
    rows = status.select(F.explode(stats).alias("source", "s")).select(F.explode("s.reasons").alias("reason", "k"))
    return rows.groupBy("reason").agg(F.sum("k").cast("long").alias("n"))


def issues(facts: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """CLS-17, CLS-18: a row (severity, code) for each rule that holds on the one row of facts."""
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for s, code, c in rules)))
    return facts.select(F.explode(found).alias("i")).select("i.severity", "i.code")


def source_chips(counts: DataFrame, fixed: list[str], top: int = 5) -> DataFrame:
    """SUP-32: counts (name, n): the fixed names that aren't zero, the first always, and the `top` others."""
    rank = F.array_position(F.array(*map(F.lit, fixed)), F.col("name"))
    first = counts.filter((rank == 1) | ((rank > 1) & (F.col("n") > 0))).withColumn("pos", rank.cast("int"))
    rest = counts.filter(rank == 0).orderBy(F.desc("n"), "name").limit(top).withColumn("pos", F.lit(len(fixed) + 1))
    return first.unionByName(rest)
