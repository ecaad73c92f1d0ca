"""Table operators: gates, selection, deduplication, linkage, upsert, roll-ups. All lazy DataFrame plans.

`ord` names the column that fixes the order of arrival; it is every operator's last key, so results don't depend on
how rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import normalize_space
from tamis.operators.components import components, shuffled, stored

# --- gates ------------------------------------------------------------------------------------------------------------


def with_reasons(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reasons") -> DataFrame:
    """FLT-11, FLT-12: every reason that holds, in the rules' order."""
    return df.withColumn(name, F.array_distinct(F.array_compact(F.array(*(F.when(c, label) for label, c in rules)))))


def with_first_reason(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """FLT-13..15: the first reason that holds, null without any."""
    return df.withColumn(name, F.coalesce(*(F.when(c, F.lit(label)) for label, c in rules)))


def split(df: DataFrame, rejected: Column) -> tuple[DataFrame, DataFrame]:
    """UPS-4: (kept, archived); a null verdict keeps."""
    gone = F.coalesce(rejected, F.lit(False))
    return df.filter(~gone), df.filter(gone)


def search(df: DataFrame, q: str, columns: list[str]) -> DataFrame:
    """FLT-1: rows whose columns, joined with blanks, hold the text, whatever the case."""
    q = q.strip().lower()
    return df.filter(F.lower(F.concat_ws(" ", *columns)).contains(q)) if q else df


# --- order and selection ----------------------------------------------------------------------------------------------


def first_per(df: DataFrame, key: Column | str, order: list[Column]) -> DataFrame:
    """WIN-5, DED-1..3, AGG-12: the first row of each key in the order; a null key is a key."""
    key = F.col(key) if isinstance(key, str) else key
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def page(df: DataFrame, order: list[Column], limit: int = 180, offset: int = 0, most: int = 500) -> DataFrame:
    """SRT-8: a page of the sorted rows; limits are held in their range."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, min(most, limit)))


def quota(rest: int, of_class: int, share: float, least: int) -> int:
    """WIN-3: how many of a class may stay beside `rest` others."""
    if not rest or not of_class:
        return of_class
    return min(of_class, max(least, math.ceil(rest * share / max(0.01, 1 - share))))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """The place of every row in the order, from 1, without a task that sees all rows: rows are range partitioned and sorted,
    numbered within their partition and stored, and each partition's count (one number each) gives the next its start.
    Give a total order, so that ranks don't depend on how rows are dealt out."""
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ordered.withColumn("_uid", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_uid", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_p long, _b long")
    return rows.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(name, F.col("_b") + F.col("_uid").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_b", "_uid")


#: Rows that one task may hold in order.
TOP = 50_000


def limit_share(df: DataFrame, in_class: Column, order: list[Column], share: float, least: int, most_at_once: int = TOP) -> DataFrame:
    """WIN-3: the first rows of a class up to its quota, and all others.

    The quota is made of two counts. Up to TOP rows are taken by each task's first ones, merged, so that no other row is
    shuffled; a larger quota needs the class's ranks. Both keep the same rows.
    """
    n = df.agg(F.count_if(in_class).alias("c"), F.count_if(~in_class).alias("r")).first()
    allowed = quota(n["r"], n["c"], share, least)
    if allowed >= n["c"]:
        return df
    own = df.filter(in_class)
    kept = own.orderBy(*order).limit(allowed) if allowed <= most_at_once else ranked(own, order, "_rank").filter(F.col("_rank") <= allowed).drop("_rank")
    return df.filter(~in_class).unionByName(kept)


def round_robin(df: DataFrame, bucket: str, bucket_rank: Column, order: list[Column], *, offset: int = 0, limit: int | None = None) -> DataFrame:
    """WIN-1, WIN-2: one row of each bucket in turn; each bucket starts `offset` rows in, around its end.

    Keys must be distinct beforehand. Adds `turn`. With a limit, no bucket needs more than its first offset + limit rows,
    which are cut off before they are shuffled; without one, places in the buckets come from `ranked`. A null bucket is one.
    """
    sizes = df.groupBy(F.col(bucket).alias("_bucket")).agg(F.count("*").alias("_n"))
    if limit is not None:
        at = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
        placed = df.withColumn("_rn", at).filter(F.col("_rn") <= offset + limit).withColumn("_at", F.col("_rn") - 1).drop("_rn")
    else:
        starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy(F.asc_nulls_first("_bucket"))) - F.col("_n")).select("_bucket", "_start")
        placed = ranked(df, [F.asc_nulls_first(bucket), *order], "_rank").join(F.broadcast(starts), F.col(bucket).eqNullSafe(F.col("_bucket"))).withColumn("_at", F.col("_rank") - 1 - F.col("_start")).drop("_rank", "_bucket", "_start")
    out = placed.join(F.broadcast(sizes), F.col(bucket).eqNullSafe(F.col("_bucket"))).withColumn("turn", F.pmod(F.col("_at") - offset, F.col("_n")))
    out = out.withColumn("_rank", bucket_rank).orderBy("turn", "_rank", bucket)
    return (out.limit(limit) if limit is not None else out).drop("_n", "_at", "_rank", "_bucket")


def diversify(df: DataFrame, platform: str, platform_rank: Column, order: list[Column], limit: int, cap: Column | None = None) -> DataFrame:
    """WIN-4: platforms take turns up to a cap each, then what is left follows in its order. No platform needs more than its
    first `limit` rows, which are cut off before they are shuffled."""
    cap = cap if cap is not None else F.lit(max(2, math.ceil(limit / 3)))
    rn = F.row_number().over(Window.partitionBy(platform).orderBy(*order))
    out = df.withColumn("_rn", rn).filter(F.col("_rn") <= limit).withColumn("_rank", platform_rank).withColumn("_late", (F.col("_rn") > cap).cast("int"))
    out = out.orderBy("_late", F.when(F.col("_late") == 0, F.col("_rn")), F.when(F.col("_late") == 0, F.col("_rank")), *order)
    return out.limit(limit).drop("_rn", "_rank", "_late")


def newest(df: DataFrame, partition: list[str], at: list[Column], most: int) -> DataFrame:
    """WIN-7: the newest `most` rows of each history."""
    rn = F.row_number().over(Window.partitionBy(*partition).orderBy(*at))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= most).drop("_rn")


def prune(df: DataFrame, doomed: Column, order: list[Column], most: int, key: str = "id") -> DataFrame:
    """WIN-8: rows without the first `most` doomed ones, by their key."""
    gone = df.filter(F.coalesce(doomed, F.lit(False))).orderBy(*order).limit(most).select(key)
    return df.join(gone, key, "left_anti")


def dead_letters(failed: DataFrame, key: list[str], error: Column, most: int = 8) -> DataFrame:
    """STM-8, SUP-9: failed attempts -> a row per piece of work with its number of attempts, its largest error as `last` and
    whether it failed `most` times and is given up (`dead`)."""
    out = failed.groupBy(*key).agg(F.count("*").alias("attempts"), F.max(error).alias("last"))
    return out.withColumn("dead", F.col("attempts") >= most)


def interleave(families: DataFrame, family: str, text: str, family_rank: Column, regions: list[str]) -> DataFrame:
    """WIN-6, JOIN-6: templates by index, families in turn, the shorter ones repeated; {region} is filled once, by index."""
    at = F.row_number().over(Window.partitionBy(family).orderBy("ord")) - 1
    numbered = families.withColumns({"_i": at, "_rank": family_rank})
    sizes = numbered.groupBy(family).agg(F.count("*").alias("_n"))
    longest = sizes.agg(F.max("_n")).first()[0] or 0
    spread = numbered.join(sizes, family).withColumn("idx", F.explode(F.filter(F.sequence(F.lit(0), F.lit(max(0, longest - 1))), lambda k: F.pmod(k, F.col("_n")) == F.col("_i"))))
    region = F.get(F.array(*map(F.lit, regions)), F.pmod("idx", F.lit(len(regions))).cast("int"))
    filled = F.when(F.instr(text, "{region}") > 0, F.concat(F.substring_index(text, "{region}", 1), region, F.expr(f"substring({text}, instr({text}, '{{region}}') + 8)"))).otherwise(F.col(text))
    return spread.select("idx", "_rank", family, filled.alias("query")).orderBy("idx", "_rank")


# --- joins ------------------------------------------------------------------------------------------------------------


def suffix_join(df: DataFrame, domain: str, hosts: DataFrame, how: str = "left_semi") -> DataFrame:
    """JOIN-4: rows whose domain is, or is below, a host of the table (`host`), or (left_anti) isn't; an equality join."""
    from tamis.functions.urls import domain_suffixes

    domains = df.select(F.col(domain).alias("_d")).distinct()
    met = domains.withColumn("host", F.explode(domain_suffixes("_d"))).join(hosts.select("host").distinct(), "host", "left_semi").select(F.col("_d").alias(domain)).distinct()
    return df.join(met, domain, how)


def overlay(current: DataFrame, restored: DataFrame, key: str) -> DataFrame:
    """JOIN-8, UPS-6: restored rows replace those of the same key."""
    both = current.withColumn("_p", F.lit(1)).unionByName(restored.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    return first_per(both, key, [F.col("_p")]).drop("_p")


def link_records(df: DataFrame, id_: str, keys: str) -> DataFrame:
    """DED-6, JOIN-7: id -> entity: the least id among all that shared keys connect. Every key ties its rows to the least
    of them, so rows and not pairs go through the shuffle; entities are connected components of the ties."""
    rows = df.select(F.col(id_).alias("b"), F.explode(keys).alias("k")).filter("k is not null and k != ''")
    heads = rows.groupBy("k").agg(F.min("b").alias("a"))
    found = components(rows.join(shuffled(heads), "k").select("a", "b"))
    return df.select(F.col(id_)).distinct().join(shuffled(found), F.col(id_) == F.col("node"), "left").select(id_, F.coalesce("component", id_).alias("entity"))


# --- merging ----------------------------------------------------------------------------------------------------------


def merge_entities(df: DataFrame, key: str, order: list[Column], *, best: list[str], by: str, union: list[str] = (), most: list[str] = (), first_seen: str | None = None, last_seen: str | None = None) -> DataFrame:
    """DED-4, AGG-13: a row per key: `best` columns from the row of the highest `by` (the first on ties), `union` arrays
    merged without repeats, the largest of `most`, the earliest and latest sighting, and the number of rows."""
    rank = F.struct(F.coalesce(F.col(by), F.lit(0)).alias("s"), (-F.col("_ord")).alias("o"))
    numbered = df.withColumn("_ord", order[0])
    aggs = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in best]
    aggs += [F.max(c).alias(c) for c in most]
    aggs += [F.min(first_seen).alias(first_seen)] if first_seen else []
    aggs += [F.max(last_seen).alias(last_seen)] if last_seen else []
    out = numbered.groupBy(key).agg(*aggs, F.count("*").alias("n_rows"))
    # Values are made distinct before they meet, so that an entity of very many rows holds its distinct values only.
    for c in union:
        values = df.select(F.col(key).alias("_key"), F.explode(c).alias("_v")).distinct().groupBy("_key").agg(F.array_sort(F.collect_list("_v")).alias(c))
        empty = F.array().cast(df.schema[c].dataType)
        out = out.join(values, out[key].eqNullSafe(values["_key"]), "left").drop("_key").withColumn(c, F.coalesce(c, empty))
    return out


def merge_enrichment(base: DataFrame, found: DataFrame, key: str, *, arrays: dict[str, Callable[[Column], Column]], reset: Column, text: str = "snippet", most: int = 1400) -> DataFrame:
    """ARR-11, SUP-10: what an enrichment found is added to a record: of each array the record's values and the new ones,
    cleaned anew by its function; a record of a platform's profile (`reset`) drops its own values first. Texts are joined
    and cut at `most`; other columns of `found` win where they aren't null. A record that wasn't enriched stays."""
    b = base.withColumn("_reset", F.coalesce(reset, F.lit(False))).alias("b")
    f = found.withColumn("_found", F.lit(True)).alias("f")
    met = b.join(f, F.col(f"b.{key}") == F.col(f"f.{key}"), "left")
    there = F.col("f._found")

    def of(c: str) -> Column:
        if c in arrays:
            empty = F.array().cast(base.schema[c].dataType)
            own = F.when(F.col("b._reset"), empty).otherwise(F.coalesce(F.col(f"b.{c}"), empty))
            return F.when(there, arrays[c](F.concat(own, F.coalesce(F.col(f"f.{c}"), empty)))).otherwise(F.col(f"b.{c}"))
        if c == text and c in found.columns:
            return F.when(there, F.substring(normalize_space(F.concat_ws(" ", f"b.{c}", f"f.{c}")), 1, most)).otherwise(F.col(f"b.{c}"))
        return F.coalesce(F.col(f"f.{c}"), F.col(f"b.{c}")) if c in found.columns and c != key else F.col(f"b.{c}")

    return met.select(*(of(c).alias(c) for c in base.columns), *(F.col(f"f.{c}") for c in found.columns if c not in base.columns))


def upsert(current: DataFrame, incoming: DataFrame, *, key: str, run_id: str | None, now: Column, ord_: str = "ord") -> DataFrame:
    """UPS-1: incoming rows update or insert by key. Kept from the current row: stage, notes, first_seen; run ids are
    added; last_seen is now; other columns are the incoming ones where they aren't null. Several incoming rows of a key
    are folded first, in order, later values over earlier ones. Adds `change`: created, updated or kept."""
    own = [c for c in current.columns if c not in (key, "stage", "notes", "run_ids", "first_seen", "last_seen")]
    folds = {c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(ord_))).alias(c) for c in incoming.columns if c not in (key, ord_)}
    batch = incoming.groupBy(key).agg(*folds.values())
    c, i = current.alias("c"), batch.alias("i")
    met = c.join(i, F.col(f"c.{key}").eqNullSafe(F.col(f"i.{key}")), "full_outer")
    # A key is never null in a row that exists, but stages may be; `change` tells which side there is.
    has_c, has_i = F.col(f"c.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()
    pick = lambda col: F.col(f"i.{col}") if col in batch.columns else F.lit(None)
    full = lambda col: F.when(col != "", col)
    run = F.array_compact(F.array(F.lit(run_id))) if run_id else F.array().cast("array<string>")
    return met.select(
        F.coalesce(f"c.{key}", f"i.{key}").alias(key),
        *(F.coalesce(pick(x), F.col(f"c.{x}")).alias(x) for x in own),
        F.coalesce(full(F.col("c.stage")), full(pick("stage")), F.lit("new")).alias("stage"),
        F.coalesce(F.when(has_c, F.col("c.notes")), F.lit("")).alias("notes"),
        F.when(has_c & has_i, F.array_distinct(F.concat(F.coalesce(F.col("c.run_ids"), F.array().cast("array<string>")), run))).when(has_i, run).otherwise(F.col("c.run_ids")).alias("run_ids"),
        F.coalesce(F.col("c.first_seen"), pick("first_seen"), F.when(has_i, now)).alias("first_seen"),
        F.when(has_i, now).otherwise(F.col("c.last_seen")).alias("last_seen"),
        F.when(has_c & has_i, "updated").when(has_i, "created").otherwise("kept").alias("change"),
    )


def patch(current: DataFrame, patches: DataFrame, key: str, now: Column) -> DataFrame:
    """UPS-2: columns of the patch over the row of the same key, and the time of it."""
    p = patches.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in patches.columns if c != key), F.lit(True).alias("_hit"))
    met = current.join(p, key, "left")
    return met.select(*(F.coalesce(f"_{c}", c).alias(c) if c in patches.columns and c != key else F.col(c) for c in current.columns), F.when(F.col("_hit"), now).alias("updated_at"))


def renamed(df: DataFrame, names: dict[str, str | list[str]], defaults: dict[str, str] | None = None) -> DataFrame:
    """PRJ-7, PRJ-8, PRJ-12: columns under new names: one column as it is, or the first of several that isn't blank, trimmed,
    with a default text where all are."""
    defaults = defaults or {}

    def of(new: str, old: str | list[str]) -> Column:
        if isinstance(old, str):
            return F.col(old).alias(new)
        texts = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in old]
        return F.coalesce(*texts, *([F.lit(defaults[new])] if new in defaults else [])).alias(new)

    return df.select(*(of(new, old) for new, old in names.items()))


# --- roll-ups ---------------------------------------------------------------------------------------------------------


def count_by(df: DataFrame, key: Column, default: str = "unknown", name: str = "key") -> DataFrame:
    """AGG-1: rows per key; null and empty keys are the default."""
    return df.groupBy(F.coalesce(F.when(key.cast("string") != "", key.cast("string")), F.lit(default)).alias(name)).agg(F.count("*").alias("n"))


def facets(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """AGG-4: (facet, value, n) of several columns (name: default) in one pass and one shuffle."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.coalesce(F.when(F.col(c) != "", F.col(c).cast("string")), F.lit(d)).alias("value")) for c, d in columns.items()))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """AGG-5: rows in each category; categories may overlap."""
    counted = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in categories.items()))
    return counted.unpivot([], list(categories), "category", "n")


def duplicate_stats(df: DataFrame, key: Column) -> DataFrame:
    """AGG-10: rows, distinct keys and the difference."""
    return df.select(key.alias("k")).agg(F.count("k").alias("total"), F.countDistinct("k").alias("distinct_keys"), (F.count("k") - F.countDistinct("k")).alias("duplicates"))


def duplicate_groups(df: DataFrame, key: str, show: str, order: str, sample: int = 5) -> DataFrame:
    """AGG-11: keys of several rows with the first few of them; the first are picked before they are collected."""
    w = Window.partitionBy(key)
    few = df.withColumns({"_rn": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)}).filter(f"_n > 1 and _rn <= {sample}")
    return few.groupBy(key).agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_rn", show))), lambda x: x[show]).alias("sample"))


def percent(part: Column, whole: Column) -> Column:
    """AGG-8: one decimal, 0 for nothing."""
    return F.when(whole > 0, F.floor(1000.0 * part / whole + 0.5) / 10).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    """AGG-8: three decimals, null for nothing."""
    return F.when(whole > 0, F.floor(1000.0 * part / whole + 0.5) / 1000)


def due_reason(now: Column, last: Column, contactless: Column, hot: Column, complete: Column, ttl_hours: tuple[int, int, int] = (24, 72, 336)) -> Column:
    """SUP-7, STM-4: why a record's work is due: never, contactless, scheduled; null if it isn't."""
    age = (F.unix_micros(now) - F.unix_micros(last)) / 3.6e9
    ttl = F.when(complete < 35, ttl_hours[0]).when(hot, ttl_hours[1]).otherwise(ttl_hours[2])
    return F.when(last.isNull(), "never").when(age >= ttl, F.when(contactless, "contactless").otherwise("scheduled"))
