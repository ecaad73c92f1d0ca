"""Registered queries over streams and incremental tables, with SQL that replays them in one go."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.changes import change_feed, write_version
from tamis.operators.components import new_path, remove_path, stored
from tamis.operators.crawl import crawl_links
from tamis.operators.linkage import Linkage
from tamis.operators.search_index import SearchIndex
from tamis.operators.terms import find_terms
from tamis.plans.demo import table
from tamis.sources.change_table import ChangeTable
from tamis.sources.json_ranges import json_records
from tamis.streaming.work_queue import HOUR, OUT, Rules, work_queue

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def streamed(spark, d: str, name: str):
    """A table as a stream; a pattern, as the file source takes no single file by its name."""
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


LEASES = Rules(lease=12 * HOUR, refresh=24 * HOUR, forget=96 * HOUR, most=3)
LEASED_SQL = f"""
WITH RECURSIVE m AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS at_ms, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'done' WHEN 'purchase' THEN CASE WHEN value > 120 THEN 'reject' ELSE 'done' END ELSE 'take' END AS kind,
  CASE WHEN event_id % 5 = 0 THEN 'b' ELSE 'a' END AS worker FROM events),
h AS (SELECT max(at_ms) - {6 * HOUR} AS horizon FROM m),
e AS (SELECT m.*, row_number() OVER (PARTITION BY key ORDER BY at_ms, seq) AS n FROM m, h WHERE at_ms <= horizon),
-- One message or deadline a step: until is the deadline of the state, n the messages that were followed.
r(key, n, step, at_ms, seq, event, outcome, status, worker, until, attempts, errors) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', '', 'new', '', CAST(NULL AS BIGINT), 0, 0 FROM e
  UNION ALL
  SELECT key, CASE WHEN late THEN n ELSE n + 1 END, step + 1, CASE WHEN late THEN until ELSE m_at END, CASE WHEN late THEN NULL ELSE m_seq END,
    CASE WHEN NOT late THEN kind WHEN status = 'running' THEN 'expired' WHEN status = 'done' THEN 'due' ELSE 'forgotten' END,
    CASE WHEN late THEN 'deadline' WHEN kind = 'take' THEN CASE WHEN status = 'running' THEN 'busy' WHEN status = 'done' THEN 'not_due' WHEN status IN ('rejected', 'dead') THEN 'closed' ELSE 'granted' END WHEN held THEN 'ok' ELSE 'ignored' END,
    CASE WHEN late THEN CASE WHEN status = 'running' THEN CASE WHEN attempts >= {LEASES.most} THEN 'dead' ELSE 'free' END WHEN status = 'done' THEN 'free' ELSE 'new' END
      WHEN granted THEN 'running' WHEN held THEN CASE kind WHEN 'done' THEN 'done' WHEN 'reject' THEN 'rejected' ELSE CASE WHEN attempts >= {LEASES.most} THEN 'dead' ELSE 'error' END END ELSE status END,
    CASE WHEN granted THEN m_worker WHEN late OR held THEN '' ELSE worker END,
    CASE WHEN late THEN CASE WHEN status IN ('running', 'done') THEN until + {LEASES.forget} END WHEN granted THEN m_at + {LEASES.lease} WHEN held THEN m_at + CASE WHEN kind = 'done' THEN {LEASES.refresh} ELSE {LEASES.forget} END ELSE until END,
    CASE WHEN late AND status <> 'running' THEN 0 WHEN granted THEN attempts + 1 ELSE attempts END,
    CASE WHEN late AND status <> 'running' THEN 0 WHEN held AND kind = 'error' THEN errors + 1 ELSE errors END
  FROM (SELECT *, NOT late AND kind = 'take' AND status NOT IN ('running', 'done', 'rejected', 'dead') AS granted, NOT late AND kind <> 'take' AND status = 'running' AND worker = m_worker AS held FROM (
    SELECT r.key, r.n, step, status, r.worker, until, attempts, errors, kind, e.at_ms AS m_at, e.seq AS m_seq, e.worker AS m_worker, until IS NOT NULL AND until <= coalesce(e.at_ms, horizon) AS late
    FROM r JOIN h ON true LEFT JOIN e ON e.key = r.key AND e.n = r.n + 1) WHERE late OR m_at IS NOT NULL))
SELECT key, at_ms, seq, event, outcome, status, attempts, errors FROM r WHERE step > 0
"""


@query("stm_leased_queue", LEASED_SQL)
def leased_queue(spark, d):
    """SUP-9, STM-4, STM-5: events as workers' messages, as a stream over the table, up to its last watermark."""
    stream = streamed(spark, d, "events")
    done = F.when(F.col("value") > 120, "reject").otherwise("done")
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "done").when(F.col("event_type") == "purchase", done).otherwise("take")
    worker = F.when(F.col("event_id") % 5 == 0, "b").otherwise("a")
    moves = work_queue(stream, key=F.col("user_id"), at=F.col("ts"), seq=F.col("event_id"), kind=kind, worker=worker, rules=LEASES, late=timedelta(hours=6))
    out, marks = new_path(spark, "queue"), new_path(spark, "queue-marks")
    moves.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    remove_path(spark, marks)
    return spark.read.schema(OUT).parquet(out)


@query(
    "ups_change_table",
    """WITH b AS (SELECT *, (day(ts) - 1) // 8 AS batch FROM events)
SELECT user_id, arg_max(event_type, event_id) FILTER (batch = first_batch) AS first_type, arg_max(value, (batch, event_id)) AS last_value, max(value) AS most, min(ts) AS since,
  list_sort(list(DISTINCT event_type)) AS kinds FROM (SELECT *, min(batch) OVER (PARTITION BY user_id) AS first_batch FROM b) GROUP BY 1""",
)
def change_table(spark, d):
    """UPS-1, STM-2: events in four batches of eight days, each appended as a run; the second fold meets folded runs."""
    path = new_path(spark, "changes")
    kept = ChangeTable(spark, path, "user_id long, first_type string, last_value double, most double, since timestamp, kinds array<string>", ["user_id"], {"first_type": "first", "most": "max", "since": "min", "kinds": "union"}, ranges=16, fan=2)
    events = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("first_type"), F.col("value").alias("last_value"), F.col("ts").cast("timestamp").alias("since"))
    for n in range(4):
        batch = events.filter(F.floor((F.dayofmonth("since") - 1) / 8) == n)
        own = batch.groupBy("user_id").agg(F.max("last_value").alias("most"), F.min("since").alias("since"), F.collect_set("first_type").alias("kinds"))
        last = batch.groupBy("user_id").agg(*(F.max_by(c, "event_id").alias(c) for c in ("first_type", "last_value")))
        kept.append(own.join(last, "user_id"), n)
    out = stored(kept.read().withColumn("kinds", F.array_sort("kinds")), "changed")
    remove_path(spark, path)
    return out


@query(
    "ded_incremental_linkage",
    """WITH RECURSIVE k AS (SELECT p_partkey AS id, 'b' || p_brand || ':' || p_size || ':' || p_type AS k FROM part UNION ALL SELECT p_partkey, 'p:' || p_retailprice || ':' || p_size FROM part),
h AS (SELECT k, min(id) AS a FROM k GROUP BY k), e AS (SELECT DISTINCT h.a, k.id AS b FROM k JOIN h USING (k) WHERE h.a <> k.id), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, x) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.x) SELECT id, min(x) AS entity FROM r GROUP BY id""",
)
def incremental_linkage(spark, d):
    """DED-6: parts that arrive in three batches, by a hash of their key, linked as they come."""
    path = new_path(spark, "linkage")
    size = F.col("p_size").cast("string")
    keys = F.array(F.concat(F.lit("b"), "p_brand", F.lit(":"), size, F.lit(":"), "p_type"), F.concat(F.lit("p:"), F.col("p_retailprice").cast("string"), F.lit(":"), size))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), keys.alias("keys"))
    linkage = Linkage(spark, path, ranges=16)
    for n in range(3):
        linkage.add(parts.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == n), n)
    out = stored(linkage.entities(), "linked")
    remove_path(spark, path)
    return out


@query("src_json_ranges", "SELECT doc_id, sha256(text) AS text_sha, lang, source, n_chars FROM documents")
def json_ranges(spark, d):
    """SRC-1, JSN-1: documents written as arrays, a file for each task, and read back in ranges that cut them anywhere."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path, part, wide = new_path(spark, "arrays"), "spark.sql.files.maxPartitionBytes", F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})

    def as_array(batches):
        sign = "["
        for batch in batches:
            lines = [sign + batch.column(0)[0].as_py()] + ["," + x for x in batch.column(0).to_pylist()[1:]] if batch.num_rows else []
            sign = "," if lines else sign
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if sign == "[" else "]"])], ["value"])

    docs.select(wide.alias("value")).mapInArrow(as_array, "value string").write.text(path)
    before = spark.conf.get(part)
    spark.conf.set(part, str(1 << 20))
    try:
        records, _ = json_records(spark, path, docs.schema)
        out = stored(records.withColumn("text_sha", F.sha2("text", 256)).drop("text"), "records")
    finally:
        spark.conf.set(part, before)
    remove_path(spark, path)
    return out


@query(
    "join_many_terms",
    """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM benchmark), d AS (SELECT doc_id, lower(text) AS text FROM documents),
w AS (SELECT doc_id, text, unnest(range(1, length(text) - 2)) AS i FROM d WHERE length(text) >= 4)
SELECT doc_id, term, count(*) AS n FROM w JOIN t ON left(term, 4) = substr(text, i, 4) WHERE starts_with(substr(text, i, 64), term) GROUP BY 1, 2""",
)
def many_terms(spark, d):
    """JOIN-5, STR-6: all words of the benchmark in all documents, within words too, in one pass."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    return find_terms(table(spark, d, "documents").select("doc_id", "text"), "text", words)


@query("flt_indexed_search", "SELECT q, doc_id FROM documents, (VALUES ('license'), ('the '), ('e'), ('@example.com'), ('no such words')) s(q) WHERE contains(lower(text), trim(q))")
def indexed_search(spark, d):
    """FLT-1, FLT-26: documents indexed in two batches, and five searches: rare, common, of one letter, with marks, in vain."""
    path = new_path(spark, "search")
    index, docs = SearchIndex(spark, path, ranges=16), table(spark, d, "documents").select("doc_id", "text")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for n in (0, 1):
        index.add(docs.filter(half == n), n, "doc_id", ["text"])
    rows = docs.count()
    found = [index.search(q, rows).select(F.lit(q).alias("q"), F.col("id").alias("doc_id")) for q in ("license", "the ", "e", "@example.com", "no such words")]
    out = stored(reduce(DataFrame.union, found), "found")
    remove_path(spark, path)
    return out


CRAWL = {"depth": 3, "per_site": 70, "total": 1500}


def _crawl_sql() -> str:
    """The rounds one after the other."""
    per_site, total = CRAWL["per_site"], CRAWL["total"]
    pick = "SELECT url, site, ord FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord, url) AS n FROM {0}) LEFT JOIN ({1}) u USING (site) WHERE n + coalesce(used, 0) <= {2} ORDER BY ord, url LIMIT {3}"
    steps = [
        "l AS MATERIALIZED (SELECT src, dst, p_brand AS site, ord FROM (SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS src, l_partkey AS dst, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) JOIN part ON p_partkey = dst WHERE src IS NOT NULL)",
        "s AS (SELECT p_partkey AS url, p_brand AS site, p_partkey AS ord FROM part WHERE p_size = 7)",
        f"v0 AS MATERIALIZED (SELECT url, site, 0 AS depth, ord FROM ({pick.format('s', 'SELECT NULL AS site, 0 AS used WHERE false', per_site, total)}))",
        "a0 AS (SELECT * FROM v0)",
    ]
    for k in range(1, CRAWL["depth"] + 1):
        steps.append(f"f{k} AS (SELECT dst AS url, arg_min(l.site, l.ord) AS site, min(l.ord) AS ord FROM l JOIN v{k - 1} ON src = v{k - 1}.url WHERE dst NOT IN (SELECT url FROM a{k - 1}) GROUP BY 1)")
        used = f"SELECT site, count(*) AS used FROM a{k - 1} GROUP BY 1"
        steps.append(f"v{k} AS MATERIALIZED (SELECT url, site, {k} AS depth, ord FROM ({pick.format(f'f{k}', used, per_site, f'(SELECT greatest(0, {total} - count(*)) FROM a{k - 1})')}))")
        steps.append(f"a{k} AS MATERIALIZED (SELECT * FROM a{k - 1} UNION ALL SELECT * FROM v{k})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT url, site, CAST(depth AS INT) AS depth, CAST(ord AS BIGINT) AS ord FROM a{CRAWL['depth']}"


@query("ext_crawl_rounds", _crawl_sql())
def crawl_rounds(spark, d):
    """EXT-8: parts as pages that link to the next part of an order, brands as sites; the budgets are the feature."""
    part = table(spark, d, "part")
    before = F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    steps = table(spark, d, "lineitem").select(before.alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ord"))
    links = steps.filter("src is not null").join(part.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("site")), "dst")
    seeds = part.filter("p_size = 7").select(F.col("p_partkey").alias("url"), F.col("p_brand").alias("site"), F.col("p_partkey").cast("long").alias("ord"))
    return crawl_links(seeds, links, **CRAWL)


@query(
    "jsn_change_feed",
    """WITH o AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_nationkey <> 3),
n AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN upper(c_name) || '!' ELSE c_name END AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS bal FROM customer WHERE c_acctbal < 9000)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS change, o.name AS name_before, n.name AS name_after, o.bal AS bal_before, n.bal AS bal_after
FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.name IS DISTINCT FROM n.name OR o.bal IS DISTINCT FROM n.bal""",
)
def feed_of_customers(spark, d):
    """JSN-2, UPS-5: two versions of the customers, in buckets, and what changed between them."""
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    old = c.filter("c_nationkey <> 3").select("id", F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    name = F.when(F.col("c_acctbal") < 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name"))
    new = c.filter("c_acctbal < 9000").select("id", name.alias("name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("bal"))
    paths = [new_path(spark, "version"), new_path(spark, "version")]
    names = [f"tamis_{p.rpartition('-')[2]}" for p in paths]
    versions = [write_version(df, n, "id", buckets=16, path=p) for df, n, p in zip((old, new), names, paths)]
    feed = change_feed(*versions, "id").select("id", "change", *(F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("name", "bal") for side in ("before", "after")))
    out = stored(feed, "feed")
    for n, p in zip(names, paths):
        spark.sql(f"DROP TABLE {n}")
        remove_path(spark, p)
    return out
