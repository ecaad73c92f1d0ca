"""Relations with the shape of the engine's records over the TPC-H-like tables, in Spark and as SQL for checks.

`leads` has a row per order: a record with a name, country, segment, source bucket, two scores, a stage and times.
`links` has a row per page, `mentions` a row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.scoring import BUCKET_ORDER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leads(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("id"), key.alias("ord"), F.col("c_custkey").alias("cust"), F.col("c_name").alias("name"), F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("intent"),
        ((key * 37 + F.col("c_custkey") * 11) % 101).cast("int").alias("score"),
        F.when(key % 5 == 0, 0).otherwise(key * 53 % 97).cast("int").alias("commercial_score"),
        F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "F", "contacted").otherwise("").alias("stage"),
        F.get(F.array(*map(F.lit, BUCKET_ORDER)), (key % 15).cast("int")).alias("bucket"),
        F.col("o_totalprice").alias("value"), F.col("o_orderdate").cast("timestamp").alias("last_seen"),
    )


_BUCKETS = "[" + ", ".join(f"'{b}'" for b in BUCKET_ORDER) + "]"
LEADS = f"""leads AS (SELECT o_orderkey AS id, o_orderkey AS ord, c_custkey AS cust, c_name AS name, n_name AS country, c_mktsegment AS segment, o_orderpriority AS intent,
  CAST((o_orderkey * 37 + c_custkey * 11) % 101 AS INT) AS score, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey * 53 % 97 END AS INT) AS commercial_score,
  CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'contacted' ELSE '' END AS stage, ({_BUCKETS})[CAST(o_orderkey % 15 AS INT) + 1] AS bucket,
  o_totalprice AS value, CAST(o_orderdate AS TIMESTAMP) AS last_seen
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

#: An address's parts, as one pattern for both engines.
URL = r"(?i)^\s*(https?)://(?:[^/?#@\s]*@)?([^/?#:\s]+)(?::(\d+))?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_part(col: str, n: int) -> str:
    return f"regexp_extract({col}, '{URL}', {n})"


def safe_url_sql(col: str) -> str:
    s, h, p, path, q = (url_part(col, n) for n in range(1, 6))
    return f"""CASE WHEN {h} <> '' THEN replace(lower({s}) || '://' || lower({h}) || CASE WHEN {p} = '' OR (lower({s}) = 'http' AND {p} = '80') OR (lower({s}) = 'https' AND {p} = '443') THEN '' ELSE ':' || {p} END
      || CASE WHEN rtrim({path}) = '' THEN '/' ELSE rtrim({path}) END || rtrim({q}), ' ', '%20') END"""


def domain_sql(col: str) -> str:
    return f"regexp_replace(lower({url_part(col, 2)}), '^www\\.', '')"
