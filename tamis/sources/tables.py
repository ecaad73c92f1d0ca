"""Readers: record tables with a declared schema, JSON stores, backups, logs, status files, file metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.sources.json_ranges import json_records

#: The declared columns of stored records that the operators use; others pass through.
RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "source", "query", "url", "domain", "platform", "title", "name", "snippet", "lead_type", "segment", "country", "priority", "stage", "notes", "entity_key")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("emails", "phone_numbers", "social_links", "contact_links", "website_links", "languages", "evidence", "run_ids", "rejection_reasons")]
    + [T.StructField(c, T.IntegerType()) for c in ("score", "commercial_score", "contact_confidence")]
    + [T.StructField(c, T.TimestampType()) for c in ("first_seen", "last_seen", "updated_at")]
    + [T.StructField("ingest_ord", T.LongType())]
)


def json_store(spark: SparkSession, paths: str | list[str], schema: T.StructType = RECORD, multi_line: bool = True, field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-1..3: (records, corrupt) of JSON files under a declared schema. A file is one array of records, in a field of an
    object if one is named, read in ranges (see json_records), and corrupt are the files that aren't whole, with their kind;
    or (multi_line=False) it has a record in each line, and corrupt are the lines that don't parse, with their file."""
    if multi_line:
        records, files = json_records(spark, paths, schema, field)
        return records, files.filter("kind != 'OK'")
    raw = spark.read.option("ignoreCorruptFiles", True).text(paths)
    raw = raw.filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = raw.withColumn("records", F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(schema)))
    return parsed.select(F.inline("records")), parsed.filter("records is null").select("file", "value")


def newest_backup(spark: SparkSession, paths: list[str], schema: T.StructType = RECORD) -> DataFrame:
    """SRC-3: records of all backups; of each id that of the file written last."""
    read = spark.read.schema(schema).option("ignoreCorruptFiles", True).json(paths).withColumns({"_at": F.col("_metadata.file_modification_time"), "_file": F.col("_metadata.file_path")})
    w = Window.partitionBy("id").orderBy(F.desc("_at"), F.desc("_file"))
    return read.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_at", "_file")


def api_results(raw: DataFrame, column: str, items: str, title: str = "title", url: str = "url", snippet: str = "description") -> DataFrame:
    """SRC-7: a row per result of a search API's JSON answer; `items` names the nested array."""
    kind = f"struct<{items}:array<struct<{title}:string,{url}:string,{snippet}:string>>>"
    rows = raw.withColumn("_a", F.from_json(column, kind)).select(*raw.columns, F.posexplode(f"_a.{items}").alias("rank", "_r"))
    return rows.select(*raw.columns, "rank", F.col(f"_r.{title}").alias("title"), F.col(f"_r.{url}").alias("url"), F.col(f"_r.{snippet}").alias("snippet"))


def log_tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """SRC-10: the last n non-empty lines of a log, newest first; lines need no order of their own but the file's: that of the
    ranges in which it is read, and within them that of reading."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return lines.filter(F.trim("value") != "").orderBy(F.desc("block"), F.desc("at")).limit(n).drop("block")


def status_files(spark: SparkSession, pattern: str, now) -> DataFrame:
    """SRC-9: a row per status file with its worker's name and age in minutes."""
    read = spark.read.option("multiLine", True).json(pattern).withColumn("worker", F.regexp_extract("_metadata.file_name", r"^(.*)-status\.json$", 1))
    return read.withColumn("age_minutes", (F.unix_seconds(now) - F.unix_seconds(F.to_timestamp("updatedAt"))) / 60)


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: path, size and time of change of files, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
