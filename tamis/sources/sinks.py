"""Writers: exact CSV, several exports of one scan, snapshots, guarded overwrites, capped histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.text import csv_cell


def csv_lines(df: DataFrame) -> DataFrame:
    """SNK-2: one text line per row: arrays joined with "; ", cells quoted only where they must be."""
    cells = [F.array_join(c, "; ") if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    return df.select(F.concat_ws(",", *(csv_cell(c) for c in cells)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-2: files without a header line each; the header is the caller's, as `",".join(df.columns)`."""
    csv_lines(df).write.mode("overwrite").text(path)


def write_exports(df: DataFrame, views: dict[str, Column], path: str) -> None:
    """SNK-4: the rows of every view in a folder of its own, from one scan; a row may be in several."""
    names = F.array_compact(F.array(*(F.when(c, name) for name, c in views.items())))
    df.withColumn("export_view", F.explode(names)).write.mode("overwrite").partitionBy("export_view").parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a table, in order: those whose write was committed."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at(path)):
        return []
    found = (f.getPath().getName() for f in fs.listStatus(at(path)) if f.isDirectory())
    return sorted(int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and fs.exists(at(f"{path}/{n}/_SUCCESS")))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """SNK-1: the newest whole version; null before the first."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/v{known[-1]}") if known else None


def replace_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """SNK-1, SNK-9: writes the next version beside the others; it counts once Spark has committed it, so a reader, or a run
    that follows a crash at any step, finds the former version or the new one whole. The rows may come from the table
    itself. The last `keep` versions stay, as backups; older ones, and what crashed runs left, are removed."""
    spark = df.sparkSession
    fs, at = _hadoop(spark, path)
    known = versions(spark, path)
    number = (known[-1] if known else 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{number}")
    for f in fs.listStatus(at(path)):
        name = f.getPath().getName()
        if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) not in [*known, number][-keep:]:
            fs.delete(f.getPath(), True)


def write_json(df: DataFrame, path: str) -> None:
    """SNK-3: a JSON object a line; nulls are written, so that all rows have the same fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def archive_before(df: DataFrame, doomed: Column, path: str) -> DataFrame:
    """SNK-9: writes the rows that are about to go to an archive of their own, then returns those that stay."""
    gone = F.coalesce(doomed, F.lit(False))
    df.filter(gone).write.mode("overwrite").parquet(f"{path}/rejected")
    return df.filter(~gone)


def snapshot(accepted: DataFrame, rejected: DataFrame, order: list[Column], most_rejected: int = 5000) -> DataFrame:
    """SNK-7: accepted rows and the first rejected ones with their part."""
    few = rejected.orderBy(*order).limit(most_rejected)
    return accepted.withColumn("part", F.lit("accepted")).unionByName(few.withColumn("part", F.lit("rejected")), allowMissingColumns=True)


def report_lines(counts: DataFrame, title: str) -> list[str]:
    """SNK-8: all rows of a roll-up as Markdown; for a driver's eyes, so the caller's table must be small."""
    rows = counts.collect()
    head = counts.columns
    return [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)]
