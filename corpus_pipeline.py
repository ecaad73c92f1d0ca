"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Every stage takes all documents that the one before it kept and returns those that it keeps, with the columns of
`documents`; the last returns packed pieces. Between stages the rows are written as Parquet in the shared folder and
read again, so a lost executor costs one stage at most. `run` returns the last stage's rows lazily.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import col, new_path, stored
from tamis.llm.decontaminate import decontaminate
from tamis.llm.jaccard import jaccard_join, row_key
from tamis.llm.line_dedup import dedup_lines
from tamis.llm.packing import pack
from tamis.llm.quality import judge


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    kept = judge(docs).filter("kept")
    return kept.select(*(col("row", c) for c in docs.columns)).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many documents share. Those that lost lines and have no word left go; others stay, those
    that were empty before too."""
    cleaned = dedup_lines(docs)
    cleaned = cleaned.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    columns = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return cleaned.select(*(columns[c] if c in columns else col("row", c) for c in docs.columns)).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least doc_id, of each group of exact and near copies.

    Rows are told by doc_id and text. Documents that are no other's copy stay, those without an id too; of rows that
    repeat an id and are copies of each other one stays.
    """
    groups = jaccard_join(docs, with_rows=True)
    rows = groups.filter("doc_id is not null").groupBy("doc_id", F.col("key").alias("_key")).agg(F.count("*").alias("n"), F.max("first").alias("first"))
    rows = stored(rows.filter("n > 1 or not first"), "copies")
    keyed = docs.withColumn("_key", row_key("doc_id", "text"))
    once = keyed.join(rows.select("doc_id", "_key"), ["doc_id", "_key"], "left_anti")
    # Rows that repeat an id and text, of which one stays.
    several = keyed.join(rows.filter("first").select("doc_id", "_key"), ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"])
    return once.select(*map(col, docs.columns)).union(several.select(*map(col, docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("packing", packing)]

#: Packing needs a tokenizer, which SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
