"""Operator 10, line dedup over levelled sorted runs of line hashes (built-in functions only).

Every line key is a 128-bit hash. `LineRuns` keeps runs (h1, h2, n_docs, last_doc) in levels, as tables bucketed and
sorted by hash with one file a bucket, so that Spark merges them without a shuffle or a sort. Each new batch is
merge-anti-joined with the runs: what none of them has becomes a run of level 0, with its counts; of the other keys the
batch's counts are kept beside the runs. `fanout` runs of a level are merged into one of the next, so a line is
rewritten a logarithmic number of times. For the corpus rule (a key in `min_docs` documents stays only in the largest
doc_id) all lines then meet the keys whose counts, in the runs and beside them, reach the bound. Texts move once, to meet
the positions of their dropped lines.

Cases: null and empty texts are one empty line; a line whose stripped key is shorter than `min_chars` code points is
never dropped; a key counts once for a document however often it holds it, and rows that repeat a doc_id are one
document: they lose a line alike, and at the largest doc_id all of them keep it; rows with a null doc_id count as
documents each but lose nothing; an empty table gives an empty result; extra columns pass through untouched, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import ASCII_SPACE, ascii_lower, col, new_path, partitions, remove_path, stored, wide_hash

KEY = ["h1", "h2"]
#: Spark relies on the order of bucketed tables, where each bucket is one file, with this setting only.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ORDERED, None)
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before) if before is not None else spark.conf.unset(ORDERED)


class LineRuns:
    """Levelled sorted runs under one folder of the shared one; `fanout` runs of a level become one of the next."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2):
        self.spark, self.path, self.fanout, self.buckets = spark, path or new_path(spark, "line-runs"), fanout, partitions(spark)
        self.levels: list[list[str]] = []
        self.counts: list[str] = []

    def _save(self, keys: DataFrame) -> str:
        """A bucketed and sorted table. Keys that come hash partitioned into as many parts as there are buckets, or from such
        tables, make one file a bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        with _in_order(self.spark):
            keys.write.format("parquet").option("path", f"{self.path}/{name}").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_path(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def novel(self, keys: DataFrame) -> DataFrame:
        """The rows of `keys` whose (h1, h2) is in no run yet."""
        return reduce(lambda left, run: left.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti"), self.runs(), keys)

    def add(self, keys: DataFrame) -> None:
        """keys: (h1, h2, doc), a row for each key and document. New keys become a run of level 0; the counts of the others
        stay beside the runs."""
        batch = self._save(keys.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc")))
        if not self.runs():
            self._put(0, batch)
            return
        run = self._save(self.novel(self.spark.table(batch)))
        self.counts.append(self._save(self.spark.table(batch).join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")))
        self._drop(batch)
        self._put(0, run)

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            # Runs have no key in common, so the merge of two is a full outer merge join of their buckets.
            merged = self._save(reduce(self._merge, map(self.spark.table, full)))
            for old in full:
                self._drop(old)
            self._put(level + 1, merged)

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(*KEY, F.col("n_docs").alias("_n"), F.col("last_doc").alias("_l")).hint("merge"), KEY, "full_outer").select(*KEY, F.coalesce("n_docs", "_n").alias("n_docs"), F.coalesce("last_doc", "_l").alias("last_doc"))

    def merged(self) -> DataFrame:
        """One row per key with its counts over all batches. The files are read as plain ones: a union of bucketed tables
        counts as bucketed in Spark 4.1, even where it reads them unbucketed, and then groups wrongly."""
        paths = [f"{self.path}/{name}" for name in (*self.runs(), *self.counts)]
        rows = self.spark.read.schema("h1 long, h2 long, n_docs long, last_doc long").parquet(*paths)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def drop(self) -> None:
        for name in (*self.runs(), *self.counts):
            self._drop(name)
        self.levels, self.counts = [], []


def dedup_lines(docs: DataFrame, *, carry: list[str] | None = None, doc: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(row, text, n_lines, n_dropped): each document's `carry` columns (by default all but the text) as struct `row`, and
    its text without dropped lines."""
    spark = docs.sparkSession
    id_ = col(doc).cast("long")
    hashed = F.transform(lines_of(col(text)), lambda line: _hash_of(key_of(line), min_chars))
    # Rows of one id are one document; those without id are documents each.
    rows = docs.select(F.when(id_.isNull(), F.monotonically_increasing_id()).alias("uid"), id_.alias("doc"), F.xxhash64(col(text)).alias("text_hash"), F.pmod(F.xxhash64(id_), F.lit(batches)).cast("int").alias("batch"), F.posexplode(hashed).alias("at", "k"))
    path = new_path(spark, "line-keys")
    rows.filter("k is not null").select("uid", "doc", "text_hash", "at", "k.h1", "k.h2", "batch").write.partitionBy("batch").option("compression", "zstd").parquet(path)
    keys = spark.read.schema("uid long, doc long, text_hash long, at int, h1 long, h2 long, batch int").parquet(path)

    runs = LineRuns(spark, fanout=fanout)
    for batch in range(batches):
        runs.add(keys.filter(F.col("batch") == batch).select("uid", "doc", *KEY).distinct())
    # Stored, so that the join below has plain shuffles on both sides and a line of very many documents can be split.
    frequent = stored(runs.merged().filter(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"), "frequent-lines")
    runs.drop()

    dropped = keys.join(frequent, KEY).filter(F.col("doc") < F.col("last_doc"))
    dropped = dropped.groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_set("at")).alias("drop"))
    carry = carry or [c for c in docs.columns if c != text] or [doc]
    held = docs.select(F.struct(*map(col, carry)).alias("row"), col(text).alias("text"), id_.alias("_d"), F.xxhash64(col(text)).alias("_h"))
    met = held.join(dropped.hint("shuffle_hash"), (F.col("_d") == F.col("_doc")) & (F.col("_h") == F.col("_hash")), "left")
    lines = lines_of(F.col("text"))
    # The runs of lines between two dropped ones, by the sorted positions: linear in the number of lines.
    ends = F.concat(F.col("drop"), F.array(F.size("lines")))
    start = lambda k: F.when(k > 0, F.get("ends", k - 1) + 1).otherwise(0)
    kept = F.flatten(F.transform("ends", lambda end, k: F.slice(F.col("lines"), start(k) + 1, F.greatest(F.lit(0), end - start(k)))))
    met = met.withColumn("lines", lines).withColumn("ends", ends)
    return met.select(
        "row",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _hash_of(key: Column, min_chars: int) -> Column:
    h1, h2 = wide_hash(key)
    return F.when(F.char_length(key) >= min_chars, F.struct(h1.alias("h1"), h2.alias("h2")))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id < hot.last_doc, false) AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
