"""Operator 11, filter interaction audit by multilinear extension.

Every document gets a mask of the filters that it fails. The masks' counts of a part (a source) form its removal
polynomial: for x_i the chance that filter i is applied, the expected number of documents removed. It has a coefficient
for each set T of filters, the number of documents that fail all of T with the sign of -(-1)^|T|. At a corner of the
cube it is the number of documents that a set of filters removes, from which all counts of every order of the filters
follow. A filter's Shapley value is the integral of the polynomial's partial derivative along the diagonal, which is
exact in rationals; times 120 it is the filter's removals summed over all orders.

The four filters that read one text are told in one scan of the texts; what goes on is an id, a mask and a text's 128-bit
digest. Copies are told by two sums: documents of equal digest, part and labels, then the least id of each digest. A
group of copies therefore shrinks to a few rows for each part before its rows meet.

Cases: a null text is empty, and an empty text fails A (and E after another one); a null source is the part ''; a null
doc_id is no document's smaller one, fails no E and has no labels; rows that repeat an id and a text fail E together if
a smaller id has that text, and not otherwise; an id with several label rows has all their marks, null labels mark
nothing; a long text is read in slices, so a task holds its distinct words at most; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import col
from tamis.llm.tokens import _parts

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 50, 65, 5, list(b"#$%&*|")
#: The bit of the filter that needs all texts.
COPY = FILTERS.index("E")
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    n, upper, points, marked, distinct = 0, 0, 0, False, set()
    for part in (text,) if len(text) <= SLICE else _parts(text, SLICE):
        words = part.split()
        n += len(words)
        distinct.update(words)
        seen = np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        upper += int(seen[65:91].sum())
        points += len(part) - int(seen[128:192].sum())
        marked = marked or bool(seen[SYMBOLS].any())
    fails = (n < MIN_WORDS, 100 * len(distinct) < MIN_DISTINCT_PERCENT * n, 100 * upper > MAX_UPPER_PERCENT * points, marked)
    return sum(1 << i for i, f in enumerate(fails) if f)


class RemovalPolynomial:
    """The multilinear polynomial of removals, from the number of documents with each mask of failed filters."""

    def __init__(self, counts: Sequence[int]):
        self.n = (len(counts) - 1).bit_length()
        above = list(counts)  # documents that fail all filters of T
        for i in range(self.n):
            for t in range(len(above)):
                if not t >> i & 1:
                    above[t] += above[t | 1 << i]
        self.total = above[0]
        self.coefficients = [0] + [(-1) ** (t.bit_count() + 1) * above[t] for t in range(1, len(above))]

    def at(self, x: Sequence[Fraction | int]) -> Fraction:
        """Documents expected to go if filter i is applied with the chance x[i]."""
        total = Fraction(0)
        for t, c in enumerate(self.coefficients):
            term = Fraction(c)
            for i in range(self.n):
                if t >> i & 1:
                    term *= x[i]
            total += term
        return total

    def corners(self) -> list[int]:
        """The value at every corner of the cube: the documents that each set of filters removes."""
        value = list(self.coefficients)
        for i in range(self.n):
            for s in range(len(value)):
                if s >> i & 1:
                    value[s] += value[s ^ 1 << i]
        return value

    def diagonal_derivative(self, i: int) -> list[int]:
        """Coefficients by power of t of the derivative in x_i at (t, ..., t)."""
        by_power = [0] * self.n
        for t, c in enumerate(self.coefficients):
            if t >> i & 1:
                by_power[t.bit_count() - 1] += c
        return by_power

    def shapley(self, i: int) -> Fraction:
        return sum((Fraction(c, power + 1) for power, c in enumerate(self.diagonal_derivative(i))), Fraction(0))


def audit_rows(masks: list[dict]) -> list[tuple]:
    """Rows of OUT without the part, from its (mask, n, n_good, n_toxic): every order and step."""
    counts = {k: [0] * (1 << len(FILTERS)) for k in ("n", "n_good", "n_toxic")}
    for m in masks:
        for k, c in counts.items():
            c[m["mask"]] += m[k]
    every = RemovalPolynomial(counts["n"])
    gone, good, toxic = every.corners(), RemovalPolynomial(counts["n_good"]).corners(), RemovalPolynomial(counts["n_toxic"]).corners()
    full, scale, rows = len(gone) - 1, factorial(len(FILTERS)), []
    value = [every.shapley(i) * scale for i in range(len(FILTERS))]
    assert all(v.denominator == 1 for v in value)
    for order in permutations(range(len(FILTERS))):
        before, name = 0, "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            rows.append((name, step, every.total - gone[after], removed, gone[1 << i] - removed, gone[full] - gone[full ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], int(value[i])))
            before = after
    return rows


def document_masks(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, key): the filters of A to D that each document fails, and its text's digest."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            masks = pa.array(map(text_mask, texts), pa.int32())
            keys = pa.array((hashlib.blake2b(t, digest_size=16).digest() for t in texts), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, keys], ["doc_id", "part", "mask", "key"])

    given = docs.select(col(doc).cast("long"), F.coalesce(col(part).cast("string"), F.lit("")), col(text).cast("string").cast("binary"))
    return given.mapInArrow(run, "doc_id long, part string, mask int, key binary")


def mask_counts(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """(part, mask, n, n_good, n_toxic) over all five filters."""
    marks = labels.filter(col("doc_id").isNotNull()).groupBy(col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(*(F.max(F.coalesce(col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    known = document_masks(docs, **names).join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    alike = ["key", "mask", "part", "good", "toxic"]
    # Rows of one id first, which the join has together; then those of one text, part and labels with their least id.
    ids = known.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = ids.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), least.alias("least"))
    # A text has a row for each part and labels now.
    first = F.min("least.doc_id").over(Window.partitionBy("key"))
    groups = groups.withColumn("first", F.col("no_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(1 << COPY).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    told = groups.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return told.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"n_{c}") for c in ("good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """Columns OUT: for every part, order of the filters and step, what the step's filter does."""
    # At most 32 masks a part.
    parts = mask_counts(docs, labels, **names).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("masks"))
    columns = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7

    def run(batches):
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(part, *r) for r in audit_rows(masks)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)

    return parts.mapInArrow(run, OUT)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs, labels)


#: Every order is played out here, filter by filter, and the Shapley value is the sum over the orders.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY 1),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
w AS (SELECT d.*, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(w.t, '[A-Z]')) > 5 * length(w.t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w JOIN least ON w.t = least.t LEFT JOIN marks ON marks.doc_id = w.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2),
l(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31 AND l1.b | l2.b | l3.b | l4.b | l5.b = 31),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(g) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(x) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM (SELECT part, mask, n, g, x, filter_order, step, bit, CAST(before AS INT) AS before FROM m, s) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
