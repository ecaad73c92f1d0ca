"""Operator 1, benchmark decontamination (built-in functions only).

The normalised n-grams of the benchmark form one small table, broadcast to every task while its counted bytes are within
`max_broadcast_bytes` (beyond that the same join shuffles). Every training document is scanned in token windows of the
same lengths, a row for each place and never an array of all windows; a window joins on the 64-bit hash of its words, and
a hit is verified on its full text. The places of the hits give the hit words. `decontaminate` doesn't shuffle documents:
it finds those with hits by a 128-bit hash of their texts.

Cases: null or word-less texts have no words and no hits; items without words have no windows; an item of fewer than
`n` words is one window of its own length; repeated documents are judged row by row, whatever their ids; null item ids
match but are not listed; an empty benchmark leaves every document clean; columns other than id and text are not read
by `scan` and pass through `decontaminate` under their own names, whatever these are; a text of any length takes the
memory of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import ascii_lower, col, stored, wide_hash

#: Letters, digits and everything beyond ASCII, once A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of all windows and their items' ids, with 64 for a row and 16 for an id; a hash table takes about twice as much.
MAX_BROADCAST_BYTES = 100_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, length, items): every distinct window with the sorted ids of the items that hold it."""
    words = benchmark.select(col(item).cast("string").alias("item"), words_of(col(text)).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.lit(n), F.size("words"))
    placed = words.select("item", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("at"))
    gram = F.array_join(F.slice("words", F.col("at"), F.col("length")), " ")
    return placed.groupBy(gram.alias("gram"), "length").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _met(base: DataFrame, grams: DataFrame, keep: list[str], max_broadcast_bytes: int, first: int) -> DataFrame:
    """base (words, keep): a row (keep, at, length, items) for each place, from 1, where a window stands, and with `first` 0
    also one for each row of `base`, at 0."""
    size = F.octet_length("gram") + 64 + F.coalesce(F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16), F.lit(0))
    # One row for each window length, at most n of them.
    sizes = {r["length"]: r["bytes"] for r in grams.groupBy("length").agg(F.sum(size.cast("long")).alias("bytes")).collect()}
    lengths = sorted(sizes) or [1]
    at, length, words = F.col("at"), F.col("length"), F.col("words")
    cut = base.select(*keep, "words", F.explode(F.sequence(F.lit(first), F.size("words"))).alias("at"))
    cut = cut.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("length")) if len(lengths) > 1 else cut.withColumn("length", F.lit(lengths[0]))
    cut = cut.filter(((at > 0) & (at + length - 1 <= F.size("words"))) | ((at == 0) & (length == lengths[0])))
    window = F.slice(words, F.greatest(at, F.lit(1)), length)
    # A document's own row has a key of its own, so that a join which shuffles spreads these rows.
    cut = cut.withColumn("key", F.when(at > 0, F.xxhash64(window)).otherwise(F.monotonically_increasing_id()))
    table = grams.select(F.xxhash64(F.split("gram", " ")).alias("key"), "gram", "items")
    if sum(sizes.values()) <= max_broadcast_bytes:
        met, own = cut.join(F.broadcast(table), "key", "left" if first == 0 else "inner"), F.array_join(window, " ")
    else:
        met, own = cut.withColumn("shown", F.array_join(window, " ")).drop("words").join(table, "key", "left" if first == 0 else "inner"), F.col("shown")
    return met.filter((at == 0) | (own == F.col("gram"))).select(*keep, "at", "length", "items")


def _places() -> Column:
    """The hit words of a group of rows of `_met`, from 0, in order."""
    at = F.col("at")
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(at > 0, F.sequence(at - 1, at + F.col("length") - 2))))))


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", carry: list[str] = ("doc_id",), n: int = 10, item: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per document: the `carry` columns as struct `row`, n_words, hits (positions of hit words, from 0), items."""
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*map(col, carry)).alias("row"), words_of(col(text)).alias("words"))
    base = base.select("uid", "words", F.struct("row", F.size("words").cast("long").alias("n_words")).alias("own"))
    met = _met(base, benchmark_windows(benchmark, n, item, item_text), ["uid", "own"], max_broadcast_bytes, 0)
    itself = F.first(F.when(F.col("at") == 0, F.col("own")), ignorenulls=True)
    found = met.groupBy("uid").agg(itself.alias("own"), _places().alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("at") > 0, F.col("items")))))).alias("items"))
    return found.select("own.row", "own.n_words", "hits", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", n: int = 10, item: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The documents without contamination, with their own columns.

    remove="documents" drops every document with a hit; "spans" keeps all documents and removes each hit word with the
    separators that follow it.
    """
    key = [h.alias(f"_h{i}") for i, h in enumerate(wide_hash(F.coalesce(col(text), F.lit(""))))]
    keys = ["_h0", "_h1"]
    base = docs.select(*key, words_of(col(text)).alias("words")).filter(F.size("words") > 0)
    met = _met(base, benchmark_windows(benchmark, n, item, item_text), keys, max_broadcast_bytes, 1)
    hit = stored(met.groupBy(*keys).agg(_places().alias("_hits")) if remove == "spans" else met.select(*keys).distinct(), "hits")
    keyed = docs.select(*key, *map(col, docs.columns))
    if remove == "documents":
        return keyed.join(hit, keys, "left_anti").select(*map(col, docs.columns))
    out = keyed.join(hit, keys, "left")
    pieces = F.regexp_extract_all(col(text), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[^0-9A-Za-z\x{80}-\x{10FFFF}]*"), F.lit(0))
    head = F.regexp_extract(col(text), r"^[^0-9A-Za-z\x{80}-\x{10FFFF}]*", 0)
    # The pieces between hits, found from the sorted hits: linear in the text.
    ends = F.concat(F.col("_hits"), F.array(F.size("_pieces")))
    kept = F.flatten(F.transform(ends, lambda end, k: F.slice(F.col("_pieces"), F.when(k > 0, F.get(ends, k - 1) + 2).otherwise(1), F.greatest(F.lit(0), end - F.when(k > 0, F.get(ends, k - 1) + 1).otherwise(0)))))
    cleaned = F.when(F.col("_hits").isNull(), col(text)).otherwise(F.concat(head, F.array_join(kept, "")))
    out = out.withColumn("_pieces", F.when(F.col("_hits").isNotNull(), pieces))
    return out.select(*(cleaned.alias(c) if c == text else col(c) for c in docs.columns))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = scan(docs, bench)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT l FROM grams),
dw AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS i, w FROM d, sizes WHERE len(w) >= l),
hits AS (SELECT dw.doc_id, dw.i, dw.l, grams.item FROM (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM dw) dw JOIN grams ON dw.g = grams.g AND dw.l = grams.l),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
