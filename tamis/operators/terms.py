"""Many terms in many texts in one pass: which terms a text holds, and how often, overlapping occurrences each counted.

A vocabulary of counted size becomes an automaton that every task follows over its texts, so the time is that of the
text whatever the number of terms. A larger one stays a table: texts give a window at each place, windows join the terms on
their common number of first letters, and a window that begins with the whole term counts. Both give the same rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Terms and bytes of terms up to which they are broadcast as an automaton.
MOST_TERMS, MOST_BYTES = 200_000, 16 << 20
#: First letters that windows and terms are joined on, at most.
PREFIX = 8


def find_terms(df: DataFrame, text: str, terms: DataFrame, term: str = "term", *, most_terms: int = MOST_TERMS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """JOIN-5, STR-6: df's columns but the text, with `term` and its number of occurrences `n`, for each term that the text
    holds, whatever the case. Empty and null terms, and null texts, match nothing; a term counts once however often the table
    has it; rows of df that are alike are counted each."""
    wanted = terms.select(F.lower(F.col(term)).alias("term")).filter("term != ''").distinct()
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= most_terms and size["bytes"] <= most_bytes:
        return _by_automaton(df, text, [r["term"] for r in wanted.collect()])
    return _by_prefix(df, text, wanted)


def _kept(df: DataFrame, text: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c != text]


def _by_automaton(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    given = df.select(F.struct(*_kept(df, text)).alias("row"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        import ahocorasick

        match = ahocorasick.Automaton()
        for t in sent.value:
            match.add_word(t, t)
        if sent.value:
            match.make_automaton()
        for batch in batches:
            at, found, n = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist() if sent.value else []):
                for k, times in Counter(hit for _, hit in match.iter(t)).items():
                    at.append(i)
                    found.append(k)
                    n.append(times)
            rows = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(found, pa.string()), pa.array(n, pa.int64())], ["row", "term", "n"])

    schema = StructType([given.schema["row"], StructField("term", StringType()), StructField("n", LongType())])
    return given.mapInArrow(run, schema).select("row.*", "term", "n")


def _by_prefix(df: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    lengths = terms.agg(F.min(F.char_length("term")), F.max(F.char_length("term"))).first()
    first, longest = min(PREFIX, lengths[0]), lengths[1]
    given = df.select(F.struct(*_kept(df, text), F.monotonically_increasing_id().alias("_row")).alias("row"), F.lower(F.col(text)).alias("t"))
    # Linear in the text; a window begins at a character, not within one of two units of UTF-16.
    window = rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{first - 1},{longest - 1}}}))"
    windows = given.select("row", F.explode(F.regexp_extract_all("t", F.lit(window), F.lit(1))).alias("w"))
    met = windows.withColumn("p", F.substring("w", 1, first)).join(terms.withColumn("p", F.substring("term", 1, first)), "p").filter(F.startswith("w", "term"))
    return met.groupBy("row", "term").agg(F.count("*").alias("n")).select("row.*", "term", "n").drop("_row")


def scored(df: DataFrame, text: str, weights: DataFrame, score: str = "score") -> DataFrame:
    """CLS-6: df's columns but the text, and the sum of the weights (term, weight) of the terms that each row's text holds, each
    once; 0 without any. `df` rows are told by all their columns, so they should have a key."""
    found = find_terms(df, text, weights).join(weights.groupBy(F.lower("term").alias("term")).agg(F.sum("weight").alias("weight")), "term")
    keys = [c for c in df.columns if c != text]
    total = found.groupBy(*(f"`{k}`" for k in keys)).agg(F.sum("weight").alias("_sum")).select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), "_sum")
    met = [df[f"`{k}`"].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.drop(text).join(total, met, "left").select(*(f"`{k}`" for k in keys), F.coalesce("_sum", F.lit(0)).alias(score))
