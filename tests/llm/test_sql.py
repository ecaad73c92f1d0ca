"""The SQL of the training-data operators against their queries over the smallest tables, and over tables that repeat ids."""

import random

import duckdb
import pytest

from tamis.llm.queries import ORACLES, QUERIES
from tests.test_queries import TABLES, rows

SF = "/root/testdata/sf0.001"


def told(sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet{'' if sf == SF else '/*.parquet'}')") if sf == SF or t in ("documents", "benchmark") else None
    found = con.execute(ORACLES[name])
    return [c[0] for c in found.description], found.fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operator_matches_sql(spark, name):
    found = QUERIES[name](spark, SF)
    columns, data = told(SF, name)
    assert sorted(columns) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, data)


def test_line_dedup_matches_sql_on_repeated_ids(spark, tmp_path):
    line = "a line that is long enough to count"
    docs = [(i, line) for i in (1, 1, 2)] + [(i, "Another line that many documents hold") for i in (3, 4, 5, 5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    dropped = {}
    for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect():
        dropped[r["doc_id"]] = dropped.get(r["doc_id"], 0) + r["n_dropped"]
    columns, data = told(str(tmp_path), "op10_line_dedup")
    assert dropped == {r[columns.index("doc_id")]: r[columns.index("n_dropped")] for r in data} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}



def test_quality_rejects_by_common_words_as_in_sql(spark, tmp_path):
    """A long text without one of its language's common words, in letters and marks like the others, goes by its words alone."""
    rng = random.Random(5)
    common, rare = [f"{a}{b}e" for a in "bcdfglmn" for b in "aeiou"], [f"{a}{b}{c}a" for a in "bcdfglmnprst" for b in "aeiou" for c in "lmnrst"]
    prose = lambda share, n=150: " ".join(rng.choice(common) if rng.random() < share else rng.choice(rare) for _ in range(n)) + "."
    docs = [(i, prose(0.4), "en", 1) for i in range(120)] + [(500, prose(0.0), "en", 1), (501, prose(0.0, 30), "en", 1), (502, prose(0.0), None, 1), (503, None, "en", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, kept int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = QUERIES["op2_quality"](spark, str(tmp_path))
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in found.collect()}
    columns, data = told(str(tmp_path), "op2_quality")
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, data)
    assert kept[500] == (False, False) and kept[501] == kept[502] == (False, True) and kept[503] == (True, False)
    assert all(kept[i] == (False, True) for i in range(120))
