"""Many terms at once and indexed search against a scan in Python."""

import random

import pytest
from pyspark.sql import functions as F

from tamis.operators.search_index import SHARE, SearchIndex
from tamis.operators.terms import find_terms, scored

TEXTS = [(1, "Aaaa banana", "x"), (2, "", "x"), (3, None, "y"), (3, "ANANAS é É 😀?a 😀", None), (3, "ANANAS é É 😀?a 😀", None), (4, "the cat.\nthe\ncat " * 50, "y"), (5, "ab" * 20_000, "z")]
TERMS = ["a", "aa", "ana", "banana", "É", "😀", "?a", "the\ncat", "THE", "the", "", None, "nowhere", "abab", "b" * 9]


def counted(text, term):
    text, term = (text or "").lower(), (term or "").lower()
    return sum(text.startswith(term, i) for i in range(len(text))) if term else 0


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [1000, 0])
@pytest.mark.parametrize("short", [True, False])
def test_terms_in_texts(spark, most, short):
    terms = [t for t in TERMS if short or t is None or len(t) > 2]
    df = spark.createDataFrame(TEXTS, "id int, text string, tag string")
    found = find_terms(df, "text", spark.createDataFrame([(t,) for t in terms], "term string"), most_terms=most)
    expected = [(i, tag, t, n) for i, text, tag in TEXTS for t in {(t or "").lower() for t in terms} if (n := counted(text, t))]
    assert found.columns == ["id", "tag", "term", "n"] and rows(found) == sorted(expected, key=repr)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = spark.createDataFrame([(None,)], "term string")
    assert find_terms(df, "text", none).count() == 0 and find_terms(df.limit(0), "text", none).count() == 0


def test_ten_thousand_terms_both_ways(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    terms = spark.createDataFrame([(word(rng.randrange(4, 9)),) for _ in range(10_000)], "term string")
    df = spark.createDataFrame([(i, " ".join(word(rng.randrange(3, 12)) for _ in range(80))) for i in range(30)], "id int, text string")
    one, other = find_terms(df, "text", terms), find_terms(df, "text", terms, most_terms=0)
    assert rows(one) == rows(other) and one.count() > 2000


def test_scores_of_weighted_terms(spark):
    df = spark.createDataFrame([(1, "Forex and forex signals"), (2, "nothing"), (3, None)], "id int, text string")
    weights = spark.createDataFrame([("forex", 5), ("SIGNALS", 3), ("forex and", -1), ("absent", 9)], "term string, weight int")
    assert rows(scored(df, "text", weights)) == [(1, 7), (2, 0), (3, 0)]


def test_indexed_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(1)
    words = ["forex", "signal", "éclair", "😀x😀", "a", "to", "rare-one", "it's", "100%", "a_b", "\\d"]
    texts = {i: " ".join(rng.choice(words[:6] if i % 9 else words) for _ in range(12)) for i in range(90)} | {200: "", 201: None, 202: "Ab"}
    frame = lambda t: spark.createDataFrame([(i, x, f"T{i}") for i, x in t.items()], "id long, body string, title string")
    index = SearchIndex(spark, str(tmp_path / "i"), ranges=16)
    index.add(frame({i: t for i, t in texts.items() if i % 2}), 0, "id", ["title", "body"])
    index.add(frame({i: t for i, t in texts.items() if i % 2 == 0}), 1, "id", ["title", "body"])
    index.add(frame({5: "never added: the number is not new"}), 1, "id", ["title", "body"])
    # A row that changes: its old words no longer find it.
    texts[7] = "changed entirely"
    index.add(frame({7: texts[7]}), 2, "id", ["title", "body"])
    again = SearchIndex(spark, str(tmp_path / "i"), ranges=16)
    whole = {i: f"T{i} {t}".lower() if t is not None else f"t{i}" for i, t in texts.items()}
    for q in ("rare-one", "Forex", "to", "é", "", " changed ", "it's 100%", "a_b", "\\d", "x😀", "absent words", "t20"):
        assert sorted(r["id"] for r in again.search(q).collect()) == sorted(i for i, t in whole.items() if q.strip().lower() in t), q
    # A rare search reads a few ranges of the texts, a common one and one of two letters read all.
    assert again.rarest("changed entirely")[0][1] == 1 <= SHARE * len(texts)
    read = lambda q: _bytes(spark, again.search(q, len(texts)))
    assert read("changed entirely") < 0.4 * read("to")


def _bytes(spark, df):
    """Bytes of the files that a plan reads, those of the texts among them."""
    on = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*").where(F.lit(True))
        plan.collect()
        leaves = plan._jdf.queryExecution().executedPlan().collectLeaves()
        total = 0
        for i in range(leaves.size()):
            found = leaves.apply(i)
            if "FileScan" in found.nodeName() or "Scan parquet" in found.nodeName():
                if "text:string" in found.toString():
                    total += found.metrics().apply("filesSize").value()
        return total
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", on)


def test_postings_are_kept_by_parts(spark, tmp_path):
    """Rows of postings grow with the pieces of a part, not with those of all texts."""
    texts = spark.range(0, 600, 1, 1).select("id", F.concat(F.lit("common words 😀 of all, "), F.col("id").cast("string"), F.when(F.col("id") == 77, F.lit(" été rare"))).alias("t")).union(spark.createDataFrame([(601, "ab"), (602, ""), (603, None), (604, " été😀")], "id long, t string"))
    index = SearchIndex(spark, str(tmp_path / "i"), ranges=4)
    index.add(texts.withColumn("t", F.coalesce("t", F.concat(F.lit("common words 😀 of all, "), F.col("id").cast("string")))), 0, "id", ["t"])
    kept = index.postings.read()
    parts = kept.filter("ids is not null")
    assert sum(len(r["ids"]) for r in parts.collect()) == 604 and kept.count() < 2000 * parts.count()
    assert dict(index.rarest("été")) == {"été": 2}
    for q, ids in (("été", [77, 604]), ("été rare", [77]), ("all, 599", [599]), ("été😀", [604]), ("zzz", [])):
        assert sorted(r["id"] for r in index.search(q, 604).collect()) == ids, q
