"""The pipeline's stages against brute force, each on its own input, over small tables and the smallest given ones."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import quality
from tests.llm.test_operators import DOCS, NAMES, brute_hits, brute_lines, brute_links, encoded, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(stage's name, its input, its output) as lists of rows, over the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        left = spark.read.parquet(path)
        out.append((name, docs.collect(), left.collect(), docs.columns, left.columns))
        docs = left
    return out


def distance(p, q):
    keys = {*p, *q}
    a, b = ({k: x.get(k, 0) / sum(x.values()) for k in keys} for x in (p, q))
    half = lambda x: sum(v * math.log2(2 * v / (a[k] + b[k])) for k, v in x.items() if v)
    return math.sqrt(max(0, (half(a) + half(b)) / 2))


def char_class(c):
    if c > "\x7f":
        return "beyond"
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("blank", " \t\r\x0b\x0c"), ("line", "\n"), ("mark", ".,;:!?'\"-()"), ("symbol", "#*$%&|<>")):
        if c in chars:
            return name
    return "other"


def brute_quality(rows):
    plain = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    classes, common = {}, {}
    for r in rows:
        t = r["text"] or ""
        if 10 * len(re.findall(r"[#*$%&|<>]", t)) <= len(plain(t)):
            classes.setdefault(r["lang"], Counter()).update(map(char_class, t))
            common.setdefault(r["lang"], Counter()).update(plain(t))
    kept = []
    for r in rows:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        repeated = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})
        ok = len(w) >= 20 and 100 * repeated <= 30 * len(w)
        total = sum(common.get(r["lang"], {}).values())
        if total >= 2000:
            if len(t) >= 100:
                ok &= distance(Counter(map(char_class, t)), classes[r["lang"]]) <= 0.18 + 1 / math.sqrt(len(t))
            if len(plain(t)) >= 60:
                top = {k: n for k, n in sorted(common[r["lang"]].items(), key=lambda x: (-x[1], x[0].encode()))[:40]}
                lump = lambda c: Counter({k: c[k] for k in top}) + Counter({"": sum(c.values()) - sum(c[k] for k in top)})
                ok &= distance(lump(Counter(plain(t))), lump(common[r["lang"]])) <= 0.45
        if ok:
            kept.append(r["doc_id"])
    return sorted(kept)


def test_quality_stage(stages):
    _, before, after, columns, left = stages[0]
    assert left == columns and sorted(r["doc_id"] for r in after) == brute_quality(before) and 0 < len(after) < len(before)


def test_word_distance_alone_rejects_long_texts_of_other_words(spark):
    rng = np.random.default_rng(5)
    own, other, rare, strange = words(40, 21), words(40, 22), words(3000, 23), words(3000, 24)
    share = 1 / np.arange(1, 41)
    text = lambda n, common, rest: " ".join(rng.choice(common, p=share / share.sum()) if common and rng.random() < 0.3 else rng.choice(rest) for _ in range(n))
    texts = [text(n, own, rare) for n in [*[60] * 20, *[150] * 40, *[600] * 20]] + [text(600, other, strange), text(600, None, rare), text(200, None, rare)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    found = {r["row"]["doc_id"]: r for r in quality.judge(docs).collect()}
    for i in (80, 81, 82):
        assert not found[i]["base_failed"] and found[i]["char_distance"] < quality.MAX_CHAR_DISTANCE and found[i]["word_distance"] < quality.MAX_WORD_DISTANCE
    assert sorted(r["doc_id"] for r in pipeline.quality(spark, docs, SF).collect()) == list(range(80))


def test_line_stage(stages):
    _, before, after, columns, left = stages[1]
    assert left == columns
    kept = [(i, t) for i, _, dropped, t in brute_lines([(r["doc_id"], r["text"]) for r in before]) if not dropped or re.search(r"[0-9A-Za-z\x80-\U0010ffff]", t)]
    assert sorted((r["doc_id"], r["text"]) for r in after) == sorted(kept)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_documents_whose_lines_all_went_go(spark):
    line = "a line that is long enough to count"
    rows = [(1, f"{line}\n  \n."), (2, f"{line}\nown words"), (3, line), (4, ""), (5, None), (6, "\n"), (None, line)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    left = {(r["doc_id"], r["text"]) for r in pipeline.lines(spark, docs, SF).collect()}
    assert left == {(2, "own words"), (3, line), (4, ""), (5, None), (6, "\n"), (None, line)}


def test_near_duplicate_stage(stages):
    _, before, after, columns, left = stages[2]
    before = sorted(before, key=lambda r: r["doc_id"])
    heads = list(range(len(before)))
    links = brute_links([r["text"] for r in before])
    for _ in before:
        for a, b in links:
            heads[a] = min(heads[a], heads[b])
    assert left == columns and sorted(r["doc_id"] for r in after) == [before[i]["doc_id"] for i, h in enumerate(heads) if i == h]


def test_near_duplicates_are_told_by_row(spark):
    base, other = words(100, 31), words(100, 32)
    near = [" ".join([*other[:-1], f"end{i}"]) for i in range(3)]
    rows = [(3, " ".join(base)), (5, " ".join(base)), (5, "a unique text of its own"), (7, near[0]), (7, near[1]), (8, near[2]), (9, ""), (9, None), (None, " ".join(base))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    left = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs, SF).collect()]
    assert Counter(t for i, t in left if i == 7) in (Counter([near[0]]), Counter([near[1]]))
    assert Counter(x for x in left if x[0] != 7) == Counter([rows[0], rows[2], rows[6], rows[7], rows[8]])


def test_decontamination_stage(spark, stages):
    _, before, after, columns, left = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert left == columns and sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not brute_hits(r["text"], items)[1])


def test_packing_stage(stages):
    _, before, after, _, _ = stages[4]
    total = Counter()
    for r in after:
        total[r["doc_id"]] += r["length"]
    assert total == {r["doc_id"]: len(encoded(r["text"])) for r in before}


def test_packing_stage_rows(stages):
    _, before, after, _, _ = stages[4]
    ids = {r["doc_id"]: np.array(encoded(r["text"]), "<u4").tobytes() for r in before}
    docs, sequences = {}, {}
    for r in after:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])])
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) // 4 and r["length"] > 0
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert docs.keys() == ids.keys()
    for pieces in [*docs.values(), *sequences.values()]:
        pieces.sort()
        assert [x for x, _ in pieces] == np.cumsum([0, *(n for _, n in pieces[:-1])]).tolist()
    assert all(sum(n for _, n in docs[i]) == len(x) // 4 for i, x in ids.items())
    assert all(sum(n for _, n in s) <= 2048 for s in sequences.values())


def test_odd_rows_go_through_all_stages(spark):
    text = " ".join(words(200, 3))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, None, None, None), (None, text + " end", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "word " * 30, "en", "s", 1), (6, " ".join(words(80, 8)), "xx", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in pipeline.STAGES[:4]:
        for some in (docs, docs.limit(0), docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(NAMES)))):
            left = stage(spark, some, SF)
            assert left.columns == some.columns and left.count() <= 8, name
    near = pipeline.near_duplicates(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in near) == Counter([1, None, 3, 4, 5, 6])
    assert np.isfinite(pipeline.packing(spark, docs, SF).count())
