"""The ten operators on small tables: brute force, edge rows and round trips."""

import functools
import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.llm import chat, common, decontaminate, jaccard, line_dedup, packing, quality, suffix_dedup, token_counts, tokens, toxicity, training_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


ODD = [None, "", " \n\t", "É ñ\x00\x85 ß", "\n".join(["same line of more than twenty chars"] * 3), "word", "x" * 70, "日本 語 テキスト " * 20]

# --- 1 ----------------------------------------------------------------------------------------------------------------


def brute_hits(text, items, n=10):
    w = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        iw = WORD.findall(lower(t or ""))
        k = min(n, len(iw))
        grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontamination_is_brute_force(spark, most):
    a, b = words(40, 1), words(40, 2)
    items = [(1, " ".join(a)), (2, "Two WORDS"), (3, None), (10, " ".join(a[5:30])), (None, "never seen anywhere at all")]
    texts = [" ".join(b[:5] + a[3:20] + b[5:]), "TWO, words!", "two other words", " ".join(a[:9]), " ".join(a).upper(), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(docs_of(spark, texts), bench, max_broadcast_bytes=most).collect()
    got = {r["row"]["doc_id"]: (r["n_words"], list(r["hits"]), list(r["items"])) for r in found}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontamination_removes_spans_or_documents(spark):
    a = words(12)
    bench = spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")
    docs = docs_of(spark, ["Keep, this. " + " ".join(a) + ". And (this)!", "clean", None, "clean"], [5, 6, 7, 6])
    spans = {(r["doc_id"], r["text"]) for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert spans == {(5, "Keep, this. And (this)!"), (6, "clean"), (7, None)}
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [6, 6, 7]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench, max_broadcast_bytes=0).collect()) == [6, 6, 7]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 4
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


NAMES = ["x.y", "my col", "a-b", "row", "words", "at", "key", "gram", "items", "own", "hits", "uid", "lines", "drop", "node", "home", "first", "n", "slot", "shard", "label"]


def test_columns_of_any_name_pass_through(spark):
    texts = ["some words of a text that is kept here\nand a line", None, "x " * 40]
    docs = docs_of(spark, texts).select("*", *(F.lit(i).alias(c) for i, c in enumerate(NAMES)))
    bench = spark.createDataFrame([(1, "never seen")], "item_id long, text string")
    whole = sorted(map(repr, docs.collect()))
    for remove in ("documents", "spans"):
        left = decontaminate.decontaminate(docs, bench, remove=remove)
        assert left.columns == docs.columns and sorted(map(repr, left.collect())) == whole
    some = [c for c in docs.columns if c != "text"]
    assert [r["row"]["x.y"] for r in decontaminate.scan(docs, bench, carry=some).collect()] == [0] * 3
    for found in (quality.judge(docs), line_dedup.dedup_lines(docs)):
        assert {(r["row"]["x.y"], r["row"]["my col"], r["row"]["row"]) for r in found.collect()} == {(0, 1, 3)}
    assert jaccard.jaccard_join(docs).count() == suffix_dedup.dedup_passages(docs).count() == toxicity.score_documents(docs, toxicity.SentenceModel.fit([], [])).count() == 3
    assert token_counts.count_tokens(docs).count() == packing.pack(docs).count() == 3 and training_order.sequences(docs).count() > 0
    turns = spark.createDataFrame([(1, 0, "ana", "hi")], "conv_id long, turn long, role string, text string").select("*", *(F.lit(i).alias(c) for i, c in enumerate(NAMES)))
    assert chat.rotate(turns).count() == 1


def test_decontamination_of_a_very_long_text(spark):
    long = " ".join(words(400_000, 1)) + " one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, "One, two three four five six seven eight nine TEN!")], "item_id long, text string")
    (r,) = decontaminate.scan(docs_of(spark, [long]), bench).collect()
    assert (r["n_words"], list(r["hits"])) == (400_010, list(range(400_000, 400_010)))


# --- 2 ----------------------------------------------------------------------------------------------------------------


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_repeated_words_are_brute_force(given_words):
    at = {}
    for i in range(len(given_words) - 7):
        at.setdefault(tuple(given_words[i : i + 8]), []).append(i)
    assert quality.n_repeat_words(given_words) == len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_js_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 3.0])) == pytest.approx(1)
    assert quality.js_distance(np.array([1.0, 1]), np.array([2.0, 2])) == 0


def test_quality_verdicts(spark):
    rng = np.random.default_rng(3)
    common = ["the", "of", "and", "to", "in"]
    clean = [" ".join(rng.choice(common + words(400, 9), 150, p=[0.1] * 5 + [0.5 / 400] * 400)) + "." for _ in range(40)]
    junk = " ".join(f"{w}###" for w in words(150, 4))
    loud = " ".join(w.upper() + "!!" for w in words(150, 5))
    found = {r["row"]["doc_id"]: r for r in quality.judge(docs_of(spark, [*clean, junk, loud, *ODD])).collect()}
    assert all(found[i]["kept"] for i in range(40))
    assert not found[40]["kept"] and not found[40]["base_failed"] and not found[41]["kept"]
    assert all(found[i]["base_failed"] for i in range(42, 48))
    assert (found[46]["n_words"], found[46]["n_dup_lines"]) == (21, 2)
    assert quality.judge(docs_of(spark, [])).count() == 0


def test_quality_without_a_reference(spark):
    found = quality.judge(docs_of(spark, [" ".join(words(50))])).first()
    assert found["kept"] and found["char_distance"] is None


# --- 3 ----------------------------------------------------------------------------------------------------------------


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9995), (0.5, 0.9), (0.95, 0.999)):
        bands, rows = jaccard.bands_for(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128


def brute_links(texts, k=5):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    return {(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_join_is_brute_force(spark, block):
    rng = np.random.default_rng(7)
    base, texts = words(120, 11), []
    for n in range(24):
        w = list(base)
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base), " ".join(base).upper() + "!", " ".join(words(120, 12)), "short text", "Short, text", "other short", *ODD, *ODD[3:]]
    links = brute_links(texts)
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(docs_of(spark, texts), block=block, recall=0.99999).collect()}
    assert {i: n for i, (_, n) in found.items()} == {i: sum(a == i for a, _ in links) for i in range(len(texts))}
    heads = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            heads[a] = min(heads[a], heads[b])
    assert {i: c for i, (c, _) in found.items()} == dict(enumerate(heads))


def test_jaccard_join_of_odd_rows(spark):
    text = " ".join(words(30))
    found = jaccard.jaccard_join(docs_of(spark, [text, text, text, None, "alone here"], [4, 4, None, 5, 6])).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == Counter([(4, 4, 2), (4, 4, 2), (None, 4, 2), (5, 5, 0), (6, 6, 0)])
    near = " ".join([*words(30)[:-1], "other"])
    found = jaccard.jaccard_join(docs_of(spark, [text, text, near, near, near], [4, 4, 7, 7, 8]), recall=0.99999).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == Counter([(4, 4, 4), (4, 4, 4), (7, 4, 4), (7, 4, 4), (8, 4, 4)])
    assert jaccard.jaccard_join(docs_of(spark, [])).count() == 0


# --- 4 ----------------------------------------------------------------------------------------------------------------


def brute_passages(rows, width=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - width + 1):
            if any(j is not None and i is not None and j < i and t[at : at + width] in u for j, u in texts):
                gone[at : at + width] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(t), int(gone.sum()), runs, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("width, batches, max_blocks, slab", [(50, 1, 20_000, 1 << 21), (50, 4, 1, 400), (28, 3, 2, 1 << 21), (200, 2, 20_000, 700), (121, 4, 2, 1 << 21)])
def test_passage_removal_is_brute_force(spark, monkeypatch, width, batches, max_blocks, slab):
    monkeypatch.setattr(suffix_dedup, "SLAB", slab)
    monkeypatch.setattr(suffix_dedup, "RANGE", 300)
    p, q = " ".join(words(14, 1)), " ".join(words(9, 2))
    t = [f"{' '.join(words(20, 100 + i))} {p if i % 2 else q[i:]} {' '.join(words(8, 200 + i))}{p[i:] if i % 3 else ''}" for i in range(12)]
    long = " ".join(words(60, 9))
    t += [t[3], t[3][:200], "a" * 130, "b" + "a" * 60, "a" * 49, p + p, "é" * 60, "xé" * 40 + "é" * 40, long, long[:110] + "#" + long[111:], long * 3, *ODD]
    ids = [*range(100, 100 - len(t) + 2, -1), None, 77]
    # Rows of one id are parts of one document.
    t, ids = [*t, long[20:300], t[3][30:], "no"], [*ids, 90, 90, 90]
    expected = sorted(map(repr, brute_passages(list(zip(ids, t)), width)))
    found = suffix_dedup.dedup_passages(docs_of(spark, t, ids), width=width, batches=batches, max_blocks=max_blocks).collect()
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in found) == expected


def test_a_changed_byte_in_a_long_text_stays(spark):
    text = " ".join(words(60, 1))[:400]
    other = text[:110] + "#" + text[111:]
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup_passages(docs_of(spark, [text, other]), width=200).collect()}
    assert found == {0: 0, 1: 289}
    with pytest.raises(ValueError):
        suffix_dedup.dedup_passages(docs_of(spark, [text]), width=27)


@pytest.mark.parametrize("width", [28, 47, 50, 64, 121])
def test_block_hashes_cover_the_block(width):
    rng, seen = np.random.default_rng(width), 0
    for _ in range(300):
        x = rng.integers(97, 123, 2 * width - 20, np.uint8)
        y = x.copy()
        y[rng.integers(0, len(y))] ^= 1
        found = []
        for d in (x, y):
            _, a, b, at = suffix_dedup.anchors(d, np.array([0]), width)
            found.append(dict(zip(zip(a, b, at), suffix_dedup.block_hashes(d, at, a, b, width)[1])))
        for a, b, at in found[0].keys() & found[1].keys():
            same = bytes(x[a : b + width]) == bytes(y[a : b + width])
            assert (found[0][a, b, at] == found[1][a, b, at]) == same
            seen += not same
    assert seen


@pytest.mark.parametrize("n", [0, 1, 200, 201, 5000])
def test_packed_suffixes_come_back(n):
    rng = np.random.default_rng(n)
    columns = [np.sort(rng.integers(0, 2**64, n, np.uint64)), *(rng.integers(0, 2 if k is np.bool_ else np.iinfo(k).max, n, np.uint8 if k is np.bool_ else k).astype(k) for k in suffix_dedup.FIELDS[1:])]
    back = suffix_dedup._unpack(suffix_dedup._pack(columns))
    assert all((a == b).all() and b.dtype == k for a, b, k in zip(columns, back, suffix_dedup.FIELDS))


def test_suffix_arrays_are_in_text_order():
    data = "".join(words(300, 5)).encode()
    _, _, _, at = suffix_dedup.anchors(np.frombuffer(data, np.uint8), np.array([0]), 50)
    key = suffix_dedup._order_key(np.frombuffer(data, np.uint8), at)
    assert [data[i : i + 20] for i in at[np.lexsort(key[::-1])]] == sorted(data[i : i + 20] for i in at)


def test_passage_removal_of_nothing(spark):
    assert suffix_dedup.dedup_passages(docs_of(spark, [])).count() == 0


def test_texts_longer_than_a_slab(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLAB", 128)
    data = "".join(words(300, 5)).encode()
    whole = [(i, a, b) for i, d, s, o in suffix_dedup._slabs([1], [data], 50) for _, a, b, _ in zip(*suffix_dedup.anchors(d, s, 50)) for a, b in [(a + o[0], b + o[0])]]
    assert sorted(x for _, a, b in whole for x in range(a, b + 1)) == list(range(len(data) - 49))


# --- 5 ----------------------------------------------------------------------------------------------------------------

PIECES = {tuple(b"a"), tuple(b"b"), tuple(b"c"), tuple(b"ab"), tuple(b"abc"), tuple(b"bca"), (*b"ca", 256), (*b"c", 256), (*b"abcab", 256)}


def greedy(word, pieces):
    s, i, n = (*word, 256), 0, 0
    while i < len(word):
        size = next((k for k in range(len(s) - i, 0, -1) if s[i : i + k] in pieces), 0)
        if not size:
            return 1
        i, n = i + size, n + 1
    return n


@given(st.binary(max_size=12).map(lambda b: bytes(97 + x % 4 for x in b)))
@settings(max_examples=500, deadline=None)
def test_automaton_counts_greedy_pieces(word):
    assert token_counts.LongestMatch(PIECES).count(word) == (greedy(word, PIECES) if word else 0)


def test_token_counts_of_odd_rows(spark):
    pieces = token_counts.vocabulary(tokens.tokenizer_path("word_bpe_49k.json"))
    found = {r["doc_id"]: r for r in token_counts.count_tokens(docs_of(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        w = re.findall(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20]", (t or "").encode().lower())
        assert (found[i]["n_words"], found[i]["n_tokens"]) == (len(w), sum(greedy(x, pieces) for x in w)), t
    assert token_counts.count_tokens(docs_of(spark, [])).count() == 0


def test_cache_keeps_what_a_batch_needs():
    cache = common.ChunkCache(lambda chunks: [c * 2 for c in chunks], limit=3)
    for some in ({b"a", b"b", b"c", b"d", b"e"}, {b"a", b"x"}, {b"y"}, {b"a", b"z", b"q"}):
        have = cache.have(some)
        assert {c: have[c] for c in some} == {c: c * 2 for c in some}


# --- 6 ----------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_sentences_from_document_labels():
    rng = np.random.default_rng(1)
    vocab, texts, labels = words(60, 3), [], []
    for i in range(400):
        s = [" ".join(rng.choice(vocab, 7)) for _ in range(6)]
        if i % 4 == 0:
            s[rng.integers(0, 6)] += " " + ["villain", "scoundrel"][i % 8 // 4]
        texts.append((". ".join(s) + ".").encode())
        labels.append(int(i % 4 == 0))
    model = toxicity.SentenceModel.fit(texts[:300], labels[:300])
    scored = [model.score(t) for t in texts[300:]]
    assert [int(s >= 0.5) for s, _ in scored] == labels[300:]
    for t, (_, bad), y in zip(texts[300:], scored, labels[300:]):
        assert len(bad) == y and all(b"villain" in t[a:b] or b"scoundrel" in t[a:b] for a, b, _ in bad)
    assert 0 < model.score(b"")[0] < 0.5


def test_toxicity_scores_are_the_noisy_or_of_sentences():
    rng = np.random.default_rng(4)
    weights = {b"bad$": 2.5, b"awful$": 1.5, b"terri": 0.7, b"mild$": -1.0}
    model = toxicity.SentenceModel(-3.0, weights)
    vocab = ["bad", "awful", "terrible", "terrify", "mild", "plain", "words", "of", "a", "text"]
    for _ in range(50):
        text = ". ".join(" ".join(rng.choice(vocab, rng.integers(0, 9))) for _ in range(rng.integers(0, 12)))
        clean, found = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", text):
            z = -3.0 + sum(weights.get(f, 0) for w in set(m[0].split()) for f in (w.encode() + b"$", *(w[:n].encode() for n in (5, 6, 7, 8) if len(w) >= n)))
            p = 1 / (1 + math.exp(-z))
            clean *= 1 - p
            found += [m.span()] * (p >= 0.5)
        if not re.search(r"[^.!?\n]", text):
            clean = 1 - 1 / (1 + math.exp(3.0))
        score, bad = model.score(text.encode())
        assert score == pytest.approx(1 - clean) and [(a, b) for a, b, _ in bad] == found


def test_toxicity_sample_is_bounded_in_bytes(spark):
    docs = docs_of(spark, ["x" * 100 for _ in range(40)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    all_ = toxicity.training_sample(docs, labels).count()
    assert toxicity.training_sample(docs, labels, max_bytes=1050).count() == 10 < all_
    assert toxicity.training_sample(docs, labels, most=7).count() == 7
    with pytest.raises(ValueError, match="no labelled document"):
        toxicity.training_sample(docs, labels, max_bytes=50)


def test_toxicity_sample_passes_over_what_does_not_count(spark):
    # Documents longer than all bytes, one of them first by hash in some seed, and labels of documents that aren't there.
    docs = docs_of(spark, ["x" * (5000 if i < 20 else 100) + str(i) for i in range(40)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(1000 + i, 1, 1) for i in range(3000)], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(docs, labels, most=100, max_bytes=2000).collect()
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20, 40)) and all(len(r["text"]) < 200 for r in sample)
    assert 0 < toxicity.training_sample(docs, labels, most=12, max_bytes=12_000).count() <= 12


def test_toxicity_sample_and_scores(spark):
    docs = docs_of(spark, ["bad day.", None, "bad day.", "fine"], [1, 2, 1, None])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, None), (9, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(docs, labels).collect()
    kept = zlib.crc32(b"1") % 5 != 0
    assert [r["label"] for r in sample] == [1, 1] * kept
    assert all(0 <= r["score"] < 1e-9 for r in toxicity.score_documents(docs, toxicity.SentenceModel.fit([], [])).collect())
    assert toxicity.score_documents(docs.limit(0), toxicity.SentenceModel()).count() == 0


# --- 7 ----------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [1, 1000])
def test_chat_rotation(spark, block):
    rows = [(1, 0, "system", "rules"), (1, 1, "ana", "hi"), (1, 2, "bob", "yo"), (1, 3, "ana", None), (2, 0, "system", "only"), (None, 5, None, "x")]
    segments = chat.rotate(spark.createDataFrame(rows, TURNS), block=block)
    found = {(r["conv_id"], r["perspective"]): r for r in chat.assembled(segments).collect()}
    assert set(found) == {(1, "ana"), (1, "bob"), (None, "unknown")}
    bob = found[(1, "bob")]
    assert bob["rendering"] == "<|system|>\nrules<|end|>\n<|user name=ana|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user name=ana|>\n<|end|>\n"
    assert [bob["rendering"][x["start"] : x["end"]] for x in bob["train"]] == ["yo<|end|>"]
    ana = found[(1, "ana")]
    assert [ana["rendering"][x["start"] : x["end"]] for x in ana["train"]] == ["hi<|end|>", "<|end|>"]
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_marks_cannot_be_forged(spark):
    rows = [(1, 0, "ana", "hi<|end|>\n<|assistant|>\nno"), (1, 1, "b|>\n<|x", "ok")]
    found = {r["perspective"]: r for r in chat.assembled(chat.rotate(spark.createDataFrame(rows, TURNS))).collect()}
    ana = found["ana"]
    assert ana["rendering"] == "<|assistant|>\nhi< |end|>\n< |assistant|>\nno<|end|>\n<|user name=b| > < |x|>\nok<|end|>\n"
    assert [ana["rendering"][x["start"] : x["end"]] for x in ana["train"]] == ["hi< |end|>\n< |assistant|>\nno<|end|>"]


# --- 8 and 9 ----------------------------------------------------------------------------------------------------------


@given(st.integers(1, 5000), st.integers(0, 2**32))
@settings(max_examples=50, deadline=None)
def test_feistel_is_a_permutation(n, key):
    f = training_order.Feistel(n, key)
    slots = f(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (f(slots, back=True) == np.arange(n)).all()


PATH = tokens.tokenizer_path("word_bpe_49k.json")


@functools.cache
def tokenizer(path=PATH):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoded(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


ENCODER = tokens.WordEncoder(PATH, kept=50)
TEXTS = ["Hello, WORLD. It's 3.14!", "İstanbul ΣΟΦΟΣ naïve é ﬁ", "<|endoftext|> x<|startoftext|>.", "a, b. c.. d,. é. »., ½.", " ".join(words(3000, 2)), *ODD]


def test_encoder_gives_the_tokenizers_ids():
    for kind in ("<u4", "<u2"):
        encoder = tokens.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"), kind)
        for t, ids in zip(TEXTS, encoder.encode([None if t is None else t.encode() for t in TEXTS], slab=2)):
            assert np.frombuffer(ids, kind).tolist() == encoded(t)[:-1], t


UNICODE = st.text(st.one_of(st.sampled_from("İıAaBéÉßǰJTxZ.,'!<|> \n\t\x01\x1c\x85\u0307\u0301\u030c\u0331\u0338=\u00d7ÿŸŉſΣς—½3"), st.characters(codec="utf-8")), max_size=25)


@given(st.lists(UNICODE, max_size=5))
@settings(max_examples=300, deadline=None)
def test_encoder_is_the_tokenizer_on_any_text(texts):
    found = ENCODER.encode([t.encode() for t in texts], slab=20)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [encoded(t)[:-1] for t in texts]


def test_encoder_of_long_texts_and_few_kept_segments():
    texts = [*TEXTS, "İ. İ, aİ. BAKİ.", "J\u030c. T\u0308 W\u030a", "it's 'S a's,", "<|STARTOFTEXT|> <|endoftext|>X", "é,—,a—b ÷É×", None, " ".join(words(4000, 8)), "x" * 5000]
    encoder = tokens.WordEncoder(PATH, "<u2", kept=10)
    for _ in range(2):
        for t, ids in zip(texts, encoder.encode([None if t is None else t.encode() for t in texts], slab=3000)):
            assert np.frombuffer(ids, "<u2").tolist() == encoded(t)[:-1], t


def test_encoder_of_other_tokenizers():
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    for t, ids in zip(TEXTS, tokens.WordEncoder(path).encode([None if t is None else t.encode() for t in TEXTS])):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer(path).encode(t or "", add_special_tokens=False).ids
    with pytest.raises(ValueError):
        tokens.WordEncoder(path, "u1")


def test_shards_hold_every_sequence_in_its_slot(spark, tmp_path):
    texts = [*TEXTS, "twin", "twin", "no id at all " * 30]
    ids = [*range(len(TEXTS)), 99, 99, None]
    docs = docs_of(spark, texts, ids).repartition(3)
    path = str(tmp_path / "shards")
    placed, total = training_order.training_order(training_order.sequences(docs, length=16), key=5, per_shard=7)
    training_order.write_shards(placed, total, path, 7)
    rows = training_order.read_shards(spark, path, length=16, per_shard=7).orderBy("slot").collect()
    assert total == len(rows) and [r["slot"] for r in rows] == list(range(total)) and all((r["shard"], r["record"]) == divmod(r["slot"], 7) and len(r["ids"]) == 32 for r in rows)
    # The slots are the permutation of the indexes, partition by partition: undone, the ids are those of the documents in a row.
    back = training_order.Feistel(total, 5)(np.arange(total), back=True)
    rows = [rows[s] for s in np.argsort(back)]
    joined = [x for r in rows for x in np.frombuffer(bytes(r["ids"]), "<u2")[: r["n_tokens"]].tolist()]
    cut, found = 0, Counter()
    while cut < len(joined):
        end = joined.index(1, cut) + 1
        found[tuple(joined[cut:end])] += 1
        cut = end
    assert found == Counter(tuple(encoded(t)) for t in texts)
    by_id = {i: encoded(t) for i, t in zip(ids, texts)}
    for r in rows:
        own = by_id[r["doc_id"]][r["start"] : r["start"] + r["n_tokens"]]
        assert own and np.frombuffer(bytes(r["ids"]), "<u2")[: len(own)].tolist() == own
    assert sum(r["n_tokens"] < 16 for r in rows) <= docs.rdd.getNumPartitions()


def test_shards_are_read_by_seeking(spark, tmp_path):
    path = str(tmp_path / "shards")
    docs = docs_of(spark, [" ".join(words(200, 1)), None])
    placed, total = training_order.training_order(training_order.sequences(docs, length=16), key=5, per_shard=7)
    training_order.write_shards(placed, total, path, 7)
    rows = {r["slot"]: r for r in training_order.read_shards(spark, path, length=16, per_shard=7).collect()}
    assert {r["slot"] for r in training_order.read_shards(spark, path, length=16, per_shard=7, after=9).collect()} == set(range(10, total))
    # A record's place is known without reading what is before it; shards before it may be gone.
    size = training_order.stride(16)
    assert [p.stat().st_size for p in sorted((tmp_path / "shards" / "shard=1").glob("part-*"))] == [7 * size]
    (file,) = (tmp_path / "shards" / "shard=1").glob("part-*")
    with open(file, "rb") as f:
        f.seek(3 * size + struct.calcsize(training_order.HEAD))
        assert f.read(32) == bytes(rows[10]["ids"])
    (gone,) = (tmp_path / "shards" / "shard=0").glob("part-*")
    gone.write_bytes(b"broken")
    assert {r["slot"]: r for r in training_order.read_shards(spark, path, length=16, per_shard=7, after=9).collect()} == {s: r for s, r in rows.items() if s > 9}
    placed, total = training_order.training_order(training_order.sequences(docs.limit(0)), key=1)
    training_order.write_shards(placed, total, str(tmp_path / "none"))
    assert total == 0 and training_order.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_packing_keeps_every_id_once(spark):
    ids = [*range(len(TEXTS)), 98, None]
    texts = [*TEXTS, "more words " * 700, "no id"]
    rows = packing.pack(docs_of(spark, texts, ids), pool=4, with_ids=True).collect()
    assert_packed(rows, dict(zip(ids, texts)))
    assert packing.pack(docs_of(spark, [])).count() == 0


def assert_packed(rows, texts):
    docs, sequences = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(docs) == set(texts)
    for i, pieces in docs.items():
        pieces.sort(key=lambda r: r["start"])
        joined = b"".join(bytes(r["ids"]) for r in pieces)
        assert np.frombuffer(joined, "<u4").tolist() == encoded(texts[i])
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces[:-1])]).tolist() and {r["doc_tokens"] for r in pieces} == {len(joined) // 4}
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces[:-1])]).tolist() and sum(r["length"] for r in pieces) <= 2048


@given(st.lists(st.integers(1, 5000), max_size=60))
@settings(max_examples=100, deadline=None)
def test_packer_fills_all_windows_but_one(sizes):
    packer, windows = packing.Packer(pool=8), []
    for i, n in enumerate(sizes):
        windows += packer.add(i, bytes(4 * n))
    windows += packer.flush()
    held = [sum(len(p[2]) // 4 for p in w) for _, w in windows]
    assert sum(held) == sum(sizes) and sum(h < t for h, (t, _) in zip(held, windows)) <= 1
    grouped = list(packing._grouped(iter(windows), 16384))
    assert sum(t for _, t, _ in grouped) == sum(t for t, _ in windows)
    budgets = Counter()
    for g, t, _ in grouped:
        budgets[g] += t
    assert max(budgets.values(), default=0) <= 16384 and math.ceil(sum(budgets.values()) / 16384) == len(budgets)


# --- 10 ---------------------------------------------------------------------------------------------------------------


def brute_lines(rows, min_chars=20, min_docs=3):
    space = "\t\n\x0b\x0c\r "
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: lower(line.strip(space))
    holders = {}
    for n, (i, lines) in enumerate(split):
        for k in {key(x) for x in lines if len(key(x)) >= min_chars}:
            holders.setdefault(k, {})[("row", n) if i is None else i] = i
    holders = {k: list(v.values()) for k, v in holders.items()}
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, lines in split:
        kept = [x for x in lines if not (i is not None and last.get(key(x)) is not None and i < last[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup_is_brute_force(spark, batches):
    shared, short = "A line that Many documents share", "short shared"
    texts = [f"{shared}\nown {i} text of some length here\n  {shared.upper()}\t\n{short}\n" for i in range(5)]
    texts += [shared, f"{shared}\n{shared}", "x\n" + "ÀÉ line beyond ascii, twice here\n" * 2, "ÀÉ line beyond ascii, twice here", *ODD, shared, shared]
    ids = [*range(20, 20 + len(texts) - 3), 3, 3, None]
    found = line_dedup.dedup_lines(docs_of(spark, texts, ids), batches=batches).collect()
    got = sorted(map(repr, ((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in found)))
    assert got == sorted(map(repr, brute_lines(list(zip(ids, texts)))))
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    line = "a line that is long enough to count"
    for ids, gone in (([1, 1, 2], 0), ([1, 1, 2, 3], 3)):
        found = line_dedup.dedup_lines(docs_of(spark, [f"{line}\n{i}" for i in range(len(ids))], ids)).collect()
        assert sum(r["n_dropped"] for r in found) == gone and sum(r["n_dropped"] for r in found if r["row"]["doc_id"] == max(ids)) == 0


def test_line_runs_merge_geometrically(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"))
    for n in range(5):
        batch = spark.range(n, n + 4).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(n).cast("long").alias("doc"))
        assert sorted(r["h1"] for r in runs.novel(batch).collect()) == (list(range(4)) if n == 0 else [n + 3])
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1] and len(runs.counts) == 4
    own = [r["h1"] for name in runs.runs() for r in spark.table(name).collect()]
    assert sorted(own) == list(range(8))
    assert {r["h1"]: (r["n_docs"], r["last_doc"]) for r in runs.merged().collect()}[3] == (4, 3)
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_line_runs_are_merged_without_shuffle_or_sort(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"))
    batch = lambda a, b: spark.range(a, b).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("long").alias("doc")).repartition(3)
    runs.add(batch(0, 500))
    name = runs._save(batch(400, 900).groupBy(*line_dedup.KEY).count())
    with line_dedup._in_order(spark):
        plan = runs.novel(spark.table(name))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, plan
    runs.drop()


def test_hashes_of_kept_text(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.sql("select sha2('', 256)").first()[0]
