"""Filter audit, ball k-means and best-fit packing against brute force, with odd rows."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamis.llm import ball_kmeans as bk
from tamis.llm import best_fit as bf
from tamis.llm import filter_audit as fa
from tamis.llm.tokens import tokenizer_path

# --- filter audit ---------------------------------------------------------------------------------------------------------


def fails(docs, i):
    doc_id, text = docs[i]["doc_id"], docs[i]["text"] or ""
    words = [w for w in text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    found = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
    found["E"] = doc_id is not None and any(d["doc_id"] is not None and d["doc_id"] < doc_id and (d["text"] or "") == text for d in docs)
    return found


def brute_audit(docs, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    failing, rows = [fails(docs, i) for i in range(len(docs))], []
    for part in {d["source"] or "" for d in docs}:
        own = [i for i, d in enumerate(docs) if (d["source"] or "") == part]
        played = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if failing[i][f]]
                redundant = sum(failing[i][f] for i in own) - len(gone)
                left = [i for i in left if not failing[i][f]]
                unique = sum(failing[i][f] and sum(failing[i].values()) == 1 for i in own)
                played.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(docs[i]["doc_id"] in good for i in gone), sum(docs[i]["doc_id"] in toxic for i in gone)))
        total = Counter()
        for r in played:
            total[r[1][r[2] - 1]] += r[4]
        rows += [(*r, total[r[1][r[2] - 1]]) for r in played]
    return sorted(rows)


PROSE = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, PROSE, "a"), (2, PROSE, "a"), (2, PROSE, "b"), (3, PROSE + " $", None), (3, None, ""), (4, "", "a"), (None, "", "a"), (None, PROSE, None),
    (5, "LOUD " * 60, "b"), (6, "loud " * 60, "b"), (6, "loud " * 60, "b"), (7, "\x0b\x0c\n", "c"), (8, "é" * 40 + " A", "c"), (9, "a b " * 55, "c"), (10, "x" * 10, None), (11, PROSE.replace(" ", "\n"), "a"),
    (12, " ".join(f"w{i % 65}" for i in range(100)), "edge"), (13, " ".join(f"w{i % 64}" for i in range(100)), "edge"), (14, "A" + "b" * 19, "edge"), (15, "AB" + "b" * 19, "edge"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 1)]


def test_audit_equals_playing_out_every_order(spark):
    docs = spark.createDataFrame([(*d, 7, "k") for d in DOCS], "doc_id long, text string, source string, mask int, key string").repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = sorted(tuple(r) for r in fa.audit(docs, labels).collect())
    assert found == brute_audit([dict(zip(("doc_id", "text", "source"), d)) for d in DOCS], [dict(zip(("doc_id", "quality", "toxic"), x)) for x in LABELS])
    assert {r[0] for r in found} == {"", "a", "b", "c", "edge"}


def test_audit_of_no_documents_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, PROSE, "a")], none.schema)
    assert {tuple(r)[3:] for r in fa.audit(one, labels).collect()} == {(1, 0, 0, 0, 0, 0, 0)}


def test_mask_of_a_very_long_text():
    text = b"Word and word " * 400_000 + b"$"
    assert fa.text_mask(text) == 0b1110
    assert fa.text_mask(b"x" * (3 * fa.SLICE)) == 0b0001
    assert fa.text_mask("é".encode() * fa.SLICE + b" A" * 60) == 0b0010


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=8, max_size=8))
def test_polynomial(counts):
    p = fa.RemovalPolynomial(counts)
    removes = lambda s: sum(n for m, n in enumerate(counts) if m & s)
    assert p.corners() == [removes(s) for s in range(8)]
    assert p.corners() == [p.at([s >> i & 1 for i in range(3)]) for s in range(8)]
    half = sum(Fraction(removes(s), 8) for s in range(8))
    assert p.at([Fraction(1, 2)] * 3) == half
    for i in range(3):
        orders = [(removes(sum(1 << j for j in o[: o.index(i) + 1])) - removes(sum(1 << j for j in o[: o.index(i)]))) for o in permutations(range(3))]
        assert p.shapley(i) == Fraction(sum(orders), 6)


# --- ball k-means ---------------------------------------------------------------------------------------------------------


def lloyd(rows, k=8, rounds=10, seed=3, dims=64):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dims and all(y is not None and np.isfinite(y) for y in x):
            kept.append((vec_id, [int(np.floor(1024 * float(np.float32(y)))) for y in x]))
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


def vectors(n, spread, seed, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(i, [float(x) for x in np.float32(centres[i % 5] + spread * rng.normal(size=dims))]) for i in range(n)]


@pytest.mark.parametrize(("spread", "rehome"), [(0.05, 0.1), (0.6, 0.1), (3.0, 0.0), (3.0, 1.0)])
def test_ball_kmeans_equals_lloyd(spark, spread, rehome):
    rows = vectors(300, spread, int(spread * 100))
    rows += [(300 + i, rows[0][1]) for i in range(60)] + [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1])]
    odd = [(400, None), (401, rows[0][1][:63]), (402, [*rows[0][1], 0.0]), (403, [*rows[0][1][:63], None]), (404, [*rows[0][1][:63], float("nan")]), (405, [*rows[0][1][:63], float("-inf")]), (None, None)]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows + odd], "vec_id long, embedding array<float>, home int, cluster int").repartition(6)
    found = bk.ball_kmeans(bk.usable(df), rehome=rehome)
    members, centroids = lloyd(rows)
    assert found.centroids == centroids
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.members.collect()), key=repr) == members
    if spread < 0.1:
        assert found.distances < 0.5 * 8 * 10 * len(rows)  # balls far apart: few comparisons


def test_ball_kmeans_ties_and_small_tables(spark):
    # On a line of whole steps many members lie at exactly half the way between two centroids.
    rows = [(i, [float(i % 9)] * 2 + [0.0] * 62) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = bk.ball_kmeans(bk.usable(df))
    members, centroids = lloyd(rows)
    assert found.centroids == centroids and sorted((tuple(r) for r in found.members.collect()), key=repr) == members
    few = spark.createDataFrame(rows[:3] + rows[:1], df.schema)
    found = bk.ball_kmeans(bk.usable(few))
    members, centroids = lloyd(rows[:3] + rows[:1])
    assert found.centroids == centroids and sorted((tuple(r) for r in found.members.collect()), key=repr) == members
    assert bk.ball_kmeans(bk.usable(df.limit(0))).members.count() == 0
    with pytest.raises(Exception, match="beyond"):
        bk.ball_kmeans(bk.usable(spark.createDataFrame([(1, [1e9] + [0.0] * 63)], df.schema)))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_assign_from_any_home(seed):
    rng = np.random.default_rng(seed)
    v, centroids = rng.integers(-6, 7, (40, 3)), rng.integers(-6, 7, (5, 3))
    home = rng.integers(0, 5, 40).astype(np.int32)
    cluster, distance, _ = bk.assign(v, home, centroids, bk.between(centroids))
    assert cluster.tolist() == bk.nearest(v, centroids).tolist()
    assert distance.tolist() == [int(((x - centroids[c]) ** 2).sum()) for x, c in zip(v, cluster)]


# --- best-fit packing -----------------------------------------------------------------------------------------------------


def one_by_one(lengths, capacity):
    """Best-two-fit over single pieces: the lengths of each sequence."""
    left, out = sorted(lengths), []

    def fill(bin_, gap):
        while fits := [n for n in left if n <= gap]:
            bin_.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        return gap

    while left:
        bin_ = []
        gap = fill(bin_, capacity)
        while gap and len(bin_) > 1:
            s = min(bin_)
            pairs = [(left[i] + left[j], left[j], left[i]) for j in range(len(left)) for i in range(j) if s < left[i] + left[j] <= gap + s]
            if not pairs:
                break
            _, a, b = max(pairs)
            left.remove(a), left.remove(b), bin_.remove(s)
            bin_ += [a, b]
            left.append(s)
            left.sort()
            gap = fill(bin_, gap + s - a - b)
        out.append(sorted(bin_, reverse=True))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 60))
def test_plan_equals_packing_piece_by_piece(lengths, capacity):
    plan = bf.Plan(Counter(lengths), capacity)
    assert [[n for n, k in taken for _ in range(k)] for times, taken in plan.patterns for _ in range(times)] == one_by_one(lengths, capacity)
    # Every place of every length is in exactly one range.
    have = Counter()
    for times, taken in plan.patterns:
        for n, k in taken:
            have[n] += times * k
    assert have == Counter(lengths)


def test_two_fit_more_tightly():
    # Greedily 6 + 3 leaves one; 2 + 2 fill what 3 leaves.
    assert [t for _, t in bf.Plan(Counter([6, 3, 3, 2, 2]), 10).patterns][0] == [(6, 1), (2, 2)]
    uniform = np.random.default_rng(1).integers(1, 4097, 100_000)
    plan = bf.Plan(dict(zip(*(x.tolist() for x in np.unique(uniform, return_counts=True)))))
    assert sum(t for t, _ in plan.patterns) <= 1.002 * max(uniform.sum() / 4096, (uniform > 2048).sum())


def check_packing(pieces, texts, capacity, tokenizer):
    """pieces: rows of OUT; texts by doc_id."""
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        own.sort(key=lambda r: r["start"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        assert [r["length"] for r in own] == [min(capacity, len(ids) - s) for s in range(0, len(ids), capacity)]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq)


def test_best_fit_places_every_id_once(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = {i: " ".join(f"w{j}" for j in range(i % 37)) for i in range(400)} | {1000: None, 1001: "", 1002: "long words " * 3000, 1003: "x" * 200_000, None: "no id"}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, length int, share string").repartition(7)
    for capacity in (64, 4096):
        packed = bf.best_fit(df, capacity=capacity, with_ids=True)
        found = packed.collect()
        n = check_packing(found, texts, capacity, tokenizer)
        assert n <= 1 + 1.01 * sum(r["length"] for r in found) / capacity
        whole = {r["sequence_id"]: (r["length"], bytes(r["ids"])) for r in bf.sequences(packed).collect()}
        assert all(whole[r["sequence_id"]][1][4 * r["offset"] :][: 4 * r["length"]] == bytes(r["ids"]) for r in found) and all(4 * n == len(b) for n, b in whole.values())


def test_best_fit_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "same text here")] * 500 + [(2, "same text here")], "doc_id long, text string").repartition(9)
    found = bf.best_fit(df, capacity=16).collect()
    assert len(found) == 501 and Counter(r["doc_id"] for r in found) == {1: 500, 2: 1}
    size = found[0]["length"]
    assert Counter(r["sequence_id"] for r in found).most_common(1)[0][1] == 16 // size and len({(r["sequence_id"], r["offset"]) for r in found}) == 501
    assert bf.best_fit(df.limit(0)).count() == 0


def test_best_fit_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    found = bf.op13_best_fit(spark, "/root/testdata/sf0.001").collect()
    n = check_packing(found, {r["doc_id"]: r["text"] for r in docs.collect()}, 4096, tokenizer)
    assert n <= 1 + -(-sum(r["length"] for r in found) // 4096)
