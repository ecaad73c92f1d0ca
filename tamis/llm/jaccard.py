"""Operator 3, n-gram Jaccard join by MinHash banding.

Texts become sets of word shingles. Texts of the same words are one class from the start (the same shingles), counted,
never paired. Each class gets a MinHash signature whose bands and rows are chosen for the target recall; classes that
share a band are a bucket of candidates, tied to the least class of the bucket (a row for each member, not for each
pair). A class's home is the least of these over its buckets; homes of many classes are split into blocks of about
`block`. Two blocks are compared, once, where some bucket has members in both: a group of rows holds the full shingle
sets of two blocks, whose similarities are one matrix product. So a task holds two blocks at most however large a bucket
is, pairs exist as matrix cells only, no candidate is left out, and a chain of buckets costs what its buckets cost, not
the square of its length. Classes whose similarity reaches the threshold are linked; linked classes form a group.

Cases: null, empty and word-less texts have no shingles and stay alone, without links; a text of 1 to `k`-1 words is one
shingle of all its words; repeated rows and repeated ids are rows of the same class; a null doc_id takes part and keeps
its row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import col, partitions, remove_path, stored
from tamis.operators.components import components

#: ASCII letters and digits and all beyond ASCII are word characters; A-Z count as a-z.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands find a pair at the threshold with the recall, in `most` hashes."""
    best = None
    for rows in range(1, most + 1):
        s = threshold**rows
        bands = 1 if s >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-s))
        if bands * rows <= most:
            best = bands, rows
    if not best:
        raise ValueError("no banding reaches this recall")
    return best


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of each run of k words; not yet distinct."""
    from xxhash import xxh3_64_intdigest

    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_WORDS).split()


def _signer(k: int, bands: int, rows: int):
    def run(batches):
        from xxhash import xxh3_128_digest

        draw = np.random.default_rng(20240229)
        a = draw.integers(1, 2**32, (bands * rows, 1), np.uint32) | np.uint32(1)
        b = draw.integers(0, 2**32, (bands * rows, 1), np.uint32)
        mix = draw.integers(1, 2**63, rows, np.uint64) | np.uint64(1)
        for batch in batches:
            nodes, signs, lengths = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                if not words:
                    nodes.append(None)
                    signs.append(None)
                    continue
                nodes.append(xxh3_128_digest(b" ".join(words)))
                h = (shingles(words, k) >> np.uint64(32)).astype(np.uint32)
                low = None
                for at in range(0, len(h), 2048):
                    part = (h[at : at + 2048] * a + b).min(axis=1)
                    low = part if low is None else np.minimum(low, part)
                sign = ((low.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * mix).sum(axis=1)
                signs.append((sign ^ (sign >> np.uint64(31))).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(nodes, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], ["doc", "key", "node", "bands"])

    return run


def _sets(k: int):
    """Candidate classes with their distinct shingles, as bytes."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets, good, had = [], [], set()
            for text, node in zip(batch.column("text").to_pylist(), batch.column("node").to_pylist()):
                # Rows that repeat an id and text come here more than once, in one partition.
                words = [] if node in had else words_of(text)
                good.append(node not in had and xxh3_128_digest(b" ".join(words)) == node)
                if good[-1]:
                    had.add(node)
                sets.append(np.unique(shingles(words, k)).tobytes())
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("home", "own", "node", "copies")), pa.array(sets, pa.binary())], ["home", "own", "node", "copies", "set"])
            yield out.filter(pa.array(good, pa.bool_()))

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common part of each left and each right set: products of 0/1 matrices, a slice of shingles at a time."""
    n, m = len(left), len(right)
    values = np.concatenate([*left, *right]) if n + m else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n + m), [len(s) for s in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.empty(len(values), bool)
    first[:1] = True
    first[1:] = values[1:] != values[:-1]
    column = np.cumsum(first) - 1
    # Shingles of one set only can't be common.
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((n, m), np.float32)
    width = 4096
    for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        ones = np.zeros((n + m, width), np.float32)
        ones[owner[lo:hi], column[lo:hi] - at] = 1
        out += ones[:n] @ ones[n:].T
    return out


#: Two blocks that are compared.
PAIR = ["home_a", "own_a", "home_b", "own_b"]


def _verifier(threshold: float):
    def group(rows: list[tuple]) -> tuple[list, list]:
        """rows (side, node, copies, set) of one pair of blocks -> ([node, links], [node, node])."""
        left, right = (list({r[1]: r for r in rows if r[0] == side}.values()) for side in (0, 1))
        own = not right
        right = left if own else right
        a, b = ([np.frombuffer(r[3], np.uint64) for r in side] for side in (left, right))
        common = _overlaps(a, b)
        la, lb = (np.array([len(s) for s in side], np.float32) for side in (a, b))
        linked = common >= np.float32(threshold) * (la[:, None] + lb[None, :] - common) - 1e-3
        if own:
            np.fill_diagonal(linked, False)
        counts: dict[bytes, int] = {}
        ca, cb = (np.array([r[2] for r in side], np.int64) for side in (left, right))
        for nodes, n in ((left, linked @ cb), *(() if own else ((right, linked.T @ ca),))):
            for r, x in zip(nodes, n.tolist()):
                if x:
                    counts[r[1]] = counts.get(r[1], 0) + x
        # A spanning forest of the links is enough for the components.
        parent: dict[bytes, bytes] = {}

        def top(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        ties = []
        for i, j in zip(*np.nonzero(linked)):
            x, y = top(left[i][1]), top(right[j][1])
            if x != y:
                parent[max(x, y)] = min(x, y)
                ties.append((left[i][1], right[j][1]))
        return list(counts.items()), ties

    def run(batches):
        names = ["node", "links", "other"]
        pack = lambda counts, ties: pa.RecordBatch.from_arrays([pa.array([*(c[0] for c in counts), *(t[0] for t in ties)], pa.binary()), pa.array([*(c[1] for c in counts), *([None] * len(ties))], pa.int64()), pa.array([*([None] * len(counts)), *(t[1] for t in ties)], pa.binary())], names)
        key, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in PAIR))
            for k, *r in zip(keys, *(batch.column(c).to_pylist() for c in ("side", "node", "copies", "set"))):
                if k != key and rows:
                    yield pack(*group(rows))
                    rows = []
                key = k
                rows.append(r)
        if rows:
            yield pack(*group(rows))

    return run


def row_key(doc: str, text: str) -> Column:
    """Tells rows of one id by their texts."""
    return F.xxhash64(col(doc), col(text))


def jaccard_join(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.9995, block: int = 256, with_rows: bool = False) -> DataFrame:
    """(doc_id, class_id, n_links): for each document the least doc_id of its group of linked texts, and
    the number of other documents whose similarity with it reaches the threshold, copies included.

    with_rows: and `key`, the row's `row_key`, and `first`, whether the row has its group's least (doc_id, key); rows
    without words are the first of their own, those without an id are never the first of a group."""
    bands, rows = bands_for(threshold, recall)
    given = docs.select(col(doc).cast("long").alias("doc"), row_key(doc, text).alias("key"), col(text).cast("string").cast("binary").alias("text"))
    signed = stored(given.mapInArrow(_signer(k, bands, rows), "doc long, key long, node binary, bands array<long>"), "signatures")
    done: list[str] = []
    # One row per class of equal words. Copies have equal bands, so any of them will do; the key leads back to one text.
    classes = signed.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("key"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes", done)

    cells = classes.select("node", F.posexplode("bands").alias("band", "h"))
    # Stored, so that the join has plain shuffles on both sides and a bucket of very many classes can be split.
    buckets = stored(cells.groupBy("band", "h").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "buckets", done)
    ties = stored(cells.join(buckets, ["band", "h"]).select("node", "band", "h", "hub"), "ties", done)
    homes = stored(ties.groupBy("node").agg(F.min("hub").alias("home")), "homes", done)
    # Few homes are larger than a block; only these are split.
    sizes = homes.groupBy("home").agg(F.count("*").alias("size")).filter(F.col("size") > block).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    members = homes.join(stored(sizes.select("home", "blocks"), "sizes", done), "home", "left")
    members = stored(members.select("node", "home", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0)).alias("own")), "members", done)

    # The blocks that a bucket has members in; most have one.
    met = stored(ties.select("node", "band", "h").join(members, "node").select("band", "h", "home", "own").distinct(), "met", done)
    a, b = (met.select("band", "h", F.col("home").alias(f"home_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")
    pairs = a.join(b, ["band", "h"]).filter(F.struct("home_a", "own_a") <= F.struct("home_b", "own_b")).select(*PAIR).distinct()
    pairs = stored(pairs, "block-pairs", done)

    texts = given.select("key", "text").join(members.join(classes.select("node", "copies", "key"), "node").hint("shuffle_hash"), "key")
    sets = stored(texts.select("home", "own", "node", "copies", "text").mapInArrow(_sets(k), "home binary, own int, node binary, copies long, set binary"), "sets", done)
    sides = pairs.select(F.col("home_a").alias("home"), F.col("own_a").alias("own"), F.lit(0).alias("side"), *PAIR)
    other = F.struct("home_a", "own_a") != F.struct("home_b", "own_b")
    sides = sides.union(pairs.filter(other).select("home_b", "own_b", F.lit(1), *PAIR))
    dealt = sets.join(sides, ["home", "own"]).select(*PAIR, "side", "node", "copies", "set")
    dealt = dealt.repartition(4 * partitions(docs.sparkSession), *PAIR).sortWithinPartitions(*PAIR, "side", "node")
    verified = stored(dealt.mapInArrow(_verifier(threshold), "node binary, links long, other binary"), "links")
    for path in done:
        remove_path(docs.sparkSession, path)

    links = verified.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(verified.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    row = F.when(F.col("doc").isNotNull(), F.struct("doc", "key"))
    least = signed.filter("node is not null").groupBy("node").agg(F.min(row).alias("least"), F.count("*").alias("copies"))
    of = least.join(groups, "node", "left").join(links, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    heads = of.groupBy("component").agg(F.min("least").alias("head"))
    of = of.join(heads, "component").select("node", "head", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc", "key", "node").join(of, "node", "left")
    rows = ["key", (F.col("node").isNull() | F.coalesce(row == F.col("head"), F.lit(False))).alias("first")] if with_rows else []
    return out.select(F.col("doc").alias("doc_id"), F.coalesce("head.doc", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *rows)


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM documents d
"""
