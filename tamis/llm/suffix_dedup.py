"""Operator 4, removal of repeated passages with a logarithmic family of suffix arrays.

Suffixes are sampled at content-defined places: of every window of `width` bytes the k-gram with the least hash is its
anchor, so equal windows have equal anchors wherever they stand. A suffix array holds the suffixes at these places in
the order of their text, by its first K bytes. It is split into ranges of the text, as many as the bytes at hand ask
for, each of which a task sorts and scans on its own. A new batch gets its array, which is merge-scanned against the
levels that are there: neighbours of different documents with K bytes in common are seeds of long matches. Then it
becomes a level itself; levels of equal size merge, so that each suffix is rewritten a logarithmic number of times.

Seeds are extended to both sides to matches of `width` bytes and more. A block is the text of all windows of one anchor;
blocks that a smaller document holds as a whole are matched, and where suffixes agree but blocks don't, the windows of
these blocks are compared. All comparisons are of 128-bit hashes. The texts are stored once, compressed and bucketed by
document, and are joined there with the places that concern them. What the documents of one slab of text (SLAB bytes)
share with each other is settled in it, and a block goes on once for each slab, so no task gets all places of a passage.

A byte goes if a window of `width` bytes over it also starts in a document with a smaller id.

Cases: null texts are empty; texts shorter than `width` lose nothing; repeats inside a document stay; rows that repeat
an id are parts of one document, so what they share with each other stays; rows with a null id neither lose nor cause
anything; texts of any length are cut into overlapping slabs; an empty table gives an empty result; other columns are
not read. `width` must be K + 8 or more; any such width gives the same bytes as brute force.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm.common import col, new_path, partitions, remove_path, stored

K = 20
#: Bytes that a task works on at once, and suffixes that it sorts at once, over all levels.
SLAB, RANGE = 1 << 21, 1_500_000
#: Documents, and places in each, that the ranges' bounds are taken from; they only balance the tasks.
SAMPLE_DOCS, SAMPLE_PLACES = 2000, 64
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _C[3]
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).copy()


def anchors(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of concatenated texts that begin at `starts`: (text, first window, last window, anchor), places counted in `data`, an
    entry for each anchor and run of windows that have it."""
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    n = len(data) - width + 1
    if n < 1:
        return none
    v = _words(data)
    m = len(data) - K + 1
    h = _mix(v[:m] * _C[0] + v[8 : 8 + m] * _C[1] + v[12 : 12 + m] * _C[2])
    span = width - K + 1
    low = (h & np.uint64(2**64 - 2**24)) | np.arange(m, dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    at = (low & np.uint64(2**24 - 1)).astype(np.int64)
    ends = np.append(starts[1:], len(data))
    good = np.zeros(n + 1, np.int64)
    has = ends - starts >= width
    np.add.at(good, starts[has], 1)
    np.add.at(good, ends[has] - width + 1, -1)
    good = np.cumsum(good[:-1]) > 0
    # A run of windows ends where the anchor changes or a text's last window is.
    i = np.flatnonzero(good)
    if not len(i):
        return none
    new = np.empty(len(i), bool)
    new[0] = True
    new[1:] = (at[i[1:]] != at[i[:-1]]) | (i[1:] != i[:-1] + 1)
    a = i[new]
    b = i[np.append(np.flatnonzero(new)[1:] - 1, len(i) - 1)]
    # Neighbouring texts of which one ends where the other begins never share a window, as theirs aren't consecutive.
    return np.searchsorted(starts, a, "right") - 1, a, b, at[a]


def block_hashes(data: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks from window a to window b with the anchor at `at`: the hash of the anchor's K bytes, and of all bytes."""
    v = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    suffix = _mix(v[at] * _C[0] + v[at + 8] * _C[1] + v[at + K - 8] * _C[2])
    block = (b - a).astype(np.uint64)
    # A block has at most width - K bytes after its first window; its head and its tail meet.
    for j in range(width // 8):
        block = _mix(block * _C[4] + v[a + 8 * j])
    for j in range(1, -(-(width - K + width % 8) // 8) + 1):
        block = _mix(block * _C[4] + v[b + width - 8 * j])
    return suffix, block


def _order_key(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The K bytes from each place on as numbers that compare as the bytes do."""
    v = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    return v[at].byteswap(), v[at + 8].byteswap(), (v[at + K - 8] >> np.uint64(32)).astype(np.uint32).byteswap()


def _slabs(ids: list, texts: Iterable[bytes], width: int):
    """(ids, data, starts, offsets): texts joined to slabs; a longer text is cut to overlapping ones."""
    held, size = [], 0
    for i, t in zip(ids, texts):
        if i is None or len(t) < width:
            continue
        for at in range(0, max(1, len(t) - width + 1), SLAB):
            part = t[at : at + SLAB + width - 1]
            held.append((i, part, at))
            size += len(part)
            if size >= SLAB:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    data = np.frombuffer(b"".join(p for _, p, _ in held) + bytes(16), np.uint8)[:-16]
    starts = np.cumsum([0, *(len(p) for _, p, _ in held[:-1])])
    return [i for i, _, _ in held], data, starts, np.array([at for *_, at in held], np.int64)


#: A range's sorted suffixes: text order (first three), document, place, windows before and in all, known as shared. The
#: bytes of the first number's steps and of the place are laid out by significance, which compresses better.
FIELDS = (np.uint64, np.uint64, np.uint32, np.int64, np.uint32, np.uint8, np.uint8, np.bool_)
_BY_BYTE = (0, 4)


def _pack(columns) -> bytes:
    from zstandard import ZstdCompressor

    squeeze = ZstdCompressor(level=1).compress
    first, *rest = (np.ascontiguousarray(c, k) for c, k in zip(columns, FIELDS))
    data = [np.diff(first, prepend=np.uint64(0)), *rest]
    data = [(c.view(np.uint8).reshape(-1, c.itemsize).T if i in _BY_BYTE else c).tobytes() for i, c in enumerate(data)]
    # Few rows are one part, as each part has a head of its own.
    parts = [squeeze(c) for c in data] if len(first) > 200 else [squeeze(b"".join(data))]
    return b"".join(x.to_bytes(4, "little") for x in (len(first), *map(len, parts))) + b"".join(parts)


def _unpack(blob: bytes) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    unpack = ZstdDecompressor().decompress
    n = int.from_bytes(blob[:4], "little")
    sizes = np.frombuffer(blob, "<u4", len(FIELDS) if n > 200 else 1, 4).tolist()
    at, data = 4 + 4 * len(sizes), b""
    for size in sizes:
        data += unpack(blob[at : at + size])
        at += size
    out, at = [], 0
    for i, kind in enumerate(FIELDS):
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(data, np.uint8, n * width, at)
        out.append(np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel() if i in _BY_BYTE else raw.view(kind))
        at += n * width
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


RUN = "kind string, range int, doc long, data binary"


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["kind", "range", "doc", "data"])


def _groups(*columns: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the one before."""
    first = np.ones(len(columns[0]), bool)
    first[1:] = False
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return first


def _hits(n: int, doc: np.ndarray, at: np.ndarray, before: np.ndarray, windows: np.ndarray) -> list[tuple]:
    """A row for each document: its places as bytes."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    places = np.empty(len(doc), "<u4,u1,u1")
    places["f0"], places["f1"], places["f2"] = at[order], before[order], windows[order]
    cuts = np.append(np.flatnonzero(_groups(doc)), len(doc))
    return [("hit", n, int(doc[i]), places[i:j].tobytes()) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())] if len(doc) else []


def _sampler(splits: np.ndarray, width: int):
    """A batch's sampled suffixes: a row for each range and slab, and the seeds that the slab itself shows.

    Of a suffix that several documents of a slab share, all places are seeds at once and one entry goes on, so that a
    suffix of very many documents reaches its range once for each slab.
    """

    def run(batches):
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for docs, data, starts, offsets in _slabs(batch.column("doc").to_pylist(), _texts(batch), width):
                text, a, b, place = anchors(data, starts, width)
                key = _order_key(data, place)
                order = np.lexsort((text, *key[::-1]))
                key = [k[order] for k in key]
                text, a, b, place = (x[order] for x in (text, a, b, place))
                doc, at = np.array(docs, np.int64)[text], place - starts[text] + offsets[text]
                first = _groups(*key)
                lead = np.flatnonzero(first)
                group = np.cumsum(first) - 1
                shared = (np.bincount(group, doc != doc[lead][group], minlength=len(lead)) > 0)[group] if len(order) else first
                rows = _hits(turn % (len(splits) + 1), doc[shared], at[shared], (place - a)[shared], (b - a)[shared])
                turn += 1
                goes = first | ~shared
                columns = [x[goes] for x in (*key, doc, at, place - a, b - a, shared)]
                cuts = np.concatenate([[0], np.searchsorted(columns[0], splits), [len(columns[0])]])
                rows += [("new", k, None, _pack([c[i:j] for c in columns])) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
                yield _run_batch(rows)

    return run


def _scanner(merge: set[str], keep: bool):
    """The merge-scan of each range. "hit" rows: the new batch's suffixes with K bytes in common with one of another document,
    in it or in a level, and those of the levels that weren't known to be shared before. "level" rows: the sorted array
    that the batch and the levels of `merge` become."""

    def range_out(n: int, rows: list[tuple]):
        out = [("hit", n, doc, data) for kind, doc, data in rows if kind == "hit"]
        rows = [r for r in rows if r[0] != "hit"]
        if not rows:
            return _run_batch(out)
        parts = [_unpack(data) for *_, data in rows]
        columns = [np.concatenate(c) for c in zip(*parts)]
        fresh, stays = (np.repeat(x, [len(p[0]) for p in parts]) for x in ([r[0] == "new" for r in rows], [r[0] == "new" or r[0] in merge for r in rows]))
        order = np.lexsort((columns[3], *columns[2::-1]))
        *key, doc, at, before, windows, known = (c[order] for c in columns)
        fresh, stays = fresh[order], stays[order]
        first = _groups(*key)
        group, lead = np.cumsum(first) - 1, np.flatnonzero(first)
        other = np.bincount(group, doc != doc[lead][group], minlength=len(lead)) > 0
        was = np.bincount(group, known, minlength=len(lead)) > 0
        touched = np.bincount(group, fresh, minlength=len(lead)) > 0
        shared = ((other | was) & touched)[group]
        hit = shared & ~known
        out += _hits(n, doc[hit], at[hit], before[hit], windows[hit])
        if keep:
            # Of a shared suffix, whose places are all known as seeds, one entry is enough for later batches; of others all stay.
            known = known | shared
            order = np.flatnonzero(stays)
            one = order[np.append(True, group[order][1:] != group[order][:-1]) | ~known[order]] if len(order) else order
            out.append(("level", n, None, _pack([c[one] for c in (*key, doc, at, before, windows, known)])))
        return _run_batch(out)

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for n, *r in zip(*(batch.column(c).to_pylist() for c in ("range", "kind", "doc", "data"))):
                if n != now and rows:
                    yield range_out(now, rows)
                    rows = []
                now = n
                rows.append(r)
        if rows:
            yield range_out(now, rows)

    return run


def _kept(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """The rows in a table of the shared folder, and its path; what led to them is let go."""
    spark, path, schema = df.sparkSession, new_path(df.sparkSession, name), df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    del df
    _free(spark)
    return spark.read.schema(schema).parquet(path), path


def _free(spark: SparkSession, *paths: str) -> None:
    """Drops tables that are no longer needed. Shuffle files go when the driver's collector finds that nobody refers to them,
    which is asked for here, as a corpus's worth of them may wait for it otherwise."""
    for path in paths:
        remove_path(spark, path)
    gc.collect()
    spark._jvm.System.gc()


class SuffixLevels:
    """The levels: tables of rows (range, sorted suffixes), the younger the smaller; `add` scans and merges."""

    def __init__(self, spark: SparkSession, splits: np.ndarray, width: int = 50):
        self.spark, self.width, self.splits, self.levels, self.paths = spark, width, splits, [], []

    def add(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """batch (doc, packed): the seeds as rows ("hit", doc, places). keep=False: the last batch, which no other follows."""
        rank, merge = 0, set()
        while self.levels and keep and self.levels[-1 - len(merge)][0] == rank:
            merge.add(f"level{len(self.levels) - 1 - len(merge)}")
            rank += 1
            if len(merge) == len(self.levels):
                break
        runs = batch.mapInArrow(_sampler(self.splits, self.width), RUN)
        for i, (_, path) in enumerate(self.levels):
            runs = runs.unionByName(self._read(path, "level").withColumn("kind", F.lit(f"level{i}")))
        path = new_path(self.spark, "suffixes")
        runs.repartitionById(len(self.splits) + 1, "range").sortWithinPartitions("range").mapInArrow(_scanner(merge, keep), RUN).write.partitionBy("kind").parquet(path)
        for name in sorted(merge, reverse=True):
            _, old = self.levels.pop(int(name[5:]))
            remove_path(self.spark, f"{old}/kind=level")
        self.levels.append((rank, path))
        self.paths.append(path)
        _free(self.spark)
        return self._read(path, "hit")

    def _read(self, path: str, kind: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(path).filter(F.col("kind") == kind)

    def drop_levels(self) -> None:
        _free(self.spark, *(f"{path}/kind=level" for _, path in self.levels))

    def drop(self) -> None:
        """Levels and hits."""
        _free(self.spark, *self.paths)


def _squeezed(batches):
    from zstandard import ZstdCompressor

    squeeze = ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column("text").to_pylist()
        columns = [*(batch.column(c) for c in ("doc", "key", "batch")), pa.array([len(t) for t in texts], pa.int64()), pa.array([squeeze(t) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "batch", "n_bytes", "packed"])


def _texts(batch) -> Iterator[bytes]:
    from zstandard import ZstdDecompressor

    unpack = ZstdDecompressor().decompress
    return (unpack(z.as_py()) for z in batch.column("packed"))


def _bucketed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The texts in a table that joins by document read without a shuffle; it stays for the reader of the result."""
    name, n = f"texts_{uuid.uuid4().hex}", partitions(spark)
    rows = docs.mapInArrow(_squeezed, "doc long, key long, batch int, n_bytes long, packed binary")
    rows.repartition(n, "doc").write.format("parquet").option("path", new_path(spark, "texts")).option("compression", "zstd").partitionBy("batch").bucketBy(n, "doc").saveAsTable(name)
    return spark.table(name)


def _bounds(texts: DataFrame, width: int) -> np.ndarray:
    """Where the ranges of the text order end, from the counted bytes and a bounded sample of places."""
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()

    def places(batches):
        for batch in batches:
            for t in _texts(batch):
                for _, data, starts, _ in _slabs([0], [t[:SLAB]], width):
                    at = anchors(data, starts, width)[3]
                    yield pa.RecordBatch.from_arrays([pa.array(_order_key(data, at[:: len(at) // SAMPLE_PLACES + 1])[0].view(np.int64))], ["at"])

    some = texts.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE_DOCS))) == 0).limit(2 * SAMPLE_DOCS)
    found = np.sort(np.array([r["at"] for r in some.mapInArrow(places, "at long").collect()], np.int64).view(np.uint64))
    ranges = max(partitions(texts.sparkSession), -(-2 * size // ((width - K + 2) * RANGE)))
    return np.unique(found[np.arange(1, ranges) * len(found) // ranges]) if len(found) else found


#: Spans of a document's row; `n` is null where data are pairs (a, e), else data are the first windows of blocks of n + 1.
SPANS = "kind string, doc long, key long, n int, data binary, suffix long, block long"


def _span_batch(doc: np.ndarray, key: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    """A row for each document's row, of spans in any order."""
    order = np.lexsort((key, doc))
    doc, key, spans = doc[order], key[order], spans[order]
    cuts = np.append(np.flatnonzero(_groups(doc, key)), len(doc)) if len(doc) else np.zeros(1, np.int64)
    lead = cuts[:-1]
    return pa.RecordBatch.from_arrays([pa.array(doc[lead]), pa.array(key[lead]), pa.array([spans[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())], ["doc", "key", "data"])


def _blocks(width: int):
    """Of the documents' places: "span" rows of the blocks that a smaller document of the same slab has too, and a "block" row
    for each other block of a slab, with all its places in its document."""

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc", "key")), _texts(batch), batch.column("places")):
                held.append(row)
                size += len(row[2])
                if size >= SLAB:
                    yield from slab(*map(list, zip(*held)))
                    held, size = [], 0
            if held:
                yield from slab(*map(list, zip(*held)))

    def slab(docs: list, keys: list, texts: list[bytes], lists: list):
        lists = [b"".join(x.as_py()) for x in lists]
        data = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)[:-16]
        size = np.array([len(t) for t in texts])
        start = np.cumsum(size) - size
        places = np.frombuffer(b"".join(lists), "<u4,u1,u1")
        row = np.repeat(np.arange(len(texts)), [len(x) // places.itemsize for x in lists])
        at = places["f0"].astype(np.int64)
        a, n = at - places["f1"], places["f2"].astype(np.int64)
        # Rows of one id get each other's places; those that reach beyond a text aren't its own.
        own = a + n + width <= size[row]
        row, at, a, n = (x[own] for x in (row, at, a, n))
        base = start[row]
        suffix, block = block_hashes(data, at + base, a + base, a + n + base, width)
        doc, key = np.array(docs, np.int64)[row], np.array(keys, np.int64)[row]
        order = np.lexsort((a, key, doc, block, suffix))
        suffix, block, doc, key, a, n = (x[order] for x in (suffix, block, doc, key, a, n))
        first = _groups(suffix, block)
        least = doc[np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else doc
        whole = doc > least
        spans = _span_batch(doc[whole], key[whole], np.stack([a, a + n + width], axis=1)[whole].astype("<u4"))
        none = lambda c, k: pa.nulls(len(c), k)
        c = spans.column(0)
        yield pa.RecordBatch.from_arrays([pa.array(["span"] * len(c), pa.string()), *spans.columns[:2], none(c, pa.int32()), spans.column(2), none(c, pa.int64()), none(c, pa.int64())], [x.split()[0] for x in SPANS.split(", ")])
        suffix, block, doc, key, a, n = (x[~whole] for x in (suffix, block, doc, key, a, n))
        cuts = np.append(np.flatnonzero(_groups(suffix, block, key)), len(a)) if len(a) else np.zeros(1, np.int64)
        lead, a = cuts[:-1], a.astype("<u4")
        lists = [a[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(["block"] * len(lead), pa.string()), pa.array(doc[lead]), pa.array(key[lead]), pa.array(n[lead].astype(np.int32)), pa.array(lists, pa.binary()), pa.array(suffix[lead].view(np.int64)), pa.array(block[lead].view(np.int64))], [x.split()[0] for x in SPANS.split(", ")])

    return run


def _open_blocks(width: int):
    """The text of the given blocks at each of their places: (suffix, key, doc, a, block)."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for key, doc, t, blocks in zip(batch.column("key").to_pylist(), batch.column("doc").to_pylist(), _texts(batch), batch.column("blocks").to_pylist()):
                for x in blocks:
                    for a in np.frombuffer(x["data"], "<u4").tolist() if x["key"] == key else ():
                        for o, v in zip(out, (x["suffix"], key, doc, a, t[a : a + x["n"] + width])):
                            o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["suffix", "key", "doc", "a", "block"])

    return run


def _compared(width: int):
    """Blocks in order of suffix -> spans of their windows that a smaller document's block of the suffix has."""

    def matched(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        suffix, key, doc, a = (table.column(c).to_numpy() for c in ("suffix", "key", "doc", "a"))
        texts = table.column("block").to_pylist()
        size = np.array([len(t) for t in texts])
        start = np.cumsum(size) - size
        v = _words(np.frombuffer(b"".join(texts) + bytes(8), np.uint8))
        count = size - width + 1
        row = np.repeat(np.arange(len(texts)), count)
        t = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at, own = start[row] + t, suffix[row].view(np.uint64)
        hashes = []
        for seed in (1, 2):
            w = own ^ np.uint64(seed)
            for j in [*range(0, width - 7, 8), width - 8]:
                w = _mix(w * _C[4] + v[at + j] * _C[seed])
            hashes.append(w)
        order = np.lexsort((doc[row], hashes[1], hashes[0]))
        first = np.ones(len(order), bool)
        for w in hashes:
            first[1:] = first[1:] & (w[order][1:] == w[order][:-1])
        first[1:] = ~first[1:]
        ranked = doc[row][order]
        hit = order[ranked > ranked[np.flatnonzero(first)][np.cumsum(first) - 1]]
        hit.sort()
        # Neighbouring windows of a block make one span.
        begins = np.ones(len(hit), bool)
        begins[1:] = (row[hit][1:] != row[hit][:-1]) | (t[hit][1:] != t[hit][:-1] + 1)
        b = np.flatnonzero(begins)
        e = np.append(b[1:], len(hit))[: len(b)] - 1
        places = a[row[hit]] + t[hit]
        own = row[hit][b]
        spans = np.stack([places[b], places[e] + width], axis=1).astype("<u4")
        return _span_batch(doc[own], key[own], spans)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            # Whole groups go together: what belongs to the batch's last suffix waits.
            suffix = batch.column("suffix").to_numpy()
            cut = int(np.searchsorted(suffix, suffix[-1])) if len(suffix) else 0
            if rows + cut > 20_000 and cut:
                yield matched([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield matched(held)

    return run


def _windows(width: int):
    """Every window of the given blocks with a 128-bit hash: (key, doc, i, w1, w2)."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for key, doc, t, blocks in zip(batch.column("key").to_pylist(), batch.column("doc").to_pylist(), _texts(batch), batch.column("blocks").to_pylist()):
                places = [np.arange(a, a + x["n"] + 1) for x in blocks if x["key"] == key for a in np.frombuffer(x["data"], "<u4").tolist()]
                if not places:
                    continue
                i = np.unique(np.concatenate(places))
                v = _words(np.frombuffer(t, np.uint8))
                hashes = []
                for seed in (1, 2):
                    w = np.full(len(i), seed, np.uint64)
                    for j in [*range(0, width - 7, 8), width - 8]:
                        w = _mix(w * _C[4] + v[i + j] * _C[seed])
                    hashes.append(w.view(np.int64))
                for o, x in zip(out, (np.full(len(i), key), np.full(len(i), doc), i, *hashes)):
                    o.append(x)
                if sum(map(len, out[2])) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["key", "doc", "i", "w1", "w2"])
                    out = [[] for _ in range(5)]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["key", "doc", "i", "w1", "w2"])

    return run


def _window_spans(width: int):
    def run(batches):
        for batch in batches:
            i = batch.column("i").to_numpy()
            yield _span_batch(batch.column("doc").to_numpy(), batch.column("key").to_numpy(), np.stack([i, i + width], axis=1).astype("<u4"))

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _merged(batch, width: int) -> tuple[np.ndarray, ...]:
    """(row, begin, end) of a batch's own spans, sorted and joined where they meet."""
    lists = batch.column("spans")
    spans, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    row = np.repeat(np.arange(batch.num_rows), sizes)
    key, n, data = spans.field("key").to_numpy(), pc.fill_null(spans.field("n"), -1).to_numpy().astype(np.int64), spans.field("data")
    if not len(row):
        return row, row, row
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    values = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view("<u4").astype(np.int64)
    count = np.diff(offsets) // 4
    of = np.repeat(np.arange(len(row)), count)
    place = np.arange(len(values)) - (np.cumsum(count) - count)[of]
    # Pairs, or first windows of blocks; those of another row with the same id aren't this row's.
    paired = n[of] < 0
    begins = np.flatnonzero((~paired | (place % 2 == 0)) & (key == batch.column("key").to_numpy()[row])[of])
    if not len(begins):
        return begins, begins, begins
    a, r = values[begins], row[of[begins]]
    e = np.where(paired[begins], values[np.minimum(begins + 1, len(values) - 1)], a + n[of[begins]] + width)
    # One number for row and place keeps rows apart.
    a, e = a + (r << 40), e + (r << 40)
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(e[order])
    new = np.append(True, a[1:] > reach[:-1])
    a, e = a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
    return a >> 40, a & ((1 << 40) - 1), e & ((1 << 40) - 1)


def _cutter(width: int, with_text: bool):
    def run(batches):
        for batch in batches:
            row, begins, ends = _merged(batch, width)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            begins, ends, out = begins.tolist(), ends.tolist(), []
            for i, (doc, t) in enumerate(zip(batch.column("doc").to_pylist(), _texts(batch))):
                b, e = begins[cuts[i] : cuts[i + 1]], ends[cuts[i] : cuts[i + 1]]
                kept = b"".join([t[x:y] for x, y in zip([0, *e], [*b, len(t)])]) if b else t
                out.append((doc, len(t), sum(e) - sum(b), len(b), kept if with_text else hashlib.sha256(kept).hexdigest().encode()))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def dedup_passages(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", width: int = 50, batches: int = 4, max_blocks: int = 20_000, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the text that stays, or the hex SHA-256 of it."""
    if not K + 8 <= width <= 256:
        raise ValueError(f"width must be from {K + 8} to 256")
    spark = docs.sparkSession
    id_ = col(doc).cast("long")
    base = docs.select(id_.alias("doc"), F.coalesce(col(text), F.lit("")).cast("binary").alias("text"))
    base = base.select("doc", F.xxhash64("doc", "text").alias("key"), F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch"), "text")
    texts = _bucketed(spark, base)
    levels = SuffixLevels(spark, _bounds(texts, width), width)
    hits = []
    for n in range(batches):
        hits.append(levels.add(texts.filter(F.col("batch") == n).select("doc", "packed"), keep=n < batches - 1))
    levels.drop_levels()
    places = hits[0]
    for h in hits[1:]:
        places = places.unionByName(h)
    places = places.groupBy("doc").agg(F.collect_list("data").alias("places"))
    packed = texts.select("doc", "key", "packed")
    found, at_found = _kept(packed.join(places.hint("shuffle_hash"), "doc").mapInArrow(_blocks(width), SPANS), "blocks", "kind")
    del places, hits
    levels.drop()

    # Of each block the least document; rows of a block meet by suffix and block, at most one from each slab.
    least = F.min("doc").over(Window.partitionBy("suffix", "block"))
    met, at_met = _kept(found.filter("kind = 'block'").withColumn("whole", F.col("doc") > least).select("doc", "key", "n", "data", *(F.when(~F.col("whole"), F.col(c)).alias(c) for c in ("suffix", "block")), "whole"), "met")
    _free(spark, f"{at_found}/kind=block")

    unlike = met.filter("not whole").groupBy("suffix").agg(F.approx_count_distinct("block").alias("blocks"), (F.min("block") < F.max("block")).alias("several")).filter("several")
    open_, at_open = _kept(met.filter("not whole").join(unlike, "suffix").select("doc", "key", "n", "data", "suffix", "blocks"), "open-blocks")
    blocks = lambda rows: packed.join(rows.groupBy("doc").agg(F.collect_list(F.struct("key", "n", "data", "suffix")).alias("blocks")).hint("shuffle_hash"), "doc")
    few = blocks(open_.filter(F.col("blocks") <= max_blocks)).mapInArrow(_open_blocks(width), "suffix long, key long, doc long, a int, block binary")
    spans = "doc long, key long, data binary"
    compared, at_compared = _kept(few.repartition(partitions(spark), "suffix").sortWithinPartitions("suffix").mapInArrow(_compared(width), spans), "compared")
    del few
    parts, paths = [compared], [at_compared, at_met, at_open, at_found]
    many = open_.filter(F.col("blocks") > max_blocks)
    if not many.isEmpty():
        # A suffix of very many blocks: its windows meet by their own hashes instead.
        windows, at_windows = _kept(blocks(many).mapInArrow(_windows(width), "key long, doc long, i long, w1 long, w2 long"), "windows")
        firsts = stored(windows.groupBy("w1", "w2").agg(F.min("doc").alias("first")), "first-windows")
        parts.append(windows.join(firsts, ["w1", "w2"]).filter("doc > first").select("doc", "key", "i").mapInArrow(_window_spans(width), spans))
        paths.append(at_windows)
    merged = met.filter("whole").select("doc", "key", "n", "data")
    for part in [found.filter("kind = 'span'"), *parts]:
        merged = merged.union(part.select("doc", "key", F.lit(None).cast("int"), "data"))
    removed, _ = _kept(merged.groupBy("doc").agg(F.collect_list(F.struct("key", "n", "data")).alias("spans")), "spans")
    del found, merged, met, open_, compared, parts, part, many
    _free(spark, *paths)
    return packed.join(removed.hint("shuffle_hash"), "doc", "left").mapInArrow(_cutter(width, with_text), OUT)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
