"""Operator 9, hierarchical multi-length packing.

Every document becomes its token ids and an end id. Full windows of the longest context are cut off first; what is left
is routed to the smallest context tier that holds it. Each tier's windows are filled with the largest shorter piece that
fits their gap, and when none fits a shorter piece is cut to the gap, so all windows of a partition but its last are
full. Windows then form step groups of equal token budgets, long tiers first. Each input partition packs its own
documents with a bounded pool; ids of sequences hold the partition, and a partition that is computed again gives the
same rows.

Cases: null and empty texts are a document of the end id alone; a repeated doc_id is packed for each of its rows; a null
doc_id stays null in its pieces; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import col
from tamis.llm.tokens import WordEncoder, tokenizer_path

TIERS = (256, 512, 1024, 2048)
#: Pieces that wait in a partition's pool, 8 KB each at most.
POOL = 2048
#: Tokens of a step group.
STEP = 8 * 2048
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Pieces (doc, start, ids, doc_tokens) in, full windows out: lists of pieces with their tier."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        self.tiers, self.limit, self.pool, self.seq = sorted(tiers), pool, [], 0

    def _put(self, piece: tuple) -> None:
        self.seq += 1
        insort(self.pool, (len(piece[2]) // 4, self.seq, piece))

    def add(self, doc, ids: bytes) -> Iterator[tuple[int, list]]:
        longest, total = self.tiers[-1], len(ids) // 4
        full = total // longest * longest
        for start in range(0, full, longest):
            yield longest, [(doc, start, ids[4 * start : 4 * (start + longest)], total)]
        if total > full:
            self._put((doc, full, ids[4 * full :], total))
        if len(self.pool) >= self.limit:
            yield from self.flush(self.limit // 2)

    def flush(self, left: int = 0) -> Iterator[tuple[int, list]]:
        while len(self.pool) > left:
            n, _, piece = self.pool.pop()
            tier = next(t for t in self.tiers if t >= n)
            window, gap = [piece], tier - n
            while gap and self.pool:
                at = bisect_right(self.pool, (gap, float("inf")))
                if at:
                    n, _, piece = self.pool.pop(at - 1)
                else:
                    _, _, (doc, start, ids, total) = self.pool.pop(0)
                    n, piece = gap, (doc, start, ids[: 4 * gap], total)
                    self._put((doc, start + gap, ids[4 * gap :], total))
                window.append(piece)
                gap -= n
            yield tier, window


def _grouped(windows: Iterator[tuple[int, list]], step: int) -> Iterator[tuple[int, int, list]]:
    """(step group, tier, window): tiers are powers of two, so windows in falling order fill each budget exactly."""
    waiting, held, group, budget = [], 0, 0, step
    for w in chain(windows, [None]):
        if w:
            waiting.append(w)
            held += w[0]
            if held < 4 * step:
                continue
        waiting.sort(key=lambda w: -w[0])
        keep = []
        for tier, window in waiting:
            if w and held < step:
                keep.append((tier, window))
                continue
            if budget < tier:
                group, budget = group + 1, step
            yield group, tier, window
            held, budget = held - tier, budget - tier
        waiting = keep


def pack(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """One row per piece, columns OUT (with_ids: and the piece's ids, little-endian uint32)."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    end = end_id.to_bytes(4, "little")
    schema = OUT + (", ids binary" if with_ids else "")

    def windows(batches, packer):
        encoder = WordEncoder(path)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                yield from packer.add(doc_id, ids + end)
        yield from packer.flush()

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        rows, names = [], [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for n, (group, tier, window) in enumerate(_grouped(windows(batches, Packer(tiers, pool)), step)):
            offset = 0
            for doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, part + n, offset, tier, part + group) + ((ids,) if with_ids else ()))
                offset += len(ids) // 4
            if len(rows) > 10_000:
                yield out()
                rows.clear()
        if rows:
            yield out()

    return docs.select(col(doc).cast("long"), col(text).cast("string").cast("binary")).mapInArrow(run, schema)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
