"""Operator 13, best-fit packing by best-two-fit.

Every document becomes its token ids and an end id; those longer than a sequence are cut into whole sequences and a last
piece. A sequence takes the longest piece that is left and then, again and again, the longest that fits its gap. When
none fits, its smallest piece gives way to two that are left and fill the widened gap more tightly, as long as that
gains something.

What fits depends on lengths alone, and there are no more lengths than tokens in a sequence. So the plan is made for
lengths: a sequence's lengths are a pattern, which is used as often as the counts of its lengths allow before the next
one is formed. It is the plan that one would get sequence by sequence, takes time and space by the number of lengths,
not of documents, and packs all documents together. Only the counts by length reach the driver, and the plan, ranges of
places of equal length with their sequences, goes out to the tasks. A piece's place among those of its length is its
place in its task's share of that length behind the shares of the tasks before.

Cases: null and empty texts are a document of the end id alone; a repeated doc_id is packed for each of its rows; a null
doc_id stays null in its pieces; a third of all documents may have one length, as places are counted in each task; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import col, remove_path, stored
from tamis.llm.tokens import WordEncoder, tokenizer_path

CAPACITY = 4096
OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Pieces are handed on after so many rows or bytes of ids.
ROWS, BYTES = 10_000, 8 << 20


class Plan:
    """Patterns (times, [(length, copies), ...] longest first) that use up all counts of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left = capacity, {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.left)
        self.patterns: list[tuple[int, list[tuple[int, int]]]] = []
        while self.lengths:
            taken = self._sequence()
            times = min(self.left[n] // k for n, k in taken.items())
            for n, k in taken.items():
                self.left[n] -= times * k
                if not self.left[n]:
                    self.lengths.remove(n)
            self.patterns.append((times, sorted(taken.items(), reverse=True)))

    def _sequence(self) -> Counter:
        taken: Counter = Counter()
        gap = self._fill(taken, self.capacity)
        while gap and taken.total() > 1 and (two := self._best_two(taken, gap)):
            smallest = min(taken)
            taken[smallest] -= 1
            gap += smallest - sum(two)
            taken += Counter(two)  # drops lengths that have no copy left
            gap = self._fill(taken, gap)
        return taken

    def _fill(self, taken: Counter, gap: int) -> int:
        """Takes the longest pieces that fit, and tells what gap stays."""
        i = bisect_right(self.lengths, gap)
        while i and gap:
            n = self.lengths[i - 1]
            if k := min(self.left[n] - taken[n], gap // n):
                taken[n] += k
                gap -= k * n
            i = min(i - 1, bisect_right(self.lengths, gap))
        return gap

    def _best_two(self, taken: Counter, gap: int) -> tuple[int, int] | None:
        """The two lengths left whose sum is largest, within the gap widened by the smallest piece and above that piece."""
        smallest = min(taken)
        free = np.array([n for n in self.lengths[: bisect_right(self.lengths, gap + smallest)] if self.left[n] > taken[n]], np.int64)
        if not len(free):
            return None
        at = np.searchsorted(free, np.minimum(gap + smallest - free, free), "right") - 1
        once = np.array([self.left[n] - taken[n] < 2 for n in free.tolist()])
        at -= once & (at >= 0) & (free[at] == free)
        total = np.where(at >= 0, free + free[at], 0)
        best = len(total) - 1 - int(np.argmax(total[::-1]))
        return (int(free[best]), int(free[at[best]])) if total[best] > smallest else None

    def ranges(self) -> np.ndarray:
        """Rows (length, first place, copies, first sequence, offset), by length and place: pieces of a length from that place
        on lie `copies` to a sequence."""
        used, rows, sequence = Counter(), [], 0
        for times, taken in self.patterns:
            offset = 0
            for n, k in taken:
                rows.append((n, used[n], k, sequence, offset))
                used[n] += times * k
                offset += n * k
            sequence += times
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, share, place): share is the task, place the piece's among its task's of that length."""
    path, end = tokenizer or tokenizer_path("word_bpe_49k.json"), end_id.to_bytes(4, "little")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, share int, place long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches):
        share, places, encoder, rows, held = TaskContext.get().partitionId(), Counter(), WordEncoder(path), [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    n = len(own) // 4
                    rows.append((doc_id, piece, start, n, zlib.crc32(own), share, places[n]) + ((own,) if with_ids else ()))
                    places[n] += 1
                    held += len(own) * with_ids
                    if len(rows) >= ROWS or held >= BYTES:
                        yield out()
                        rows.clear()
                        held = 0
        if rows:
            yield out()

    return docs.select(col(doc).cast("long"), col(text).cast("string").cast("binary")).mapInArrow(run, schema)


def best_fit(docs: DataFrame, *, capacity: int = CAPACITY, with_ids: bool = False, **options) -> DataFrame:
    """One row per piece, columns OUT (with_ids: and its ids, little-endian uint32), as a stored table."""
    spark, paths = docs.sparkSession, []
    # What is written once stays as it is when tasks run again, places in shares included.
    pieces = stored(cut_pieces(docs, capacity=capacity, with_ids=with_ids, **options), "pieces", paths)
    shares = pieces.groupBy("length", "share").agg(F.count("*").alias("n"))
    # At most `capacity` rows.
    plan = Plan({r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity).ranges()
    ranges = spark.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    schema = OUT + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        rows = ranges.value
        # Places of a length start at its first row of the plan.
        lengths = np.unique(rows[:, 0])
        edges = np.append(np.searchsorted(rows[:, 0], lengths), len(rows))
        for batch in batches:
            length, place = batch.column("length").to_numpy(), batch.column("at").to_numpy()
            of = np.searchsorted(lengths, length)
            at = np.zeros(len(length), np.int64)
            for k in np.unique(of).tolist():
                mine = of == k
                at[mine] = edges[k] + np.searchsorted(rows[edges[k] : edges[k + 1], 1], place[mine], "right") - 1
            _, first, copies, sequence, offset = rows[at].T
            nth = place - first
            more = {"sequence_id": pa.array(sequence + nth // copies, pa.int64()), "offset": pa.array(offset + nth % copies * length, pa.int64())}
            yield pa.RecordBatch.from_arrays([more[c] if c in more else batch.column(c) for c in names], names)

    placed = pieces.join(shares, ["length", "share"]).withColumn("at", F.col("place") + F.col("before")).drop("share", "place", "before")
    packed = stored(placed.mapInArrow(run, schema), "packed")
    for path in paths:
        remove_path(spark, path)
    ranges.destroy()
    return packed


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the ids of each sequence of `best_fit(with_ids=True)`, of at most its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, b: F.concat(a, b))
    return whole.select("sequence_id", "length", joined.alias("ids"))


def op13_best_fit(spark, sf_dir: str) -> DataFrame:
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
