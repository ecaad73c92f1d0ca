"""Operator 8, training-order materialisation.

The documents of an input partition, each with an end id, make one row of token ids, cut into sequences of `length`; only
the partition's last one is padded. Every sequence has a dense index (its partition's offset and its place there), which
a keyed Feistel permutation with cycle-walking sends to its slot in the global training order: no shuffle decides the
order, and any slot's sequence can be computed. Sequences go to the partition of their shard, are sorted by slot and
written as raw records of `stride(length)` bytes: `HEAD` (the document of the first id, the id's place in it, ids that
aren't padding, 1 for a document without id), `length` ids of two bytes, and a line feed that ends the record. Each shard
has `per_shard` records (the last may have fewer), so slot s lies at byte s % per_shard * stride of shard s // per_shard:
a reader that stopped after slot s seeks to s + 1.

Cases: null and empty texts are the end id alone; repeated rows are documents of their own; a null doc_id comes back as
null; an empty table writes no shard; a text of any length is cut; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tamis.llm.common import col, new_path, stored
from tamis.llm.tokens import WordEncoder, tokenizer_path

LENGTH, PER_SHARD, ROUNDS = 512, 16_384, 4
HEAD = "<qihh"
SHARD = "slot long, shard long, record long, doc_id long, start int, n_tokens int, ids binary"


def stride(length: int) -> int:
    return struct.calcsize(HEAD) + 2 * length + 1


class Feistel:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network on the least even number of bits that holds n, applied
    again to whatever falls outside (cycle-walking; under four times on average)."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n, self.half = n, np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng(key).integers(0, 2**63, rounds, np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            a, b = (b ^ self._round(a, key), a) if back else (b, a ^ self._round(b, key))
        return (a << self.half) | b

    def __call__(self, index: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._once(np.asarray(index).astype(np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)


class Cutter:
    """Documents in, records of `length` ids out; what is left of them waits for the next ones."""

    def __init__(self, length: int, pad_id: int):
        self.length, self.pad, self.held, self.owners, self.size = length, pad_id, [], [], 0

    def add(self, doc_id, start: int, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.owners.append((doc_id, start))
        self.size += len(ids)

    def records(self, last: bool = False) -> list[bytes]:
        ids = np.concatenate([np.zeros(0, "<u2"), *self.held])
        begins = np.cumsum([0, *map(len, self.held)])
        full = len(ids) if last else len(ids) // self.length * self.length
        firsts = np.arange(0, full, self.length)
        out = []
        for at, i in zip(firsts.tolist(), (np.searchsorted(begins, firsts, "right") - 1).tolist()):
            part, (doc_id, start) = ids[at : at + self.length], self.owners[i]
            pad = np.full(self.length - len(part), self.pad, "<u2").tobytes()
            out.append(struct.pack(HEAD, doc_id or 0, start + at - int(begins[i]), len(part), doc_id is None) + part.tobytes() + pad)
        # The documents that reach beyond the last record.
        i = int(np.searchsorted(begins, full, "right")) - 1
        held, owners = self.held[i:], self.owners[i:]
        self.held, self.owners, self.size = [], [], 0
        for k, (x, (doc_id, start)) in enumerate(zip(held, owners)):
            done = full - int(begins[i]) if k == 0 else 0
            self.add(doc_id, start + done, x[done:])
        return out


def sequences(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """(data): HEAD and ids of each sequence, little-endian."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches):
        encoder, cutter, end = WordEncoder(path, "<u2"), Cutter(length, pad_id), np.array([end_id], "<u2")
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["data"])
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1).to_pylist())):
                cutter.add(doc_id, 0, np.concatenate([ids, end]))
                if cutter.size >= 1 << 20:
                    yield pack(cutter.records())
        yield pack(cutter.records(last=True))

    return docs.select(col(doc).cast("long"), col(text).cast("string").cast("binary")).mapInArrow(run, "data binary")


def training_order(rows: DataFrame, *, key: int, per_shard: int = PER_SHARD) -> tuple[DataFrame, int]:
    """The rows with slot and shard, and their number; they are stored once, so that their indexes hold."""
    spark = rows.sparkSession
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "sequences")
    part = F.shiftright("uid", 33)
    # One number for each partition of the input.
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "part long, before long")
    permute = Feistel(max(1, before[-1]), key)

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy()))

    placed = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    placed = placed.withColumn("slot", slot_of(F.col("before") + F.col("uid").bitwiseAND((1 << 33) - 1))).drop("uid", "part", "before")
    return placed.withColumn("shard", F.floor(F.col("slot") / per_shard)), before[-1]


def _squeezed(batches):
    """The records that a batch has for a shard, as one compressed block."""
    from zstandard import ZstdCompressor

    squeeze = ZstdCompressor(level=3).compress
    for batch in batches:
        shard, slot = (batch.column(c).to_numpy() for c in ("shard", "slot"))
        order = np.argsort(shard, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []
        data = batch.column("data").to_pylist()
        blocks = [squeeze(len(g).to_bytes(4, "little") + slot[g].tobytes() + b"".join([data[i] for i in g.tolist()])) for g in groups]
        yield pa.RecordBatch.from_arrays([pa.array([shard[g[0]] for g in groups], pa.int64()), pa.array(blocks, pa.binary())], ["shard", "block"])


def _spread(batches):
    from zstandard import ZstdDecompressor

    unpack = ZstdDecompressor().decompress
    for batch in batches:
        for shard, block in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist()):
            block = unpack(block)
            n = int.from_bytes(block[:4], "little")
            size = (len(block) - 4) // n - 8
            data = [block[at : at + size] for at in range(4 + 8 * n, len(block), size)]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(np.frombuffer(block, np.int64, n, 4)), pa.array(data, pa.binary())], ["shard", "slot", "data"])


def write_shards(placed: DataFrame, total: int, path: str, per_shard: int = PER_SHARD) -> None:
    """Writes a folder shard=N for each shard with one file of records in order of slot. What a batch has for a shard goes
    through the shuffle as one compressed block. The text source writes bytes as they are and ends each record with a
    line feed; Spark commits whole tasks only."""
    shards = max(1, -(-total // per_shard))
    blocks = placed.select("shard", "slot", "data").mapInArrow(_squeezed, "shard long, block binary")
    dealt = blocks.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(_spread, "shard long, slot long, data binary")
    ordered = dealt.sortWithinPartitions("shard", "slot")
    ordered.select("shard", F.col("data").cast("string").alias("record")).write.partitionBy("shard").text(path)


def _file_system(path: str):
    """A file system that seeks, and the path on it."""
    from pyarrow import fs

    local = re.fullmatch(r"(?:file:/*)?(/[^:]*)", re.sub(r"^file:/+", "/", path))
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


class Records(DataSource):
    """Shards as a table, read by seeking. Options: path; length; per_shard; after: the slot that the reader stopped after."""

    @classmethod
    def name(cls) -> str:
        return "training_shards"

    def schema(self) -> str:
        return SHARD

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)


class Range(InputPartition):
    def __init__(self, path: str, shard: int, first: int, stop: int):
        super().__init__((path, shard, first, stop))


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.length, self.per_shard = options["path"], int(options.get("length", LENGTH)), int(options.get("per_shard", PER_SHARD))
        self.next = int(options.get("after", -1)) + 1

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        files = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        shards = sorted((int(m[1]), f) for f in files if f.is_file and (m := re.search(r"/shard=(\d+)/part-[^/]*$", f.path)))
        found = [Range(f.path, n, max(0, self.next - n * self.per_shard), f.size // stride(self.length)) for n, f in shards if (n + 1) * self.per_shard > self.next]
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        (path, shard, first, stop), size = partition.value, stride(self.length)
        if first >= stop:
            return
        system, _ = _file_system(self.path)
        with system.open_input_file(path) as f:
            f.seek(first * size)
            for at in range(first, stop, 1024):
                n = min(1024, stop - at)
                data = np.frombuffer(f.read(n * size), [("doc", "<i8"), ("start", "<i4"), ("n", "<i2"), ("none", "<i2"), ("ids", f"V{2 * self.length}"), ("end", "u1")])
                if len(data) != n or (data["end"] != 10).any():
                    raise ValueError(f"{path} doesn't hold records of {size} bytes")
                record = np.arange(at, at + n)
                columns = [shard * self.per_shard + record, np.full(n, shard), record, pa.array(data["doc"], mask=data["none"] != 0), data["start"].astype(np.int32), data["n"].astype(np.int32), pa.array([x.tobytes() for x in data["ids"]], pa.binary())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [c.split()[0] for c in SHARD.split(", ")])


def read_shards(spark, path: str, *, length: int = LENGTH, per_shard: int = PER_SHARD, after: int = -1) -> DataFrame:
    """The records that follow slot `after`, a partition for each shard, in order within it: shards before it aren't
    opened, and its own is read from the next record on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    spark.dataSource.register(Records)
    return spark.read.format("training_shards").options(path=full, length=length, per_shard=per_shard, after=after).load()


def op8_training_order(spark, sf_dir: str) -> DataFrame:
    placed, total = training_order(sequences(spark.read.parquet(f"{sf_dir}/documents.parquet")), key=8)
    path = new_path(spark, "shards")
    write_shards(placed, total, path)
    return read_shards(spark, path).select("slot", "shard", "record", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
