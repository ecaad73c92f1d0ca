"""Search without reading every text: postings of three-letter pieces, intersected, then verified on the texts.

The index keeps the texts by id and, for each piece of a text, the rows that have it, in ranges of the piece; both are
change tables, so a batch of new or changed rows costs the batch. Postings are kept by parts of up to PART rows: a row for
each piece of a part with the places in the part of those who have it, and one with the part's ids, which lies under the
part's own name as its piece. So their number is that of a part's different pieces, not of all texts'. A search reads how
common its pieces are, then the postings of the rarest few, and the texts of the ids that have them all. A changed row
leaves old postings behind, which the texts refute. Searches of one or two letters have no piece and read all texts, as do
those whose rarest piece is in a large share of them; either way the rows are those of a scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.components import remove_path, stored
from tamis.sources.change_table import ChangeTable

PIECE = 3
#: Pieces whose postings are read, and the share of the texts in which the rarest may be.
RAREST, SHARE = 4, 0.2


#: Rows of a part, at most 32,767, and the postings at which it ends before.
PART, MOST = 4096, 1 << 21


def pieces(text: str) -> np.ndarray:
    """The distinct pieces of a text, none if it is too short: the code points of each as one number."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])


def _rows(name: str, ids: list, found: list[np.ndarray], kinds: list[pa.DataType]) -> pa.RecordBatch:
    """A part's rows: its pieces in order with the places of those who have them, then its ids."""
    place = np.repeat(np.arange(len(found), dtype=np.int16), [len(f) for f in found])
    piece = np.concatenate(found)
    order = np.argsort(piece, kind="stable")
    piece = piece[order]
    begins = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else np.array([], np.int64)
    own = piece[begins]
    letters = np.stack([own >> 42, (own >> 21) & 0x1FFFFF, own & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    n = len(own)
    ends = [*begins.tolist(), len(piece), len(piece)]
    columns = [
        pa.array([letters[i : i + PIECE] for i in range(0, PIECE * n, PIECE)] + [name], kinds[0]), pa.array([name] * (n + 1), kinds[1]),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order])), pa.array([None] * n + [ids], kinds[3]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["piece", "part", "places", "ids"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) -> rows of postings."""
    ids, found, size, kinds = [], [], 0, None
    for batch in batches:
        kinds = [pa.string(), pa.string(), pa.list_(pa.int16()), pa.list_(batch.schema.field(0).type)]
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(id_)
            found.append(pieces(text.decode("utf-8", "replace")))
            size += len(found[-1])
            if len(ids) == PART or size >= MOST:
                yield _rows(uuid.uuid4().hex, ids, found, kinds)
                ids, found, size = [], [], 0
    if ids and kinds:
        yield _rows(uuid.uuid4().hex, ids, found, kinds)


class SearchIndex:
    """The index at `path` over rows with an id and one searched text, of the type given."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", *, ranges: int = 64, fan: int = 8):
        table = lambda name, schema, keys: ChangeTable(spark, f"{path}/{name}", schema, keys, ranges=ranges, fan=fan)
        self.spark, self.path = spark, path.rstrip("/")
        self.texts = table("texts", f"id {id_type}, text string", ["id"])
        self.postings = table("postings", f"piece string, part string, places array<short>, ids array<{id_type}>", ["piece", "part"])
        self.common = table("common", "piece string, batch long, n long", ["piece", "batch"])

    def add(self, rows: DataFrame, number: int, id_: str, columns: list[str]) -> None:
        """Adds a batch: an id and the columns that are searched, joined with blanks, in small letters. Batches have growing
        numbers; a repeated one changes nothing. Of rows that repeat an id within a batch the greatest text counts."""
        if number <= self.texts.upto():
            return
        paths: list[str] = []
        given = rows.select(F.col(id_).alias("id"), F.lower(F.concat_ws(" ", *columns)).alias("text")).groupBy("id").agg(F.max("text").alias("text"))
        given = stored(given, "searched", paths)
        told = stored(given.mapInArrow(_parts, self.postings.schema), "postings", paths)
        counts = told.filter("ids is null").groupBy("piece").agg(F.sum(F.size("places")).alias("n"))
        self.common.append(counts.withColumn("batch", F.lit(number)), number, single=True)
        self.postings.append(told, number, single=True)
        self.texts.append(given, number, single=True)
        for p in paths:
            remove_path(self.spark, p)

    def _stored(self, df: DataFrame) -> DataFrame:
        """Candidates of one search in the index's folder, which goes with it."""
        path = f"{self.path}/hits-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def rarest(self, q: str) -> list[tuple[str, int]]:
        """The search's pieces with the number of rows that have them, the rarest first."""
        own = sorted({q[i : i + PIECE] for i in range(len(q) - PIECE + 1)})
        if not own:
            return []
        counts = dict.fromkeys(own, 0)
        asked = self.spark.createDataFrame([(p,) for p in own], "piece string")
        # A row for each of the search's pieces.
        counts |= {r["piece"]: r["n"] for r in self.common.lookup(asked).groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        return sorted(counts.items(), key=lambda x: (x[1], x[0]))

    def search(self, q: str, rows: int | None = None) -> DataFrame:
        """FLT-1, FLT-26: (id, text) of the rows whose text holds the search, whatever its case; all for an empty one. `rows` is
        the number of rows, counted if it isn't given."""
        q = q.strip().lower()
        found = self.rarest(q)
        if found and found[0][1] <= SHARE * (self.texts.read().count() if rows is None else rows):
            few = [p for p, _ in found[:RAREST]]
            asked = self.spark.createDataFrame([(p,) for p in few], "piece string")
            # Lists of a part, as many as the pieces.
            lists = self.postings.lookup(asked).groupBy("part").agg(F.collect_list("places").alias("l")).filter(F.size("l") == len(few))
            all_ = F.aggregate(F.slice("l", 2, len(few)), F.get("l", F.lit(0)), F.array_intersect)
            hits = lists.select(F.col("part").alias("piece"), all_.alias("hits")).filter(F.size("hits") > 0)
            hits = self._stored(hits)
            ids = self.postings.lookup(hits.select("piece")).join(hits, "piece").select(F.explode(F.transform("hits", lambda p: F.get("ids", p.cast("int")))).alias("id"))
            ids = self._stored(ids.distinct())
            texts = self.texts.lookup(ids)
        else:
            texts = self.texts.read()
        return texts.filter(F.col("text").contains(q)) if q else texts
