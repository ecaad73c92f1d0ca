"""JSON arrays of records, read by many tasks: large files by byte ranges, broken ones as far as they are whole.

Spark's text source cuts a file into ranges at any separator; with "}" as separator a record ends where a line does. What
a range can't know is where it starts: inside a string, or how deep. So a first scan has each range tell what it does to
that, for a start inside and outside a string: a row for each range reaches the driver, where ranges follow each other
(Spark's driver lists the same ranges to plan the scan). A second scan then knows every range's start and cuts the
records out; those that reach over ranges come in parts and are put together by a shuffle of the parts alone.

A file is OK, EMPTY (nothing but blanks), TRUNCATED (it ends within a string or before the last bracket closes) or INVALID
(it doesn't begin as it must, closes more than it opens, or goes on after its end). Whole records of a broken file are
kept. Records are the objects in the array; other elements are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = b" \t\r\n"
BOM = b"\xef\xbb\xbf"
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1


def _pieces(spark: SparkSession, paths) -> DataFrame:
    raw = spark.read.option("lineSep", "}").text(paths)
    return raw.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))


def _blocks(batches) -> Iterator[tuple[str, int, int, list[bytes]]]:
    """(file, block, size, pieces) a part of a block at a time, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, size = (batch.column(c) for c in ("file", "block", "size"))
        pieces, starts = batch.column("piece").to_pylist(), block.to_numpy()
        names = file.dictionary_encode()
        same = names.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(starts) != 0) | (np.diff(same) != 0)) + 1).tolist(), len(pieces)]
        for a, b in zip(cuts, cuts[1:]):
            yield file[a].as_py(), int(starts[a]), size[a].as_py(), pieces[a:b]


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: how many string borders there are before it, and the step in depth that it would be outside strings."""
    at = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != 92, at, -1))
    run = np.zeros(len(data), np.int64)
    run[1:] = (at - other)[:-1]  # backslashes right before
    quotes = (data == 34) & (run % 2 == 0)
    return np.cumsum(quotes) - quotes, _STEP[data]


def _summaries(batches) -> Iterator[pa.RecordBatch]:
    """A row for each block: borders, then the change and least of depth for a start outside and inside a string (`least`
    leaves the last byte out), its length with all separators, and its first and last byte that isn't blank."""
    done: dict[tuple[str, int], list] = {}
    for file, block, size, pieces in _blocks(batches):
        text = b"}".join(pieces) + b"}"
        data = np.frombuffer(text, np.uint8)
        before, step = _marks(data)
        s = done.setdefault((file, block), [size, 0, 0, 0, 0, 0, 0, b"", b""])
        quotes = int(before[-1] + (data[-1] == 34))
        for start in (0, 1):
            depth = np.cumsum(np.where((before + s[1] + start) % 2 == 0, step, 0))
            change, least = 2 + 2 * start, 3 + 2 * start
            # The last byte of what came before is no longer the block's last.
            s[least] = min(s[least], s[change], s[change] + int(depth[:-1].min(initial=0)))
            s[change] += int(depth[-1])
        s[1] += quotes
        s[6] += len(text)
        bare = text[:-1].removeprefix(BOM) if block == 0 and not s[7] else text[:-1]
        s[7] = s[7] or bare.lstrip(BLANKS)[:1] or (text[-1:] if len(pieces) > 1 else b"")
        s[8] = bare.rstrip(BLANKS)[-1:] or s[8]
    rows = [(f, b, *s) for (f, b), s in done.items()]
    kinds = [pa.string()] + [pa.int64()] * 8 + [pa.binary()] * 2
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in SUMMARY.split(", ")])


SUMMARY = "file string, block long, size long, quotes long, out_change long, out_least long, in_change long, in_least long, length long, first binary, last binary"


@dataclass(frozen=True)
class Start:
    """What a block begins with: depth, whether inside a string, the block in which the record that is open began (or -1), and
    whether its last piece ends the file without a separator."""

    depth: int
    inside: int
    opened: int
    bare: bool


def _follow(rows: list, level: int, opener: bytes) -> tuple[str, dict[int, Start]]:
    """The kind of a file and the start of each of its blocks, from its summaries in order."""
    rows = sorted(rows, key=lambda r: r["block"])
    size, length = rows[0]["size"], sum(r["length"] for r in rows)
    depth = inside = least = 0
    opened, starts = -1, {}
    for r in rows:
        starts[r["block"]] = Start(depth, inside, opened, False)
        change, low = (r["in_change"], r["in_least"]) if inside else (r["out_change"], r["out_least"])
        lowest = min(depth + low, depth + change)
        least = min(least, depth + low) if r is rows[-1] else min(least, lowest)
        depth, inside = depth + change, (inside + r["quotes"]) % 2
        opened = (r["block"] if lowest <= level else opened) if depth > level else -1
    # The last separator was read or was added, as the file's length tells; that of packed files tells nothing.
    bare = length != size and (length == size + 1 or depth != 0)
    if bare:
        starts[rows[-1]["block"]] = Start(*(getattr(starts[rows[-1]["block"]], f) for f in ("depth", "inside", "opened")), True)
        depth += not inside
    else:
        least = min(least, depth)
    first = next((bytes(r["first"]) for r in rows if r["first"]), b"")
    last = next((bytes(r["last"]) for r in reversed(rows) if r["last"]), b"") if bare else b"}"
    if not first or (bare and first == b"}" and length == 1):
        return "EMPTY", starts
    if first != opener or least < 0 or (depth == 0 and not inside and last != {b"[": b"]", b"{": b"}"}[opener]):
        return "INVALID", starts
    return ("OK" if depth == 0 and not inside else "TRUNCATED"), starts


def _cut(batches, starts: dict, level: int, wanted: dict | None, find: str | None) -> Iterator[tuple]:
    """(file, block, opened, ends, text): whole records have opened = -1; parts of one have the block in which it opened. With
    `find`, instead (file, block, piece, kind of event) of the array of that name: where it begins and where it closes."""

    def block_rows(file: str, block: int, parts: Iterator[tuple[list[bytes], bool]]) -> Iterator[tuple]:
        s = starts[file, block]
        depth, inside, opened = s.depth, s.inside, s.opened
        held, piece_no = [], 0  # parts of the record that is open
        in_record = depth > level
        ranges = wanted.get(file, []) if wanted is not None else None
        for pieces, last in parts:
            text = b"}".join(pieces) + (b"" if last and s.bare else b"}")
            if not text:
                continue
            data = np.frombuffer(text, np.uint8)
            before, step = _marks(data)
            step = np.where((before + inside) % 2 == 0, step, 0)
            after = depth + np.cumsum(step)
            if find is not None:
                # Depth 1 is the object whose fields are arrays.
                number = np.cumsum(data == 125) - (data == 125)
                for i in np.flatnonzero(((step == 1) & (after == 2) & (data == 91)) | ((step == -1) & (after == 1) & (data == 93))).tolist():
                    key = _KEY.search(text[max(0, i - 1000) : i]) if data[i] == 91 else None
                    yield file, block, piece_no + int(number[i]), (json.loads(b'"' + key[1] + b'"') == find) if key else (None if data[i] == 93 else False)
            else:
                opens = np.flatnonzero((step == 1) & (after == level + 1) & (data == 123))
                ends = np.flatnonzero((step == -1) & (after == level))
                number = np.cumsum(data == 125) - (data == 125) if ranges is not None else None
                at = 0
                for e in ends.tolist():
                    # An element's text begins at its bracket, or with the part if it was open before.
                    if in_record:
                        held.append(text[at : e + 1])
                        yield file, block, opened if opened >= 0 else -1, True, b"".join(held)
                    else:
                        k = np.searchsorted(opens, at)
                        o = int(opens[k]) if k < len(opens) and opens[k] < e else None
                        if o is not None and (ranges is None or any(a <= (block, piece_no + int(number[o])) <= b for a, b in ranges)):
                            yield file, block, -1, True, text[o : e + 1]
                    held, at, in_record, opened = [], e + 1, False, -1
                if in_record:
                    held.append(text[at:])
                else:
                    k = np.searchsorted(opens, at)
                    if k < len(opens) and (ranges is None or any(a <= (block, piece_no + int(number[opens[k]])) <= b for a, b in ranges)):
                        held, in_record, opened = [text[int(opens[k]) :]], True, -1
            depth, inside = int(after[-1]), (inside + int(before[-1]) + int(data[-1] == 34)) % 2
            piece_no += len(pieces)
        if held and find is None:
            yield file, block, opened if opened >= 0 else block, False, b"".join(held)

    waiting = None

    def parts_of(stream, file, block, first):
        """Parts of one block, the last told; what follows goes to `waiting`."""
        nonlocal waiting
        held = first
        for f, b, _, pieces in stream:
            if (f, b) != (file, block):
                waiting = (f, b, pieces)
                yield held, True
                return
            yield held, False
            held = pieces
        waiting = None
        yield held, True

    stream = _blocks(batches)
    first = next(stream, None)
    waiting = (first[0], first[1], first[3]) if first else None
    while waiting:
        file, block, pieces = waiting
        yield from block_rows(file, block, parts_of(stream, file, block, pieces))


def json_records(spark: SparkSession, paths: str | list[str], schema: T.StructType, field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-1, JSN-1: (records, files) of files that are an array of objects each, or (`field`) an object with such an array.
    records: the schema's columns; files: (file, kind, size). Objects that don't parse have null columns."""
    level, opener = (1, b"[") if field is None else (2, b"{")
    pieces = _pieces(spark, paths)
    # A row for each range of the scan.
    found: dict[str, list] = {}
    for r in pieces.mapInArrow(_summaries, SUMMARY).collect():
        found.setdefault(r["file"], []).append(r)
    kinds, starts = [], {}
    for file, rows in found.items():
        kind, own = _follow(rows, level, opener)
        kinds.append((file, kind, rows[0]["size"]))
        starts |= {(file, block): s for block, s in own.items()}
    # Files without a byte have no range.
    local = re.compile("^file:/+")
    there = {local.sub("/", file) for file in found}
    kinds += [(file, "EMPTY", 0) for file in pieces.inputFiles() if local.sub("/", file) not in there]
    files = spark.createDataFrame(kinds, "file string, kind string, size long")
    wanted = None
    if field is not None:
        # Where the field's arrays begin and close: few rows for each file.
        def events(batches):
            rows = list(_cut(batches, starts, level, None, field))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["file", "block", "piece", "opens"])

        wanted = {}
        edges = pieces.mapInArrow(events, "file string, block long, piece long, opens boolean")
        for r in sorted(edges.filter("opens is null or opens").collect(), key=lambda r: (r["file"], r["block"], r["piece"], r["opens"] is True)):
            own = wanted.setdefault(r["file"], [])
            if r["opens"]:
                own.append(((r["block"], r["piece"]), (float("inf"), 0)))
            elif own and own[-1][1][0] == float("inf"):
                own[-1] = (own[-1][0], (r["block"], r["piece"]))

    def records(batches):
        rows, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["file", "block", "opened", "ends", "text"])

        for row in _cut(batches, starts, level, wanted, None):
            rows.append(row)
            size += len(row[4])
            if size > 4 << 20:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    cut = pieces.mapInArrow(records, "file string, block long, opened long, ends boolean, text binary")
    whole = cut.filter("ends and opened = -1").select("text")
    # One record's parts; those of other elements lack the one where a record begins.
    parts = cut.filter("not ends or opened >= 0").groupBy("file", "opened").agg(F.max("ends").alias("ends"), F.min("block").alias("first"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    parts = parts.filter("ends and first = opened")
    joined = parts.select(F.aggregate("parts.text", F.lit(b""), lambda a, b: F.concat(a, b)).alias("text"))
    text = F.decode("text", "UTF-8")
    return whole.union(joined).select(F.from_json(text, schema).alias("r")).select("r.*"), files
