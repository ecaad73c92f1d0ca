"""Operator 5, token counts by a linear longest-match automaton.

The vocabulary becomes a trie over bytes, with one more symbol for the end of a word. Every node has a failure link and
the number of pieces that following the link completes, computed once, so a word is read once, symbol by symbol, and its
greedy longest-match piece count comes out without any piece being built. Words are runs of letters, digits and
characters beyond ASCII with A-Z as a-z; every other visible ASCII character is a word of its own.

Cases: null and empty texts have no words and no tokens; repeated rows are counted each; a word with a symbol that no
piece covers counts as one unknown token; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import col, ChunkCache
from tamis.llm.tokens import tokenizer_path

#: The symbol after a word's last byte.
END = 256
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20]")


def _byte_of_letter() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: visible ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(path: str, end_mark: str = "</w>") -> set[tuple[int, ...]]:
    """The pieces as symbols: bytes, and END for the end mark."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    byte = _byte_of_letter()
    pieces = set()
    for piece in spec["model"]["vocab"]:
        if piece in special:
            continue
        body = piece.removesuffix(end_mark)
        pieces.add(tuple(byte[c] for c in body) + (END,) * (body != piece))
    return pieces


class LongestMatch:
    """Greedy longest-match counts in time linear in the word."""

    def __init__(self, pieces: set[tuple[int, ...]]):
        go: list[dict[int, int]] = [{}]
        count: dict[int, int] = {}
        # A bare end mark is what is left when the last piece doesn't reach over it; it is no piece.
        for piece in [*pieces, (END,)]:
            v = 0
            for c in piece:
                nxt = go[v].get(c)
                if nxt is None:
                    go.append({})
                    nxt = go[v][c] = len(go) - 1
                v = nxt
            count[v] = count.get(v, 0) or int(piece != (END,))
        fail, pops = [-1] * len(go), [0] * len(go)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in go[u].items():
                if v in count:
                    fail[v], pops[v] = 0, count[v]
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and c not in go[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = go[z][c], n
                todo.append(v)
        self.go, self.fail, self.pops = go, fail, pops

    @classmethod
    def of(cls, tables: tuple) -> LongestMatch:
        match = cls.__new__(cls)
        match.go, match.fail, match.pops = tables
        return match

    def count(self, word: bytes) -> int:
        go, fail, pops = self.go, self.fail, self.pops
        v = n = 0
        for c in (*word, END):
            while (nxt := go[v].get(c)) is None:
                n += pops[v]
                v = fail[v]
                if v < 0:
                    return 1
            v = nxt
        while v:
            n += pops[v]
            v = fail[v]
            if v < 0:
                return 1
        return n


def count_tokens(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, max_word_tokens) of every document."""
    # The vocabulary's size bounds the automaton; a worker unpacks it once for all its tasks.
    built = LongestMatch(vocabulary(tokenizer or tokenizer_path("word_bpe_49k.json")))
    automaton = docs.sparkSession.sparkContext.broadcast((built.go, built.fail, built.pops))

    def run(batches):
        match = LongestMatch.of(automaton.value)

        def measure(chunks):
            for chunk in chunks:
                counts = [match.count(w) for w in _WORD.findall(chunk.lower())]
                yield len(counts), sum(counts), max(counts, default=0)

        cache = ChunkCache(measure)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                chunks = (t or b"").split()
                found = list(map(cache.have(set(chunks)).__getitem__, chunks))
                words, tokens, most = zip(*found) if found else ((), (), (0,))
                rows.append((sum(words), sum(tokens), max(most)))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_words", "n_tokens", "max_word_tokens"])

    return docs.select(col(doc).cast("long"), col(text).cast("string").cast("binary")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, max_word_tokens long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
