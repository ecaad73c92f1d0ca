"""Token ids of whole texts, by a public tokenizer file, a batch of Arrow strings at a time.

A batch is cut into segments at places that no token reaches over, its distinct segments are found by Arrow, those not
met before go to the tokenizer, and the ids of all texts are gathered from those of their segments by numpy. This holds
for one family of tokenizers, told by its file (`WORDS`); with any other file every text goes to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The parts of a tokenizer file that drop white space, ignore case and end each word with a piece of its own.
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Bytes of text that are worked on at once, and segments whose ids are kept.
SLAB, KEPT = 2 << 20, 300_000
_BLANK, _ALNUM, _MARK, _QUOTE, _BEYOND = range(5)
_CLASS = np.array([_BLANK if b in b" \t\n\x0b\x0c\r" else _BEYOND if b >= 128 else _ALNUM if chr(b).isalnum() else _QUOTE if b == 39 else _MARK for b in range(256)], np.uint8)
# A segment ends at white space, and where letters or digits meet an ASCII mark that isn't an apostrophe.
_CUT = np.array([[a != b and (_BLANK in (a, b) or {a, b} == {_ALNUM, _MARK}) for b in range(5)] for a in range(5)]).ravel()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LETTER = np.array([97 <= b <= 122 for b in range(256)])
# U+00C0 to U+017F but three are letters of two bytes, as are their small ones.
_LATIN = np.array([c not in (0xD7, 0xF7, 0x130) for c in range(0xC0, 0x180)])
_SMALL = np.array([ord(chr(c).lower()) if c != 0x130 else c for c in range(0xC0, 0x180)], np.int32)
_BLANKS = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: A word that no text should hold, between segments that may be of several words.
BETWEEN = "\x01"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes(data: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """The class of each byte; in `low`, bytes of large letters of U+00C0 to U+017F become those of small ones."""
    kinds = _CLASS[data]
    at = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5) & ((data[1:] & 0xC0) == 0x80))
    code = (data[at].astype(np.int32) & 0x1F) * 64 + (data[at + 1] & 0x3F) - 0xC0
    good = _LATIN[code]
    at, code = at[good], code[good]
    kinds[at] = kinds[at + 1] = _ALNUM
    if low is not None:
        small = _SMALL[code]
        low[at], low[at + 1] = 0xC0 | small >> 6, 0x80 | small & 0x3F
    return kinds


class WordEncoder:
    """Texts -> their ids as numbers of `kind`, which must hold the vocabulary's largest id."""

    def __init__(self, path: str, kind: str = "<u4", kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind, self.limit = np.dtype(kind), kept
        self.whole = Tokenizer.from_file(path)
        vocab = self.whole.get_vocab(with_added_tokens=True)
        if max(vocab.values()) > np.iinfo(self.kind).max:
            raise ValueError(f"{path} has ids that {kind} can't hold")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words = all(spec.get(k) == v for k, v in WORDS.items()) and spec["model"].get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
        if self.by_words:
            # Words of small letters of a-z and U+00C0 to U+017F are one word, and their own normal form.
            bare = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, WORDS["pre_tokenizer"]["pretokenizers"][1]]}
            self.bare = Tokenizer.from_str(json.dumps({**spec, "normalizer": None, "pre_tokenizer": bare, "post_processor": None, "added_tokens": []}))
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
            self.between = self._ids(self.whole, [BETWEEN])[0]
            self._forget()

    def _forget(self) -> None:
        self.known, self.size, self.flat = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _ids(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [np.array(e.ids, np.int64) for e in batch(texts, add_special_tokens=False)]

    def _letters(self, segments: list[bytes], at_once: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number, of words of letters: joined, as each has one piece that ends it."""
        texts = [b" ".join(segments[i : i + at_once]).decode() for i in range(0, len(segments), at_once)]
        ids = np.concatenate([np.zeros(0, np.int64), *self._ids(self.bare, texts)])
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _others(self, segments: list[bytes], at_once: int = 200) -> tuple[np.ndarray, np.ndarray]:
        texts = [s.decode("utf-8", "replace") for s in segments]
        found: list[np.ndarray] = []
        for i in range(0, len(texts), at_once):
            some = texts[i : i + at_once]
            ids = self._ids(self.whole, [f" {BETWEEN} ".join(some)])[0]
            at = np.flatnonzero(ids == self.between[0])
            plain = len(self.between) == 1 and len(at) == len(some) - 1 and not any(BETWEEN in t for t in some)
            found += [p if k == 0 else p[1:] for k, p in enumerate(np.split(ids, at))] if plain else self._ids(self.whole, some)
        return np.concatenate([np.zeros(0, np.int64), *found]), np.array([len(x) for x in found], np.int64)

    def _learn(self, new: pa.Array) -> None:
        """The ids of segments that weren't known, behind those of the known ones."""
        offsets = np.frombuffer(new.buffers()[1], np.int32)[new.offset : new.offset + len(new) + 1]
        data = np.frombuffer(new.buffers()[2], np.uint8)
        data = data[: offsets[-1]]
        plain = np.logical_and.reduceat(_LETTER[data] | ((data >= 128) & (_classes(data) == _ALNUM)), offsets[:-1])
        blank = _CLASS[data[offsets[:-1]]] == _BLANK
        plain, other, blank = (new.filter(pa.array(x)) for x in (plain, ~plain & ~blank, blank))
        (ids, size), (more, sizes) = self._letters(plain.to_pylist()), self._others(other.to_pylist())
        self.known = pa.concat_arrays([self.known, plain, other, blank])
        self.size = np.concatenate([self.size, size, sizes, np.zeros(len(blank), np.int64)])
        self.flat = np.concatenate([self.flat, ids.astype(self.kind), more.astype(self.kind)])

    def _slab(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other, text i from starts[i] to starts[i + 1], and where theirs start."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(starts), np.int64)
        low = _LOWER[data]
        kinds = _classes(data, low)
        # Letters may join with marks of U+0300 to U+037F, and names of special tokens count as they are written: texts with
        # either are cut at white space only and keep their case.
        odd = np.add.reduceat(np.append((data == 0xCC) | (data == 0xCD) | ((data == 60) & np.append(data[1:] == 124, False)), False).astype(np.int32), starts[:-1])
        for i in np.flatnonzero((odd > 0) & (starts[1:] > starts[:-1])):
            at = slice(starts[i], starts[i + 1])
            low[at], kinds[at] = data[at], np.where(kinds[at] == _BLANK, np.uint8(_BLANK), np.uint8(_BEYOND))
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = _CUT[kinds[:-1] * np.uint8(5) + kinds[1:]]
        cut[starts] = True
        cuts = np.flatnonzero(cut)
        segments = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(low)]).dictionary_encode()
        if len(self.known) > self.limit:
            self._forget()
        found = pc.index_in(segments.dictionary, value_set=self.known)
        if found.null_count:
            self._learn(segments.dictionary.filter(pc.is_null(found)))
            found = pc.index_in(segments.dictionary, value_set=self.known)
        slot = found.to_numpy()[segments.indices.to_numpy()]
        size = self.size[slot]
        before = np.cumsum(size) - size
        total = int(size.sum())
        place = np.repeat((np.cumsum(self.size) - self.size)[slot] - before, size) + np.arange(total)
        return self.flat[place], np.append(before, total)[np.searchsorted(cuts, starts)]

    def ids(self, texts: Iterable[bytes | None], slab: int = SLAB) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if not self.by_words:
            for t in texts:
                yield self._ids(self.whole, [(t or b"").decode("utf-8", "replace")])[0].astype(self.kind)
            return
        held, size = [], 0
        for t in texts:
            held.append(t or b"")
            size += len(held[-1])
            if size >= slab:
                yield from self._texts(held, slab)
                held, size = [], 0
        yield from self._texts(held, slab)

    def _texts(self, texts: list[bytes], slab: int) -> Iterator[np.ndarray]:
        *short, last = texts or [b""]
        if len(last) > slab:
            yield from self._texts(short, slab) if short else ()
            yield np.concatenate([self._joined([part])[0] for part in _parts(last, slab)])
        elif texts:
            yield from self._joined(texts)

    def _joined(self, texts: list[bytes]) -> list[np.ndarray]:
        starts = np.cumsum([0, *map(len, texts)])
        ids, at = self._slab(np.frombuffer(b"".join(texts), np.uint8), starts)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def encode(self, texts: Iterable[bytes | None], slab: int = SLAB) -> Iterator[bytes]:
        """`ids` as bytes."""
        return (x.tobytes() for x in self.ids(texts, slab))


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """A long text cut at white space, into parts of some `size` bytes or of one word."""
    at = 0
    while at < len(text):
        found = _BLANKS.search(text, at + size)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end
