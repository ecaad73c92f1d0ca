"""Operator 2, quality rules: distribution divergence.

A first pass over all documents counts, for each language, the bytes of every character class and the words of those
with at most one symbol for ten words, so that junk doesn't blur what a language looks like; the most common words of a language with enough words are its vocabulary. A second pass compares each document's character-class
histogram and its histogram over the common words (and all others together) with its language's by the Jensen-Shannon
distance (base 2, so 0 to 1). A document is rejected when a distance passes its threshold, and each comparison is made
only for documents that are long enough. The word threshold of a language is a share of the distance that a text without
any of its common words has, so that such a text can reach it, with a term for short texts. Base rules count short and
self-repeating texts.

Cases: null and empty texts have no words and fail the base rule; a null language counts as the empty one; a language
with fewer than `min_reference_words` words has no reference, and its documents are judged by the base rule alone;
repeated rows are judged alike, each by itself; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamis.llm.common import col

SYMBOLS = b"#*$%&|<>"
#: Character classes by UTF-8 byte: lower, upper, digit, blank, newline, sentence marks, symbols, other ASCII, beyond ASCII (counted at the first byte).
CLASSES = 9
_CLASS = np.full(256, 7)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:!?'\"-()", SYMBOLS)):
    _CLASS[list(_chars)] = _k
_CLASS[0xC0:] = 8
_ONE_HOT = np.eye(CLASSES, dtype=np.int64)[_CLASS]
_ONE_HOT[0x80:0xC0] = 0
_SPACE, _SYM = [9, 10, 11, 12, 13, 32], list(SYMBOLS)
_EDGES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_POWERS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) ** 7 % 2**64 | 1 for k in range(8)], np.uint64)

COMMON, MIN_REFERENCE_WORDS = 40, 2_000
#: A histogram of n characters strays by about 1 / sqrt(n) from its language's, which is added to the threshold.
MIN_CHARS, MAX_CHAR_DISTANCE = 100, 0.18
MIN_WORDS, MAX_WORD_DISTANCE = 60, 0.45
#: A long text passes at most this share of the distance of a text without common words; a text of n words strays by more
#: (the squared distance by about bins / (8 ln 2 n), here with a third on top).
WORD_SHARE, WORD_SPREAD = 0.5, 1.35
#: Distinct words that a task holds before it hands its counts on.
FLUSH = 200_000


def plain_words(text: bytes) -> list[bytes]:
    """Words for the histograms: A-Z lower-cased, ASCII other than letters and digits cut away."""
    return text.lower().translate(_EDGES).split()


def n_repeat_words(words: list[bytes], size: int = 8) -> int:
    """Words inside runs of `size` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    runs = h[:n] * _POWERS[0]
    for j in range(1, size):
        runs = runs + h[j : j + n] * _POWERS[j]
    s = np.sort(runs)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(runs, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def n_dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Root of the Jensen-Shannon divergence of two histograms, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def word_threshold(reference: np.ndarray, n: int, share: float) -> float:
    """Largest word distance of a text of n words; `reference` ends with the count of all words that aren't common."""
    without = np.zeros(len(reference))
    without[-1] = 1
    return ((share * js_distance(without, reference)) ** 2 + WORD_SPREAD * (len(reference) - 1) / (8 * np.log(2) * n)) ** 0.5


def _count(batches):
    """(lang, kind, key, n): bytes of each character class and words, summed in the task."""
    classes: dict = {}
    words: dict[str, Counter] = {}

    def out():
        rows = [(lang, "c", str(k).encode(), int(v)) for lang, c in classes.items() for k, v in enumerate(c)]
        rows += [(lang, "w", w, n) for lang, c in words.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary(), pa.int64()))], ["lang", "kind", "key", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            bc = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            plain = plain_words(text)
            if 10 * bc[_SYM].sum() <= len(plain):
                classes[lang] = classes.get(lang, 0) + bc @ _ONE_HOT
                words.setdefault(lang, Counter()).update(plain)
        if sum(map(len, words.values())) > FLUSH:
            yield out()
            classes, words = {}, {}
    if classes:
        yield out()


def language_references(docs: DataFrame, *, lang: str = "lang", text: str = "text", common: int = COMMON, min_reference_words: int = MIN_REFERENCE_WORDS) -> dict[str, dict]:
    """lang -> {"classes": counts, "words": {word: count}, "other": count}; a few dozen rows for each language reach the driver."""
    counts = docs.select(F.coalesce(col(lang), F.lit("")).alias("lang"), F.coalesce(col(text), F.lit("")).cast("binary").alias("text")).mapInArrow(_count, "lang string, kind string, key binary, n long")
    counts = counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    # The few most common words of each task's share first, so that no task gets all words of a language.
    share = counts.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(64)))
    falling = (F.desc("n"), F.asc("key"))
    top = share.withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind", "share").orderBy(*falling))).filter(F.col("r") <= common)
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(*falling))).filter((F.col("r") <= common) | (F.col("kind") == "c"))
    found: dict[str, dict] = {}
    for r in top.join(total, ["lang", "kind"]).select("lang", "kind", "key", "n", "total").collect():
        ref = found.setdefault(r["lang"], {"classes": np.zeros(CLASSES), "words": {}, "total": 0})
        if r["kind"] == "c":
            ref["classes"][int(r["key"])] = r["n"]
        else:
            ref["words"][bytes(r["key"])] = r["n"]
            ref["total"] = r["total"]
    return {k: v for k, v in found.items() if v["total"] >= min_reference_words}


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def judge(docs: DataFrame, *, carry: list[str] | None = None, lang: str = "lang", text: str = "text", min_chars: int = MIN_CHARS, max_char_distance: float = MAX_CHAR_DISTANCE, min_words: int = MIN_WORDS, max_word_distance: float = MAX_WORD_DISTANCE, word_share: float | None = WORD_SHARE, **options) -> DataFrame:
    """The `carry` columns (all by default) as struct `row`, and BASE's columns; without `word_share`, `max_word_distance` alone holds."""
    references = language_references(docs, lang=lang, text=text, **options)
    refs = {}
    for key, ref in references.items():
        index = {w: i for i, w in enumerate(sorted(ref["words"]))}
        words = np.array([ref["words"][w] for w in sorted(ref["words"])] + [ref["total"] - sum(ref["words"].values())], float)
        refs[key] = (index, words, ref["classes"].astype(float))

    def verdict(lang: str, text: bytes) -> tuple:
        bc = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        n = len(words)
        repeated = n_repeat_words(words)
        failed = n < 20 or 100 * repeated > 30 * n
        char_d = word_d = None
        max_word_d = max_word_distance
        classes = (bc @ _ONE_HOT).astype(float)
        if lang in refs:
            index, ref_words, ref_classes = refs[lang]
            if classes.sum() >= min_chars:
                char_d = js_distance(classes, ref_classes)
            plain = plain_words(text)
            if len(plain) >= min_words:
                hist = np.bincount(np.fromiter((index.get(w, len(index)) for w in plain), np.int64, len(plain)), minlength=len(index) + 1).astype(float)
                word_d = js_distance(hist, ref_words)
                if word_share is not None:
                    max_word_d = min(max_word_d, word_threshold(ref_words, len(plain), word_share))
        kept = not (failed or (char_d or 0) > max_char_distance + 1 / max(1, classes.sum()) ** 0.5 or (word_d or 0) > max_word_d)
        return n, int(len(text) - bc[128:192].sum() - bc[_SPACE].sum()), int(bc[_SYM].sum()), n_dup_lines(text), repeated, failed, char_d, word_d, kept

    def run(batches):
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            rows = [verdict(*x) for x in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *(c.split()[0] for c in BASE.split(", "))])

    given = docs.select(F.struct(*map(col, carry or docs.columns)).alias("row"), F.coalesce(col(lang), F.lit("")).alias("_lang"), F.coalesce(col(text), F.lit("")).cast("binary").alias("_text"))
    return given.mapInArrow(run, StructType([given.schema["row"], *StructType.fromDDL(BASE)]))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    judged = judge(docs, carry=["doc_id"])
    return judged.select("row.doc_id", *(c.split()[0] for c in BASE.split(", ") if "distance" not in c))


_CLASS_SQL = ["[a-z]", "[A-Z]", "[0-9]", r"[ \t\r\x0b\x0c]", r"\n", r"""[.,;:!?''"()-]""", r"[#*$%&|<>]"]
_COUNTS = ", ".join(f"len(regexp_extract_all(t, '{c}'))" for c in _CLASS_SQL)
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS p,
  [{_COUNTS}] AS c, len(regexp_extract_all(t, '[^\x00-\x7F]')) AS beyond FROM d),
v AS (SELECT doc_id, lang, t, w, p, list_concat(c, [length(t) - list_sum(c) - beyond, beyond]) AS c, c[7] AS n_symbols, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars FROM w),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM v WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM v),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
r AS (SELECT * FROM v WHERE 10 * n_symbols <= len(p)),
rc AS (SELECT lang, k, CAST(sum(c[k]) AS DOUBLE) AS n FROM r, range(1, 10) k(k) GROUP BY 1, 2),
rw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(p) AS word FROM r) GROUP BY 1, 2),
tot AS (SELECT lang, sum(n) AS total FROM rw GROUP BY 1 HAVING sum(n) >= {MIN_REFERENCE_WORDS}),
top AS (SELECT rw.lang, word, n FROM rw JOIN tot ON rw.lang = tot.lang QUALIFY row_number() OVER (PARTITION BY rw.lang ORDER BY n DESC, word) <= {COMMON}),
qw AS (SELECT lang, word, n / total AS q FROM top JOIN tot USING (lang) UNION ALL SELECT lang, NULL, (max(total) - sum(n)) / max(total) FROM top JOIN tot USING (lang) GROUP BY 1),
qc AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM rc WHERE lang IN (SELECT lang FROM tot)),
th AS (SELECT lang, {WORD_SHARE} * {WORD_SHARE} * (log2(2 / (1 + o)) + 1 - o + CASE WHEN o > 0 THEN o * log2(2 * o / (1 + o)) ELSE 0 END) / 2 AS without, {WORD_SPREAD} * bins / (8 * ln(2)) AS spread
  FROM (SELECT lang, count(word) AS bins, max(CASE WHEN word IS NULL THEN q END) AS o FROM qw GROUP BY 1)),
dw AS (SELECT doc_id, v.lang, top.word, count(*) AS n FROM (SELECT doc_id, lang, unnest(p) AS word FROM v WHERE len(p) >= {MIN_WORDS}) v LEFT JOIN top ON v.lang = top.lang AND v.word = top.word GROUP BY 1, 2, 3),
pw AS (SELECT doc_id, lang, word, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM dw),
jw AS (SELECT v.doc_id, coalesce(pw.p, 0) AS p, qw.q FROM v JOIN qw ON v.lang = qw.lang LEFT JOIN pw ON pw.doc_id = v.doc_id AND pw.word IS NOT DISTINCT FROM qw.word WHERE len(v.p) >= {MIN_WORDS}),
jc AS (SELECT v.doc_id, c[k] / list_sum(c) AS p, q FROM v JOIN qc ON v.lang = qc.lang WHERE list_sum(c) >= {MIN_CHARS}),
js AS (SELECT 'w' AS kind, doc_id, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS d FROM jw GROUP BY 2
  UNION ALL SELECT 'c', doc_id, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 FROM jc GROUP BY 2),
b AS (SELECT v.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) AS n, least({MAX_WORD_DISTANCE}, sqrt(without + spread / greatest(1, len(p)))) AS most FROM v LEFT JOIN th ON th.lang = v.lang LEFT JOIN dup ON dup.doc_id = v.doc_id LEFT JOIN rep ON rep.doc_id = v.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(sqrt(greatest(0, jc.d)) > {MAX_CHAR_DISTANCE} + 1 / sqrt(n), false) OR coalesce(sqrt(greatest(0, jw.d)) > most, false)) AS kept
FROM f LEFT JOIN js jc ON jc.doc_id = f.doc_id AND jc.kind = 'c' LEFT JOIN js jw ON jw.doc_id = f.doc_id AND jw.kind = 'w'
"""
