"""Operator 6, toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model over a sentence's words and their beginnings gives each sentence a
score, a document's score is their noisy-or (one minus the product of one minus each), and the likelihood of the documents' labels under
that score trains the sentence model, so sentences need no labels. Afterwards the sentences above one half are the
offending ones. Training takes a sample of labelled documents, the first by a hash of their id and text, of at most
MAX_TRAINING_DOCUMENTS and MAX_TRAINING_BYTES; every document is scored over its whole text.

Cases: null and empty texts have one empty sentence and the score of the bias alone; a document with several labels
trains once, with the largest; null labels and labels without a document don't train, nor count for the sample's bounds;
repeated rows train and are scored each; without any labelled document all scores are 0, and if there are some but
none fits the bounds, training fails; labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import ChunkCache, col
from tamis.llm.quality import plain_words

MAX_TRAINING_DOCUMENTS, MAX_TRAINING_BYTES = 8_000, 64_000_000
#: A feature counts if it is in so many training documents, and in toxic ones more often than by chance by so many deviations.
MIN_DOCUMENTS, MIN_DEVIATIONS, MAX_FEATURES = 6, 4.0, 5_000
ROUNDS, RATE, L2 = 300, 0.08, 1e-4
#: Lengths of the beginnings of words that are features besides whole words: inflected and compound forms share them.
STEMS = (5, 6, 7, 8)
_ENDS = re.compile(rb"[.!?\n]+")


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges between ends of sentences, those without any character left out; an empty text has one empty range."""
    at, found = 0, []
    for m in _ENDS.finditer(text):
        if m.start() > at:
            found.append((at, m.start()))
        at = m.end()
    if at < len(text) or not found:
        found.append((at, len(text)))
    return found


def held_out(doc) -> F.Column:
    return F.crc32(col(doc).cast("string").cast("binary")) % 5 == 0


def features(word: bytes) -> list[bytes]:
    return [word + b"$", *(word[:n] for n in STEMS if len(word) >= n)]


class SentenceModel:
    """bias and a weight for each word; `fit` maximises the documents' noisy-or likelihood by full-batch Adam."""

    def __init__(self, bias: float = -50.0, weights: dict[bytes, float] | None = None):
        self.bias, self.weights = bias, weights or {}

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int], rounds: int = ROUNDS) -> SentenceModel:
        if not texts:
            return cls()
        # One object for each distinct word, as words repeat.
        same: dict[bytes, bytes] = {}
        bags = [[[same.setdefault(w, w) for w in plain_words(t[a:b])] for a, b in sentences(t)] for t in texts]
        seen, toxic = Counter(), Counter()
        for bag, label in zip(bags, labels):
            own = {f for w in {w for s in bag for w in s} for f in features(w)}
            seen.update(own)
            if label:
                toxic.update(own)
        base = sum(labels) / len(labels)
        apart = {f: (toxic[f] - base * n) / math.sqrt(base * n * (1 - base)) for f, n in seen.items() if n >= MIN_DOCUMENTS and f in toxic} if 0 < base < 1 else {}
        chosen = sorted((f for f, z in apart.items() if z >= MIN_DEVIATIONS), key=lambda f: (-apart[f], f))[:MAX_FEATURES]
        index = {f: i for i, f in enumerate(chosen)}
        word, sentence, doc, n = [], [], [], 0
        for d, bag in enumerate(bags):
            for s in bag:
                hits = [index[f] for w in set(s) for f in features(w) if f in index]
                word.extend(sorted(hits))
                sentence.extend([n] * len(hits))
                doc.append(d)
                n += 1
        word, sentence, doc = (np.array(x, np.int64) for x in (word, sentence, doc))
        y = np.array(labels, float)
        w, bias = np.zeros(len(index)), math.log(0.02)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, rounds + 1):
            z = bias + np.bincount(sentence, w[word], minlength=n)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))  # log of no sentence being toxic
            q = np.clip(np.exp(clean), 1e-9, 1 - 1e-9)
            # d loss / d z of a sentence is p for a clean document and -p q / (1 - q) for a toxic one.
            g = (np.where(y == 1, -q / (1 - q), 1.0) / len(y))[doc] * p
            gw = np.bincount(word, g[sentence], minlength=len(w)) + L2 * w
            gb = g.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            w -= RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            bias -= RATE * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
        return cls(float(bias), {k: float(w[i]) for k, i in index.items()})

    def weigh(self, words: list[bytes]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in features(w)]) for w in words]

    def score(self, text: bytes, cache: ChunkCache | None = None) -> tuple[float, list[tuple[int, int, float]]]:
        """(document's score, offending sentences as byte ranges with their scores)."""
        bias, clean, bad = self.bias, 0.0, []
        have = (cache or ChunkCache(self.weigh)).have(set(plain_words(text))).__getitem__
        for a, b in sentences(text):
            z = bias + sum(map(have, set(plain_words(text[a:b]))))
            z = -30.0 if z < -30 else 30.0 if z > 30 else z
            clean -= math.log1p(math.exp(z))
            if z >= 0:
                bad.append((a, b, 1 / (1 + math.exp(-z))))
        return -math.expm1(clean), bad


def training_sample(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAINING_DOCUMENTS, max_bytes: int = MAX_TRAINING_BYTES) -> DataFrame:
    """(text, label) of labelled documents that are not held out: the first by a hash of their id and text, at most `most`
    and `max_bytes` of text. Those that don't fit into what is left of the bytes are passed over; if there are labelled
    documents and none fits, that is an error."""
    known = labels.filter(col(label).isNotNull() & ~held_out(doc)).groupBy(col(doc).alias("_doc")).agg(F.max(col(label)).alias("label"))
    texts = docs.select(col(doc).alias("_doc"), F.coalesce(col(text), F.lit("")).cast("binary").alias("text"))
    texts = texts.withColumns({"p0": F.xxhash64("_doc"), "p1": F.xxhash64("text")})
    # Places and lengths first, without the texts: three numbers for each of `most` rows reach the driver.
    found = texts.select("_doc", "p0", "p1", F.octet_length("text").alias("n")).join(known, "_doc")
    chosen, held = Counter(), 0
    for r in found.filter(F.col("n") <= max_bytes).orderBy("p0", "p1").limit(most).collect():
        if held + r["n"] <= max_bytes:
            held += r["n"]
            chosen[r["p0"], r["p1"], int(r["label"])] += 1
    if not chosen and found.head(1):
        raise ValueError(f"no labelled document fits into {most} documents of {max_bytes} bytes")
    # `most` rows of four numbers at most, which bounds the broadcast; a repeated row is there as often as it was chosen.
    places = F.broadcast(docs.sparkSession.createDataFrame([(*p, n) for p, n in chosen.items()], "p0 long, p1 long, label int, n int"))
    once = texts.join(places, ["p0", "p1"]).dropDuplicates(["p0", "p1"])
    return once.select("text", "label", F.explode(F.sequence(F.lit(1), "n"))).select("text", "label")


def score_documents(docs: DataFrame, model: SentenceModel, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, offending): offending lists the byte range and score of each sentence above one half."""
    schema = "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        cache = ChunkCache(model.weigh)
        for batch in batches:
            found = [model.score(t or b"", cache) for t in batch.column(1).to_pylist()]
            bad = [[{"start": a, "end": b, "score": p} for a, b, p in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array(bad, kind)], ["doc_id", "score", "offending"])

    return docs.select(col(doc).cast("long"), col(text).cast("string").cast("binary")).mapInArrow(run, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    sample = training_sample(docs, labels).toPandas()
    model = SentenceModel.fit([bytes(t) for t in sample["text"]], sample["label"].tolist())
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"), F.get("offending", F.lit(0))["start"].alias("first_offending_byte"))
