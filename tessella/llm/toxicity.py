"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence scores sigmoid(bias + the weights of its words); the document's score is the noisy-or of its sentences,
1 - prod(1 - p). Only documents carry labels: training passes their error through the noisy-or to the sentences, so
the model also says which sentences offend.

A word's weight is the sum over its features: the word and its first 3 to 6 bytes, which carry stems to forms that
were never seen. Features are screened by their log-likelihood ratio with the label; a sentence that has none of the
kept features can't offend and scores 0, however many of them a long document has. A text without words scores 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fresh, materialise

SPACE = 1 << 24
SENTENCE = re.compile(rb"[^.!?\n]+")
#: ASCII other than letters and digits separates words.
WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
CACHE = 1 << 18


def features(word: bytes) -> list[int]:
    """Hashed features of a word; the hash of a stem goes on from that of the shorter one."""
    return [zlib.crc32(b"=" + word) % SPACE, *(zlib.crc32(b"^" + word[:k]) % SPACE for k in (3, 4, 5, 6) if len(word) >= k)]


def sentences(text: bytes) -> Iterator[tuple[int, int, set[bytes]]]:
    """Start, end (bytes of the lower-cased text) and distinct words of each sentence that has any."""
    for m in SENTENCE.finditer(text):
        if words := {*m[0].translate(WORDS).split()}:
            yield m.start(), m.end(), words


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def scorer(self):
        """text -> (score, [(sentence number, score)] of the sentences with any evidence)."""
        cache: dict[bytes, float | None] = {}
        weights, bias = self.weights, self.bias

        def weight(word: bytes) -> float | None:
            got = [weights[f] for f in features(word) if f in weights]
            if len(cache) > CACHE:
                cache.clear()
            cache[word] = found = sum(got) if got else None
            return found

        def score(text: str | None) -> tuple[float, list[tuple[int, float]]]:
            raw = lowered(text)
            known = [w for w in {*raw.translate(WORDS).split()} if (cache[w] if w in cache else weight(w)) is not None]
            if not known:
                return 0.0, []
            held = {w: weight(w) for w in known}
            clean, found = 1.0, []
            for k, (_, _, words) in enumerate(sentences(raw)):
                if got := sorted(held[w] for w in words if w in held):  # sorted: the sum doesn't depend on the order of a set
                    p = 1 / (1 + np.exp(-np.clip(bias + sum(got), -30, 30)))
                    clean *= 1 - p
                    found.append((k, float(p)))
            return float(1 - clean), found

        return score


def document_features(raw: bytes) -> set[int]:
    return {f for w in {*raw.translate(WORDS).split()} for f in features(w)}


def bags(raw: bytes, index: dict[int, int]) -> list[list[int]]:
    """For each sentence that has any: the numbers of the kept features of its words, as often as words have them."""
    if not any(f in index for w in {*raw.translate(WORDS).split()} for f in features(w)):
        return []
    found = ([index[f] for w in sorted(words) for f in features(w) if f in index] for _, _, words in sentences(raw))
    return [x for x in found if x]


def screened(n: int, n1: int, with1: np.ndarray, with0: np.ndarray, least: float) -> np.ndarray:
    """Which features are kept: in three documents of label 1 at least, four times as often there as elsewhere, and with a log-likelihood ratio of ``least``."""
    a, c = with1.astype(float), with0.astype(float)
    share = n1 / n
    log = lambda x, m: x * np.log(np.maximum(x, 1e-9) / np.maximum(m, 1e-9))
    ratio = 2 * (log(a, (a + c) * share) + log(c, (a + c) * (1 - share)))
    return (a >= 3) & (ratio >= least) & (a / n1 > 4 * c / (n - n1))


def fit(kept: list[int], documents: list[tuple[int, list[list[int]]]], rounds: int = 300) -> Model:
    """Fits the noisy-or by gradient steps. ``documents``: label, and bags of the numbers of ``kept`` features. Documents without any don't count: they score 0 whatever the weights are."""
    full = [(y, s) for y, s in documents if s]
    if not full:
        return Model(0.0, {})
    yy = np.array([y for y, _ in full], np.int64)
    doc = np.repeat(np.arange(len(full)), [len(s) for _, s in full])
    every = [s for _, b in full for s in b]
    bag = len(every)
    sent, feat = np.repeat(np.arange(bag), [len(s) for s in every]), np.array([f for s in every for f in s])
    w, b = np.zeros(len(kept)), -1.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, rounds + 1):
        g = gradient(w, b, doc, sent, feat, yy)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(float(b), {int(f): float(x) for f, x in zip(kept, w) if abs(x) > 1e-3})


#: Weight decay.
DECAY = 0.05


def gradient(w: np.ndarray, b: float, doc: np.ndarray, sent: np.ndarray, feat: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Of the negative log-likelihood of the labels, with decay of the weights: 1 - prod(1 - p) passes a document's error on to its sentences."""
    bag = len(doc)
    z = np.clip(b + np.bincount(sent, w[feat], bag), -30, 30)
    p = 1 / (1 + np.exp(-z))
    total = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(yy)), 1e-9)
    slope = np.where(yy == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0)[doc] * p
    return np.append(np.bincount(feat, slope[sent], len(w)) + DECAY * w, slope.sum())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, longest: int = 1 << 17, least: float = 16.0) -> Model:
    """Fits on a bounded sample: of each label at most ``rows`` documents that aren't held out, by a hash of doc_id, with texts of at most ``longest`` characters.

    Tasks count features and cut texts into bags; the driver gets counts and bags of kept features, never texts. Labels
    that are null, or of documents that aren't there, don't count; of several for one document the highest does, and of
    several texts the one with the smallest hash. Without documents of both labels every score is 0.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    picked = [known.where(F.col("y") == k).orderBy(F.xxhash64("d"), "d").limit(rows) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionAll(picked[1]))  # 2 * rows at most
    text = F.col("text").cast("string")
    got = docs.select(F.col("doc_id").cast("long").alias("d"), text.alias("text")).join(ids, "d").where(F.length(F.coalesce("text", F.lit(""))) <= longest)
    sample = materialise(got.groupBy("d").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")))
    sizes = dict(sample.groupBy("y").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(0.0, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SPACE), np.uint16)  # the sample is bounded well below its range
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                ids = document_features(lowered(t))
                seen[y, np.fromiter(ids, np.int64, len(ids))] += 1
        some = np.flatnonzero(seen.any(axis=0))
        for at in range(0, len(some), 1 << 16):
            f = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"f": f, "n0": seen[0, f].astype(np.int64), "n1": seen[1, f].astype(np.int64)})

    few = sample.coalesce(8)  # of a bounded sample; each task's counts take 64 MB
    counts = few.select("y", "text").mapInArrow(count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = counts.where("n1 >= 3").orderBy("f").toArrow()
    f, c0, c1 = (table.column(x).to_numpy() for x in ("f", "n0", "n1"))
    kept = f[screened(n1 + n0, n1, c1, c0, least)].tolist()
    index = {x: k for k, x in enumerate(kept)}

    @arrow_udf("array<array<int>>")
    def cut(text: pa.Array) -> pa.Array:
        return pa.array([bags(lowered(t), index) for t in text.to_pylist()], pa.list_(pa.list_(pa.int32())))

    held = sample.select("d", "y", cut("text").alias("bags")).orderBy("d").collect()
    return fit(kept, [(r["y"], r["bags"]) for r in held])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a struct column toxicity: score, and the number (from 0, of sentences with words) and score of each sentence with evidence. An underscore is appended where that name is taken. Null and empty texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand weights: the screen keeps few of a bounded sample's features

    @arrow_udf("struct<score: double, sentences: array<struct<number: int, score: double>>>")
    def score(text: pa.Array) -> pa.Array:
        f = shared.value.scorer()
        rows = [f(t) for t in text.to_pylist()]
        inner = pa.list_(pa.struct([("number", pa.int32()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([[{"number": k, "score": p} for k, p in r[1]] for r in rows], inner)], ["score", "sentences"])

    return docs.select("*", score.asNondeterministic()(F.col("text").cast("string")).alias(fresh(docs, "toxicity")))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> DataFrame:
    """Trains on ``labels`` (doc_id, toxic) and scores every row of ``docs``."""
    return scored(docs, train(docs, labels, rows))
