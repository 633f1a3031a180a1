"""Quality classifier: logistic regression on hashed word n-grams, trained by follow the regularised leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structnet.llm.common import map_rows, texts

BITS = 18
SLOTS = 1 << BITS
#: Labelled documents to learn from, at most; if they are dealt over several SHARDS, the weights are averaged.
SAMPLE = 16_384
SHARDS = 1
EPOCHS = 4
FOLDS = 5
#: Words, and runs of other marks.
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Features weigh their share of the document times this.
SCALE = 8.0


class _Hashes(dict):
    """Hashes of words seen, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode())
        return out


_HASHES = _Hashes()


def features(text: str) -> np.ndarray:
    """Slots of the words and word pairs of a whole text, repeats included. A word after itself is one and the same pair for all words."""
    h = np.array([_HASHES[w] for w in _TOKEN.findall(text.lower())], np.uint64)
    pairs = np.where(h[:-1] == h[1:], np.uint64(1), h[:-1] * np.uint64(0x85EBCA6B) + h[1:] + np.uint64(2)) * _MIX
    return (np.concatenate([h * _MIX, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


def sparse(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots once each with their weight, and the bias."""
    at, counts = np.unique(slots, return_counts=True)
    return np.append(at, SLOTS).astype(np.int32), np.append(counts * (SCALE / max(1, len(slots))), 1.0).astype(np.float32)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last slot is the bias."""

    def __init__(self, alpha: float = 4.0, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def score(text: str, weights: np.ndarray) -> float:
    slots = features(text)
    dot = weights[SLOTS] + (weights[slots].sum() * SCALE / len(slots) if len(slots) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(dot, -35, 35))))


def held_out() -> F.Column:
    """Rows that no label is learnt from: crc32 of doc_id as text is divisible by FOLDS. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS) -> np.ndarray:
    """Weights of the slots, from at most ``sample`` labelled documents outside the held-out fold, those with the smallest hashes of doc_id.

    A document that is labelled more than once counts as its lowest label; null labels, null ids and labels without a document are passed by.
    Each shard learns on its own, in order of hash; the driver averages ``shards`` weight vectors. Without labels all weights are zero.
    """
    rank = F.xxhash64(F.col("doc_id"), F.lit(7))
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("rank", rank).orderBy("rank", "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")  # bounded by sample
    rows = rows.repartition(shards, F.pmod("rank", F.lit(shards))).sortWithinPartitions("rank", "doc_id", "text")

    def learnt(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = {}
        for doc_id, text, label in rows:  # rows that repeat count once
            known[doc_id] = (*sparse(features(text)), label)
        if known:
            model = Ftrl()
            for _ in range(EPOCHS):
                for at, x, label in known.values():
                    model.learn(at, x, label)
            yield len(known), model.weights().astype(np.float32).tobytes()

    got = map_rows(rows, learnt, ["doc_id", "text", "quality"], "n long, weights binary", pa.schema([("n", pa.int64()), ("weights", pa.binary())])).collect()
    if not got:
        return np.zeros(SLOTS + 1, np.float32)
    total = sum(r["n"] for r in got)
    return sum(np.frombuffer(r["weights"], np.float32) * np.float32(r["n"] / total) for r in sorted(got, key=lambda r: bytes(r["weights"])))


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1, higher for better) of every whole text. Null and empty texts get the bias alone; rows that repeat are scored each; other columns are ignored; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # one megabyte, whatever the corpus

    def scored(rows: Iterator[tuple]) -> Iterator[tuple]:
        w = shared.value
        for doc_id, text in rows:
            yield doc_id, score(text, w)

    return map_rows(texts(docs), scored, ["doc_id", "text"], "doc_id long, score double", pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))


def keep_good(docs: DataFrame, weights: np.ndarray, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    shared, schema, at = docs.sparkSession.sparkContext.broadcast(weights), docs.schema, docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score(x.as_py() or "", shared.value) >= least for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(kept, schema)
