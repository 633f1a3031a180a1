"""Hard negatives by exact integer products of Kronecker-packed vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structnet.llm.common import batched, written

#: Bits of an integer that a double holds exactly, so that a machine's matrix product can do the sums of wide integers.
DOUBLE_BITS = 53
#: Fields of the wide integers that Python holds, where a sum of products does not fit in a double.
WIDE_FIELDS = 32
#: Anchors of a pass over the candidates (as a mean), and candidates and anchors that meet at a time.
PASS_ANCHORS, BLOCK, ANCHOR_BLOCK = 4096, 4096, 512
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Packing:
    """How components become fields: ``bias`` is taken off each, so none is negative; a field is wide enough for any sum of products."""

    bias: int
    field: int
    dims: int

    @classmethod
    def of(cls, low: int, high: int, dims: int) -> Packing:
        return cls(low, max(1, (max(1, dims) * (high - low) ** 2).bit_length()), dims)

    @property
    def fields(self) -> int:
        return DOUBLE_BITS // self.field or WIDE_FIELDS

    @property
    def kind(self) -> type:
        return float if self.field <= DOUBLE_BITS else object

    def biased(self, v: np.ndarray) -> np.ndarray:
        return v - self.bias if self.kind is float else v.astype(object) - self.bias

    def packed(self, v: np.ndarray) -> np.ndarray:
        """Wide integers, one for each component and ``fields`` rows of ``v``: row k in the k-th field."""
        k = self.fields
        rows = np.concatenate([self.biased(v), np.zeros((-len(v) % k, v.shape[1]), np.int64)]).reshape(-1, k, v.shape[1])
        wide = rows[:, 0].astype(object if self.kind is object else np.int64)
        for i in range(1, k):
            wide = wide + (rows[:, i] << (i * self.field))
        return wide.T.astype(self.kind)

    def scores(self, anchors: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Inner products of every anchor with every row of ``v``. Sums beyond 64 bits are held at the limits."""
        a = self.biased(anchors)
        wide = a.astype(self.kind) @ self.packed(v)  # one product for each component and wide integer
        wide = wide.astype(np.int64) if self.kind is float else wide
        mask = (1 << self.field) - 1
        fields = np.stack([(wide >> (i * self.field)) & mask for i in range(self.fields)], axis=2).reshape(len(a), -1)[:, :len(v)]
        found = fields + (self.bias * (a.sum(1) + self.dims * self.bias))[:, None] + self.bias * self.biased(v).sum(1)[None, :]
        return found if self.kind is float else np.clip(found, LOW, HIGH).astype(np.int64)


class Best:
    """For each of many keys the first ``n`` rows, by higher score, then smaller id."""

    def __init__(self, keys: int, n: int) -> None:
        self.n = n
        self.score, self.id, self.row = np.full((keys, n), LOW), np.full((keys, n), HIGH), np.full((keys, n), -1)

    def add(self, keys: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``scores`` of candidates (columns, in order of ``ids``) for ``keys`` (lines), where ``allowed``."""
        allowed = allowed & ((scores >= self.score[keys, -1][:, None]) | (self.row[keys, -1][:, None] < 0))
        at, column = self._firsts(scores, allowed)
        if not len(at):
            return
        line = np.concatenate([at, np.repeat(np.arange(len(keys)), self.n)])
        score = np.concatenate([scores[at, column], self.score[keys].ravel()])
        id_, row = np.concatenate([ids[column], self.id[keys].ravel()]), np.concatenate([rows[column], self.row[keys].ravel()])
        order = np.lexsort((row, id_, -score.astype(float) if score.dtype == object else np.invert(score), row < 0, line))
        line = line[order]
        nth = np.arange(len(line)) - np.searchsorted(line, line)
        order, line, nth = order[nth < self.n], line[nth < self.n], nth[nth < self.n]
        self.score[keys[line], nth], self.id[keys[line], nth], self.row[keys[line], nth] = score[order], id_[order], row[order]

    def _firsts(self, scores: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of at most ``n`` allowed scores of each line (or of all, if they are few)."""
        width = scores.shape[1]
        if np.count_nonzero(allowed) <= 4 * self.n * len(scores) or width <= self.n:
            return np.nonzero(allowed)
        if max(abs(int(scores.min())), abs(int(scores.max()))) < HIGH // (2 * width):  # distinct numbers, in the order wanted
            ranked = np.where(allowed, scores * width + np.arange(width - 1, -1, -1), LOW)
            column = np.argpartition(ranked, width - self.n, axis=1)[:, width - self.n:]
            at = np.repeat(np.arange(len(scores)), self.n)
            ok = allowed[at, column.ravel()]
            return at[ok], column.ravel()[ok]
        return np.nonzero(allowed)

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """key, score, id, row."""
        for key, nth in np.argwhere(self.row >= 0).tolist():
            yield key, int(self.score[key, nth]), int(self.id[key, nth]), int(self.row[key, nth])


def _vectors(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, ...]:
    """row, id, label and components (shorter vectors end in zeros) of a block, in order of id."""
    lists = batch.column("v")
    offsets = lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy(), np.diff(offsets)
    v = np.zeros((len(sizes), dims), np.int64)
    if sizes.sum():
        line = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)
        v[line, place] = flat[offsets[0]:offsets[-1]]
    row, id_, label = (batch.column(c).to_numpy() for c in ("row", "id", "label"))
    order = np.lexsort((row, id_))
    return row[order], id_[order], label[order], v[order]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield _vectors(batch.slice(start, BLOCK), dims)


def _by_label(labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for label in np.unique(labels).tolist():
        where = np.flatnonzero(labels == label)
        for start in range(0, len(where), ANCHOR_BLOCK):
            yield label, where[start:start + ANCHOR_BLOCK]


@dataclass
class Anchors:
    row: np.ndarray
    label: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, rows: list, dims: int) -> Anchors:
        v = np.zeros((len(rows), dims), np.int64)
        for i, r in enumerate(rows):
            v[i, :len(r.v)] = r.v
        return cls(np.array([r.row for r in rows]), np.array([r.label for r in rows]), v)


_FOUND = pa.schema([("anchor", pa.int64()), ("nth", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])
_FOUND_DDL = "anchor long, nth int, score long, id long, row long"


def _positives(candidates: DataFrame, anchors: Anchors, packing: Packing, n: int) -> DataFrame:
    """Each task's first rows of the anchors' labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.row), n)
        for row, id_, label, v in _blocks(batches, packing.dims):
            for own, keys in _by_label(anchors.label):
                same = np.flatnonzero(label == own)
                if len(same):
                    scores = packing.scores(anchors.v[keys], v[same])
                    best.add(keys, scores, anchors.row[keys][:, None] != row[same][None, :], id_[same], row[same])
        yield from batched(((int(anchors.row[k]), 0, *x) for k, *x in best.rows()), _FOUND)

    return candidates.mapInArrow(run, _FOUND_DDL)


def _negatives(candidates: DataFrame, anchors: Anchors, limits: np.ndarray, packing: Packing, n: int, ratio: tuple[int, int]) -> DataFrame:
    """Each task's first rows of other labels, for each anchor and each score of a positive in ``limits``: LOW for none, as scores below 0 have no negatives."""
    below, above = ratio
    least = np.array([[-(-below * int(x) // above) for x in line] for line in limits], np.int64).reshape(limits.shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(anchors.row), n) for _ in range(limits.shape[1])]
        for row, id_, label, v in _blocks(batches, packing.dims):
            for own, keys in _by_label(anchors.label):
                other = np.flatnonzero(label != own)
                if not len(other):
                    continue
                scores = packing.scores(anchors.v[keys], v[other])
                for nth, found in enumerate(best):
                    real = limits[keys, nth] >= 0
                    if real.any():
                        own_keys, own_scores = keys[real], scores[real]
                        allowed = (own_scores >= least[own_keys, nth][:, None]) & (own_scores <= limits[own_keys, nth][:, None])
                        found.add(own_keys, own_scores, allowed, id_[other], row[other])
        rows = ((int(anchors.row[k]), nth, *x) for nth, found in enumerate(best) for k, *x in found.rows())
        yield from batched(rows, _FOUND)

    return candidates.mapInArrow(run, _FOUND_DDL)


def _firsts(found: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of what all tasks found, with their ranks: each gave ``n`` for a key at most."""
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, ratio: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows(id, label, vector, ...)``.

    A component x becomes floor(scale * x). Scores are inner products of the whole numbers, exact; higher ones come
    first, ties by smaller id. An anchor is a row where ``is_anchor`` (over id, label, vector) holds; its positives are the first other
    rows with its label, and for each the negatives are the first rows of other labels whose score lies between
    ratio[0]/ratio[1] of the positive's and the positive's.

    Rows with a null id, label or vector, or with a component that is null or not finite take no part. Rows that repeat are
    rows of their own, so a repeated anchor is answered each time and has its twin as a positive. Shorter vectors
    count as followed by zeros. Components and scores beyond 64 bits are held at the limits. A positive without negatives has
    no row; other columns are ignored; an empty table gives none.

    The candidates are never shuffled: each pass takes about PASS_ANCHORS anchors to all of them, keeps the best of each
    task, and merges those. The anchors are a stated query set, so the passes grow with it.
    """
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    taken = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & usable)
    taken = written(taken.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("v"), is_anchor.alias("anchor")))
    low, high, dims, n_anchors = taken.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.max(F.size("v")), F.count_if("anchor")).first()
    packing = Packing.of(min(low or 0, 0), max(high or 0, 0), dims or 1)
    passes = max(1, -(-(n_anchors or 0) // PASS_ANCHORS))
    candidates = taken.select("row", "id", "label", "v")
    out = None
    for k in range(passes):
        chosen = taken.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(passes)) == k)
        anchors = Anchors.of(chosen.select("row", "label", "v").orderBy("row").collect(), packing.dims)  # about PASS_ANCHORS
        nearest = written(_firsts(_positives(candidates, anchors, packing, positives), positives))
        limits = np.full((len(anchors.row), positives), LOW)
        place = {int(r): i for i, r in enumerate(anchors.row)}
        for r in nearest.collect():  # a few for each of these anchors
            limits[place[r.anchor], r["rank"] - 1] = r.score
        met = written(_firsts(_negatives(candidates, anchors, limits, packing, negatives, ratio), negatives))
        ids = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        of = nearest.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        some = met.join(of, ["anchor", "nth"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = some if out is None else out.union(some)
    return out
