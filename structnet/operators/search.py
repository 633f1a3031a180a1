"""Sequence search: seeds on one diagonal, ungapped scores by a substitution table, and an expectation threshold.

A query and a target are compared if some diagonal holds at least ``min_seeds`` k-mers of both at the same place. The
score of a diagonal is that of its best stretch, and a hit's that of its best such diagonal. Nothing is gapped, so an
insertion splits a match into two diagonals, of which the better counts. How many targets would reach a score by chance is
estimated by the extreme value law of ungapped scores, with the parameter ``decay`` solved for the table in use.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structnet.functions import constants as K
from structnet.operators.staging import stage

#: Groups of like residues, by size, charge and ring.
LIKE = ("AGPST", "C", "DENQ", "FWY", "HKR", "ILMV")


@dataclass(frozen=True)
class Scoring:
    """A substitution table over ``letters``; any other letter scores ``unknown`` against everything.

    ``frequencies`` are those of the letters in unrelated sequences, even ones by default. ``scale`` is the other
    constant of the law, which hardly moves a threshold.
    """

    letters: str
    table: tuple[tuple[int, ...], ...]
    unknown: int = -1
    scale: float = 0.1
    frequencies: tuple[float, ...] | None = None

    @classmethod
    def of_groups(cls, groups: Sequence[str] = LIKE, same: int = 6, like: int = 1, other: int = -2) -> Scoring:
        """Equal letters, letters of one group, and any others."""
        letters = "".join(sorted("".join(groups)))
        group = {c: g for g in groups for c in g}
        return cls(letters, tuple(tuple(same if a == b else like if group[a] == group[b] else other for b in letters) for a in letters))

    @classmethod
    def from_text(cls, text: str, **more) -> Scoring:
        """The usual text form of a substitution table: a line of letters, then one line of scores per letter."""
        lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
        rows = {x[0]: dict(zip(lines[0], map(int, x[1:]), strict=True)) for x in lines[1:]}
        letters = "".join(c for c in lines[0] if c.isalpha())
        return cls(letters, tuple(tuple(rows[a][b] for b in letters) for a in letters), **more)

    @cached_property
    def decay(self) -> float:
        """The rate at which high scores get rare: the positive solution of sum(f_a * f_b * exp(rate * score)) = 1."""
        f = np.array(self.frequencies or [1 / len(self.letters)] * len(self.letters))
        weights, scores = np.outer(f, f), np.array(self.table)
        if (weights * scores).sum() >= 0 or scores.max() <= 0:
            raise ValueError("unrelated letters must score below 0 on average, and some above")
        low, high = 0.0, 1.0
        while (weights * np.exp(high * scores)).sum() < 1:
            high *= 2
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if (weights * np.exp(middle * scores)).sum() < 1 else (low, middle)
        return (low + high) / 2

    @cached_property
    def _codes(self) -> np.ndarray:
        codes = np.full(256, len(self.letters), np.int64)
        codes[np.frombuffer(self.letters.encode(), np.uint8)] = np.arange(len(self.letters))
        return codes

    @cached_property
    def _matrix(self) -> np.ndarray:
        n = len(self.letters)
        out = np.full((n + 1, n + 1), self.unknown, np.int64)
        out[:n, :n] = self.table
        return out

    def seeds(self, query: str, target: str, diagonal: int, k: int, min_letters: int) -> int:
        """Places of the diagonal where a k-mer that may seed is the same in both."""
        start, stop = max(0, -diagonal), min(len(query), len(target) - diagonal)
        same = (query[i:i + k] for i in range(start, stop - k + 1) if query[i:i + k] == target[i + diagonal:i + diagonal + k])
        return sum(K.UNKNOWN_LETTER not in x and len(set(x)) >= min_letters for x in same)

    def codes(self, sequence: str) -> np.ndarray:
        return self._codes[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)]

    def best_stretch(self, query: np.ndarray, target: np.ndarray, diagonal: int) -> int:
        """The best sum of a run of neighbours, at least 0; place i of the query meets place i + diagonal of the target."""
        start, stop = max(0, -diagonal), min(len(query), len(target) - diagonal)
        if stop <= start:
            return 0
        sums = np.cumsum(self._matrix[query[start:stop], target[start + diagonal:stop + diagonal]])
        lows = np.minimum(np.minimum.accumulate(np.concatenate([[0], sums[:-1]])), 0)
        return max(0, int((sums - lows).max()))

    def expected(self, score: float, query_length: int, residues: int) -> float:
        """Stretches of that score or more that are expected by chance."""
        return self.scale * query_length * residues * math.exp(-self.decay * score)


#: Residues that are compared where seeds meet, those from the seed on, or the whole of a sequence of no more; five bits of each, a word for each bit.
AHEAD, _BITS = 64, 5
#: The expectation of the best possible score may be so much larger, so that rounding never loses a hit.
_SLACK = 1e-6
#: Residues that are cut into seeds at a time.
_PART = 1 << 18


def _windows(bits: np.ndarray) -> np.ndarray:
    """For every place a word whose bit i is that of the place i further on."""
    words = np.concatenate([bits.astype(np.uint64), np.zeros(AHEAD, np.uint64)])
    for step in (1, 2, 4, 8, 16, 32):
        words[:-step] |= words[step:] << np.uint64(step)
    return words[:len(bits)]


def _seeds(texts: DataFrame, key: str, k: int, min_letters: int, tag: str, end: int) -> DataFrame:
    """The k-mers of every sequence with their places, without those that hold an unknown or too few different letters.

    ``key, seed`` (five bits a letter, so equal k-mers have equal ones), ``<tag>_at``, ``<tag>_length``, and letters: ``<tag>_0`` to
    ``<tag>_4``, the bits of AHEAD letters from the seed on, or from the start of a sequence of no more than AHEAD, beyond the end those of
    ``end``; ``<tag>_ok``, which of these places seed; ``<tag>_from``, where among them the seed is.
    """
    words = [f"{tag}_{i}" for i in range(_BITS)]
    columns = {"seed": pa.int64(), f"{tag}_at": pa.int32(), f"{tag}_length": pa.int32(), f"{tag}_from": pa.int32(), **dict.fromkeys([*words, f"{tag}_ok"], pa.int64())}

    def cut(keys: pa.Array, sequences: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(s) for s in sequences])
        gap = np.full(AHEAD, -1, np.int64)
        flat = np.concatenate([x for s in sequences for x in (s, gap)])
        starts = np.cumsum(lengths + AHEAD) - lengths - AHEAD
        owner = np.repeat(np.arange(len(sequences)), lengths + AHEAD)
        views = np.lib.stride_tricks.sliding_window_view(flat, k)
        ordered = np.sort(views, axis=1)
        good = (views >= 0).all(1) & (views != ord(K.UNKNOWN_LETTER)).all(1) & ((ordered[:, 1:] != ordered[:, :-1]).sum(1) + 1 >= min_letters)
        good = np.concatenate([good, np.zeros(k - 1, bool)])
        codes = np.where(flat < 0, end, flat) & ((1 << _BITS) - 1)
        seed = np.zeros(len(flat), np.uint64)
        for i in range(k):
            seed[:len(flat) - i] = seed[:len(flat) - i] * np.uint64((1 << _BITS) | 1 if k * _BITS > 64 else 1 << _BITS) + codes[i:].astype(np.uint64)
        at = np.flatnonzero(good)
        base = np.where(lengths[owner[at]] <= AHEAD, starts[owner[at]], at)
        planes = [_windows(codes >> i & 1)[base].view(np.int64) for i in range(_BITS)]
        found = [seed[at].view(np.int64), (at - starts[owner[at]]).astype(np.int32), lengths[owner[at]].astype(np.int32), (at - base).astype(np.int32), *planes, _windows(good)[base].view(np.int64)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(owner[at])), *map(pa.array, found)], [key, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i, text in enumerate(batch.column("sequence")):
                held.append(np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64))
                size += len(held[-1]) + AHEAD
                if size >= _PART or i + 1 == batch.num_rows:
                    yield cut(batch.column(key).slice(first, len(held)), held)
                    first, held, size = i + 1, [], 0

    kinds = ", ".join(f"{c} {'int' if x == pa.int32() else 'long'}" for c, x in columns.items())
    return texts.select(key, "sequence").mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, {kinds}")


def _shifted(word: str, places: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col(word), places)


def _same(q_from: Column, t_from: Column) -> Column:
    """Bit i is set if the letters i places further than these are the same, or share their five bits."""
    other = F.lit(0).cast("long")
    for i in range(_BITS):
        other = other.bitwiseOR(_shifted(f"q_{i}", q_from).bitwiseXOR(_shifted(f"t_{i}", t_from)))
    return F.bitwise_not(other)


def _met_ahead(k: int, same: Column | None = None) -> Column:
    """How many k-mers are the same from here on, as far as the words of both sides reach, or more if letters share their five bits."""
    same = _same(F.col("q_from"), F.col("t_from")) if same is None else same
    runs = _shifted("q_ok", F.col("q_from"))
    for i in range(k):
        runs = runs.bitwiseAND(F.shiftrightunsigned(same, i) if i else same)
    return F.bit_count(runs)


def _with(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that filters find ready. As a plain expression it is copied to each of its places in them, which makes code too long to be compiled."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _likely(met: DataFrame, scoring: Scoring, chance: Callable[[Column, Column], Column], expect: float) -> DataFrame:
    """Without the diagonals of two sequences in words as a whole whose score, whatever their stretch, is expected more than ``expect`` times.

    Letters that differ score no more than the best of unlike letters, others no more than the best of all.
    """
    table = np.array(scoring.table)
    unlike = max(0, scoring.unknown, int(table[~np.eye(len(table), dtype=bool)].max(initial=0)))
    alike = max(unlike, int(table.max(initial=0)))
    q_from, t_from = F.greatest(F.col("q_at") - F.col("t_at"), F.lit(0)), F.greatest(F.col("t_at") - F.col("q_at"), F.lit(0))
    places = F.least(F.col("q_length") - q_from, F.col("t_length") - t_from)
    within = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(AHEAD) - places)
    known = _with(met, "equal", F.bit_count(_same(q_from, t_from).bitwiseAND(within)))
    most = F.col("equal") * (alike - unlike) + places * unlike
    return known.where((F.greatest("q_length", "t_length") > AHEAD) | (chance(F.col("q_length"), most) <= expect * (1 + _SLACK)))


def scored_hits(queries: DataFrame, targets: DataFrame, query_id: str, target_id: str, sequence: str = "sequence", scoring: Scoring | None = None,
                k: int = 5, min_seeds: int = 2, min_letters: int = 3, expect: float = 1e-5, best: int = 8) -> DataFrame:
    """``query_id, hit_id, rank, score``: the ``best`` targets of every query by score, ties by smaller id.

    Only hits that are expected at most ``expect`` times by chance, among all residues of the targets, are given. K-mers of fewer than
    ``min_letters`` different letters seed nothing, as runs of one letter meet everywhere. Null sequences have no hits;
    queries of equal sequence are searched once, targets too, whose smallest id stands for them.

    The seeds join is spread by k-mer. A seed carries the AHEAD letters that follow it, or its whole sequence if that is no longer, so where two
    seeds meet it is seen at once how many more there are on the diagonal, and which score none of its stretches exceeds. Of a pair with a
    sequence no longer than AHEAD, the first seed sees all; seeds that meet by chance, whose number grows with both tables, go no further, nor
    do diagonals whose best possible score is expected too often. Seeds of pairs of longer sequences are counted per diagonal. Candidates
    are spread by pair of texts; sequences travel once per candidate pair, where the seeds are counted again, letter by letter.
    """
    scoring = scoring or Scoring.of_groups()
    digest = F.substring(F.unhex(F.sha2("sequence", 256)), 1, 16).alias("digest")
    keyed = queries.select(F.col(query_id).alias("id"), F.col(sequence).alias("sequence")).dropna(subset=["sequence"]).select("id", "sequence", digest)
    known = targets.select(F.col(target_id).alias("id"), F.col(sequence).alias("sequence")).dropna(subset=["sequence"]).select("id", "sequence", digest)
    keyed, known = stage(keyed), stage(known)  # used by the seeds, the scores and the result
    q_texts = keyed.groupBy("digest").agg(F.min("sequence").alias("sequence"))
    t_texts = known.groupBy("digest").agg(F.min("sequence").alias("sequence"), F.min("id").alias("hit_id"))
    residues = known.agg(F.sum(F.length("sequence"))).first()[0] or 0

    def chance(length: Column, score: Column) -> Column:
        return F.lit(scoring.scale) * length * F.lit(residues) * F.exp(-F.lit(scoring.decay) * score)


    q_seeds = _seeds(q_texts.withColumnRenamed("digest", "query"), "query", k, min_letters, "q", 31)
    t_seeds = _seeds(t_texts, "hit_id", k, min_letters, "t", 30).drop("t_ok")
    short = F.least("q_length", "t_length") <= AHEAD
    # What cuts seeds tells Spark no size, and it would broadcast them by that of the texts.
    met = _with(q_seeds.join(t_seeds.hint("merge"), "seed"), "same", _same(F.col("q_from"), F.col("t_from")))
    seen = _likely(met.where(~short | (_met_ahead(k, F.col("same")) >= min_seeds)), scoring, chance, expect)
    pairs = (seen.groupBy("query", "hit_id", (F.col("t_at") - F.col("q_at")).alias("diagonal"))
             .agg(F.count("*").alias("n"), F.bool_or(short).alias("short")).where(F.col("short") | (F.col("n") >= min_seeds))
             .groupBy("query", "hit_id").agg(F.collect_list("diagonal").alias("diagonals")))  # at most as many as both sequences have places
    met = (pairs.join(q_texts.select(F.col("digest").alias("query"), F.col("sequence").alias("of_query")), "query")
           .join(t_texts.select("hit_id", F.col("sequence").alias("of_target")), "hit_id"))
    shown = dict(met.select("query", "hit_id").dtypes)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, rows = [], []
            for row, (x, y, diagonals) in enumerate(zip(*(batch.column(c) for c in ("of_query", "of_target", "diagonals")), strict=True)):
                of_query, of_target = x.as_py(), y.as_py()
                places = [d for d in diagonals.as_py() if scoring.seeds(of_query, of_target, d, k, min_letters) >= min_seeds]
                if places:
                    a, b = scoring.codes(of_query), scoring.codes(of_target)
                    scores.append(max(scoring.best_stretch(a, b, d) for d in places))
                    rows.append(row)
            some = batch.take(pa.array(rows, pa.int64()))
            lengths = [len(x.as_py()) for x in some.column("of_query")]
            yield pa.RecordBatch.from_arrays([some.column("query"), some.column("hit_id"), pa.array(scores, pa.int64()), pa.array(lengths, pa.int64())], ["query", "hit_id", "score", "length"])

    rated = met.mapInArrow(scored, f"query {shown['query']}, hit_id {shown['hit_id']}, score long, length long")
    good = rated.where(chance(F.col("length"), F.col("score")) <= expect)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "hit_id")
    ranked = good.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return (keyed.select(F.col("id").alias(query_id), F.col("digest").alias("query")).join(ranked, "query")
            .select(query_id, "hit_id", "rank", "score"))


def first_hits(hits: DataFrame, query_id: str) -> DataFrame:
    """The best target of every query: ``query_id, hit_id``."""
    return hits.where("rank = 1").select(query_id, "hit_id")
