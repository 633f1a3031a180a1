"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, weighted-shingle similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structnet.llm.common import WORD_BYTES, map_rows, texts

WIDTH = 5
SIMILARITY = 0.8
#: Texts at the threshold differ by 10 of 64 bits (deviation 3), so a radius of 23 keeps them; of eight blocks one then differs by two bits at most.
RADIUS = 23
BLOCKS = 8
#: Words of benchmark items that are looked for in one pass over the documents; more items take more passes.
PASS_WORDS = 2_000_000
_STEP = 4096
_NEAR = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)]) <= RADIUS // BLOCKS
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Words(dict):
    """Hashes of words seen, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 3)
        return out


_WORDS = _Words()


def words_of(text: str) -> list[bytes]:
    """Letters and digits between ASCII marks and white space, A-Z lower-cased."""
    return text.encode().translate(WORD_BYTES).split()


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` words; fewer words are one shingle."""
    h = np.fromiter((_WORDS[w] for w in words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n if len(h) else 0, len(words) if len(words) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        x = (out ^ h[k:k + len(out)]) * _ODD[k]
        out = x ^ (x >> np.uint64(29))
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def window_fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` shingles, as 8 bytes a window."""
    sums = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(_bits(h), axis=0, out=sums[1:])
    return np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1, bitorder="little")


class Item(NamedTuple):
    item_id: int | None
    n_words: int
    counts: Counter


class Index:
    """Items by the number of their shingles; of each number the fingerprints in blocks."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.items: list[Item] = []
        prints: list[np.ndarray] = []
        self.sizes: dict[int, list[int]] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                h = shingle_hashes(words)
                self.sizes.setdefault((len(h), len(words) if len(words) < WIDTH else 0), []).append(len(self.items))
                self.items.append(Item(item_id, len(words), Counter(h.tolist())))
                prints.append(window_fingerprints(h, len(h))[0])
        self.prints = np.array(prints, np.uint8).reshape(-1, 8)
        owners: dict[int, set] = {}
        for size, members in self.sizes.items():
            for i in members:
                for h in self.items[i].counts:
                    owners.setdefault(h, set()).add(size)
        self.known = np.array(sorted(owners), np.uint64)
        self.owners = [sorted(owners[h]) for h in self.known.tolist()]
        #: block -> value -> the items of a size whose block is within RADIUS // BLOCKS bits of it
        self.blocks = {size: np.stack([_NEAR[:, self.prints[members, b]] for b in range(BLOCKS)]) for size, members in self.sizes.items()}

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that any item has, and which of ``known`` they are."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        places = np.flatnonzero(self.known[at] == h)
        return places, at[places]

    def search(self, text: str) -> list[tuple[int, int, int, int, int, float]]:
        """(item, first word, end word, bits that differ, item_id, similarity) of the best window of every item found in a text.

        Windows have as many words as the item; a text of fewer words is one window. Those without any shingle of an item of their size are passed over, since
        their similarity is 0.
        """
        words = words_of(text)
        if not words or not len(self.known):
            return []
        best: dict[int, tuple] = {}
        short = {short for _, short in self.sizes if short}
        for width in [WIDTH, *sorted(short)]:
            h = shingle_hashes(words, width) if len(words) >= width else shingle_hashes(words)[:0]
            if not len(h):
                continue
            places, which = self.hits(h)
            by_size: dict[tuple, list[int]] = {}
            for p, w in zip(places.tolist(), which.tolist(), strict=True):
                for size in self.owners[w]:
                    if (size[1] or WIDTH) == width:
                        by_size.setdefault(size, []).append(p)
            for size, at in by_size.items():
                if len(h) >= SIMILARITY * size[0]:  # the similarity of fewer shingles is below
                    for low, high in _stretches(at, min(size[0], len(h)), len(h)):
                        self._windows(h, low, high, size, width, best)
        return [best[i] for i in sorted(best)]

    def _windows(self, h: np.ndarray, low: int, high: int, size: tuple, width: int, best: dict[int, tuple]) -> None:
        """Windows that start at low to high - 1."""
        members, n = self.sizes[size], min(size[0], len(h))
        for start in range(low, high, _STEP):
            part = h[start:min(high, start + _STEP) + n - 1]
            prints = window_fingerprints(part, n)
            table = self.blocks[size]
            candidate = np.zeros((len(prints), len(members)), bool)
            for b in range(BLOCKS):
                candidate |= table[b][prints[:, b]]
            for w, m in zip(*np.nonzero(candidate), strict=True):
                i = members[m]
                bits = int(np.unpackbits(prints[w] ^ self.prints[i]).sum())
                if bits > RADIUS or i in best and best[i][5] == 1:
                    continue
                own, there = self.items[i].counts, Counter(part[w:w + n].tolist())
                both = sum((own & there).values())
                similarity = both / (size[0] + n - both)
                if similarity >= SIMILARITY and (i not in best or similarity > best[i][5]):
                    at = int(start + w)
                    best[i] = (i, at, at + n + width - 1, bits, self.items[i].item_id, similarity)


def _stretches(at: list[int], size: int, n: int) -> Iterator[tuple[int, int]]:
    """Starts, as [low, high), of the windows of ``size`` that hold one of the sorted places; of a text of n shingles."""
    low, high = None, None
    for p in at:
        a, b = max(0, p - size + 1), min(p, n - size) + 1
        if a >= b:
            continue
        if low is None:
            low, high = a, b
        elif a <= high:
            high = max(high, b)
        else:
            yield low, high
            low, high = a, b
    if low is not None:
        yield low, high


class Passes:
    """The items in ``n`` portions of about ``words`` words, so that neither driver nor task ever holds more."""

    def __init__(self, benchmark: DataFrame, words: int = PASS_WORDS) -> None:
        self.items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
        self.n = 1 + (self.items.agg(F.sum(F.length("text"))).first()[0] or 0) // (6 * words)

    def __iter__(self) -> Iterator[list[tuple[int | None, str]]]:
        for k in range(self.n):
            part = self.items if self.n == 1 else self.items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == k)
            yield sorted(map(tuple, part.distinct().collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


LEAK = "struct<item_id: bigint, first_word: bigint, end_word: bigint, bits: bigint, similarity: double>"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaks (array of item_id, first_word, end_word, bits, similarity).

    A leak is the window of as many words as an item (all words of a shorter text), anywhere in the whole text, that is most similar to it: at least 0.8 by
    5-word shingles, each weighing as often as it occurs. Items of fewer words are one shingle, items without
    words (null and empty ones) are never found, items that repeat are looked for once. Null and empty texts have no leaks; a null
    doc_id stays null; rows that repeat are searched each; other columns are ignored; an empty table gives none, an empty
    benchmark no leaks.
    """
    out = texts(docs).withColumn("leaks", F.lit(None).cast(f"array<{LEAK}>"))
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("leaks", pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("bits", pa.int64()), ("similarity", pa.float64())])))])
    portions = Passes(benchmark)
    for k, items in enumerate(portions):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by PASS_WORDS

        def found(rows: Iterator[tuple], shared=shared, last=k == portions.n - 1) -> Iterator[tuple]:
            index = Index(shared.value)
            for doc_id, text, leaks in rows:
                more = [{"item_id": x[4], "first_word": x[1], "end_word": x[2], "bits": x[3], "similarity": x[5]} for x in index.search(text)]
                yield doc_id, None if last else text, (leaks or []) + more

        out = map_rows(out, found, ["doc_id", "text", "leaks"], f"doc_id long, text string, leaks array<{LEAK}>", arrow, size=500)
    return out.select("doc_id", "leaks")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any leak, with all their columns."""
    for items in Passes(benchmark):
        shared, at = docs.sparkSession.sparkContext.broadcast(items), docs.columns.index("text")

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not index.search(x.as_py() or "") for x in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs
