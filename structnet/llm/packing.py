"""Packing into token windows, best fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from structnet.llm.common import map_rows, texts
from structnet.llm.tokens import ids_of, vocabulary

WINDOW = 1024
#: Remainders that a task packs at a time; bounds its memory.
RUN = 16_384
#: A gap of at least this share of the window is filled by cutting pieces of the emptiest windows.
GAP = 64


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaves are the capacities."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the window with the least capacity that is at least ``size``."""
        at = size + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until a right neighbour has windows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indexes of the pieces of each window; pieces are taken by decreasing size, ties as they stand."""
    open_windows, out = OpenWindows(window), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_windows.tightest(sizes[i])
        capacity, at = found or (window, len(out))
        if found is None:
            out.append([])
        out[at].append(i)
        if capacity > sizes[i]:
            open_windows.put(capacity - sizes[i], at)
    return out


def fill_gaps(windows: list[list[tuple[int, int, int]]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, from, length) in which large gaps are filled with cuts of the emptiest windows."""
    full = lambda w: sum(x[2] for x in w)
    windows = sorted(windows, key=full)
    low, high = 0, len(windows) - 1
    while low < high:
        gap = window - full(windows[high])
        while gap * GAP >= window and low < high:
            piece, start, length = windows[low].pop()
            n = min(gap, length)
            windows[high].append((piece, start + length - n, n))
            if n < length:
                windows[low].append((piece, start, length - n))
            gap -= n
            low += not windows[low]
        high -= 1
    return [w for w in windows if w]


def _packed(rest: list[tuple], window: int, number: Iterator[int]) -> Iterator[tuple]:
    """rest: (doc_id, start, ids, doc_tokens) of at most a window each."""
    groups = [[(i, 0, len(rest[i][2])) for i in w] for w in best_fit([len(x[2]) for x in rest], window)]
    for group in fill_gaps(groups, window):
        sequence, offset = next(number), 0
        for i, cut, length in group:
            doc_id, start, ids, total = rest[i]
            yield doc_id, start + cut, length, ids[cut:cut + length].tobytes(), total, sequence, offset
            offset += length


def pack(docs: DataFrame, window: int = WINDOW, files: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit ids of the piece. A document is its ids and the id 0, so that a null or
    empty text gives one piece of one id. Overlong documents are cut into full windows first; the rest of every
    document goes to the open window it fits most tightly. Last, gaps of at least 1/64 window are filled by
    cutting pieces of the emptiest windows. Rows that repeat, or share a doc_id, are packed each; a null doc_id stays
    null; other columns are ignored; an empty table gives none.

    Every task packs the documents it reads, RUN at a time, so nothing is shuffled and a hot source does not
    matter. ``sequence_id`` is the task's number and one within it. ``files``: the vocabulary as merges and ranks.
    """
    merges, ranks = files or vocabulary()

    def packed(rows: Iterator[tuple]) -> Iterator[tuple]:
        to_ids, rest = ids_of(merges, ranks), []
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        number = iter(range(first, first + (1 << 40)))
        for doc_id, text in rows:
            ids = np.append(to_ids(text), np.uint32(0)).astype("<u4", copy=False)
            whole = len(ids) // window * window
            for at in range(0, whole, window):
                yield doc_id, at, window, ids[at:at + window].tobytes(), len(ids), next(number), 0
            if whole < len(ids):
                rest.append((doc_id, whole, ids[whole:].copy(), len(ids)))
            if len(rest) >= RUN:
                yield from _packed(rest, window, number)
                rest = []
        yield from _packed(rest, window, number)

    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    return map_rows(texts(docs), packed, ["doc_id", "text"], "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long", arrow, size=1000)
