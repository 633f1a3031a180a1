"""Edit-aware token counts: a segment tree over the pre-tokens of each document."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structnet.llm.common import map_rows, texts
from structnet.llm.tokens import Ids, ids_of, vocabulary

#: Code points of a leaf, at least; a leaf is a run of whole pre-tokens.
LEAF = 256
EDITS = "array<struct<start: bigint, deleted: bigint, inserted: string>>"
TREE = "doc_id long, text string, leaf_chars array<long>, tree array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("leaf_chars", pa.list_(pa.int64())), ("tree", pa.list_(pa.int64()))])


def leaves(text: str, size: int = LEAF, most: int | None = None) -> list[int]:
    """Lengths of the leaves, ``most`` at most. A cut lies before a single space, between characters that are no white space.

    There, pre-tokens end whatever stands around those three characters, so leaves are encoded on their own.
    """
    out, at, search = [], 0, size
    while len(text) - at > size and (most is None or len(out) < most - 1):
        p = text.find(" ", search)
        if p < 0:
            break
        if p + 1 < len(text) and not text[p - 1].isspace() and not text[p + 1].isspace():
            out.append(p - at)
            at, search = p, p + size
        else:
            search = p + 1
    return [*out, len(text) - at]


def build(text: str, ids: Ids) -> tuple[list[int], list[int]]:
    """Leaf lengths, and the tree: node 1 is the root, node i has the children 2i and 2i + 1, leaves come last."""
    chars = leaves(text)
    width = 1 << (len(chars) - 1).bit_length()
    ends = list(accumulate(chars))
    tree = [0] * width + [len(ids(text[e - n:e])) for e, n in zip(ends, chars, strict=True)] + [0] * (width - len(chars))
    for i in range(width - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return chars, tree


def accepted(edits: list[dict], n: int) -> list[tuple[int, int, str]]:
    """(start, end, inserted) within a text of n code points, in order. Of edits that overlap the first by start stays, ties as they stand; null starts go."""
    out, free = [], 0
    for e in sorted((e for e in edits or [] if e and e["start"] is not None), key=lambda e: e["start"]):
        start = min(max(0, e["start"]), n)
        end = min(n, start + max(0, e["deleted"] or 0))
        if start >= free:
            out.append((start, end, e["inserted"] or ""))
            free = end
    return out


def edit(text: str, chars: list[int], tree: list[int], edits: list[tuple[int, int, str]], ids: Ids) -> tuple[str, int, int]:
    """The edited text, leaves and code points that were encoded again; ``chars`` and ``tree`` are updated.

    An edit spoils the leaves it touches, and the cut beside them if it comes near its three characters: then the
    neighbour belongs to the context that is encoded again. All others keep their counts.
    """
    starts = [0, *accumulate(chars)]
    regions: list[list] = []
    for start, end, inserted in edits:
        low = min(bisect_right(starts, start) - 1, len(chars) - 1)
        high = max(low, min(bisect_right(starts, max(start, end - 1)) - 1, len(chars) - 1))
        while low > 0 and start <= starts[low] + 1 and end >= starts[low]:
            low -= 1
        while high < len(chars) - 1 and end >= starts[high + 1] and start <= starts[high + 1] + 1:
            high += 1
        if regions and low <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], high)
            regions[-1][2].append((start, end, inserted))
        else:
            regions.append([low, high, [(start, end, inserted)]])
    out, at, width, redone = [], 0, len(tree) // 2, 0
    for low, high, own in regions:
        out.append(text[at:starts[low]])
        at, new = starts[low], []
        for start, end, inserted in own:
            new += [text[at:start], inserted]
            at = end
        new = "".join([*new, text[at:starts[high + 1]]])
        at = starts[high + 1]
        out.append(new)
        redone += len(new)
        slots = high - low + 1
        parts = leaves(new, max(LEAF, len(new) // slots), slots)
        parts += [0] * (slots - len(parts))
        place = 0
        for k, n in enumerate(parts):
            chars[low + k] = n
            node = width + low + k
            change = (len(ids(new[place:place + n])) if n else 0) - tree[node]
            place += n
            while change and node:
                tree[node] += change
                node >>= 1
    return "".join([*out, text[at:]]), sum(high - low + 1 for low, high, _ in regions), redone


def count_tokens(docs: DataFrame, *more: str, files: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, text, leaf_chars, tree of every row; ``tree[1]`` is the token count of the whole text.

    Null texts count as empty: one leaf, no tokens. A null doc_id stays null; rows that repeat are counted each; other columns
    are ignored; an empty table gives none. ``files``: the vocabulary as merges and ranks.
    """
    files = files or vocabulary()

    def built(rows: Iterator[tuple]) -> Iterator[tuple]:
        ids = ids_of(*files)
        for doc_id, text in rows:
            yield doc_id, text, *build(text, ids)

    return map_rows(texts(docs), built, ["doc_id", "text"], TREE, _ARROW, size=200)


def with_edits(counted: DataFrame, edits: DataFrame) -> DataFrame:
    """``counted`` with the column ``edits`` from a table (doc_id, seq, start, deleted, inserted). A document's edits are one value of its row."""
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "deleted", "inserted"))).alias("e"))
    own = own.select("doc_id", F.transform("e", lambda x: F.struct(x["start"].cast("long").alias("start"), x["deleted"].cast("long").alias("deleted"), x["inserted"].alias("inserted"))).alias("edits"))
    return counted.join(own, "doc_id", "left")


def apply_edits(counted: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """Rows of :func:`count_tokens` with a column ``edits``, edited: the same columns, and n_edits, tokens_before, leaves_encoded, chars_encoded.

    Edits name code points of the text before any of them. :func:`accepted` says which of them count.
    """
    files = files or vocabulary()

    def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
        ids = ids_of(*files)
        for doc_id, text, chars, tree, edits in rows:
            edits, before = accepted(edits, len(text)), tree[1]
            text, n, redone = edit(text, chars, tree, edits, ids)
            yield doc_id, text, chars, tree, len(edits), before, n, redone

    more = ("n_edits", "tokens_before", "leaves_encoded", "chars_encoded")
    arrow = pa.schema([*_ARROW, *((n, pa.int64()) for n in more)])
    return map_rows(counted, edited, ["doc_id", "text", "leaf_chars", "tree", "edits"], TREE + "".join(f", {n} long" for n in more), arrow, size=200)
