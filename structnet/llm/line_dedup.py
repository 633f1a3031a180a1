"""Edit-distance join of lines by segment partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structnet.llm.common import map_rows, signed, texts, written

#: Lines link at this many edits at most, if that is no more than SHARE of the longer line.
EDITS = 2
SHARE = 0.2
#: Marks the keys of a line's own segments, above its letter counts.
OWN = 1 << 40


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 even segments, longer ones last."""
    n = edits + 1
    short, longer = length // n, length % n
    out, at = [], 0
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, of: int, edits: int = EDITS) -> Iterator[tuple[int, int, int]]:
    """(segment, start, size): substrings of a line of ``length`` that can hold a segment of a line of length ``of <= length``.

    If the first segment that is found unchanged is segment i, at most i edits precede it and edits - i follow; both
    bounds, from either end, limit how far it has moved.
    """
    moved = length - of
    for i, (start, size) in enumerate(segments(of, edits)):
        low = max(0, start - i, start + moved - (edits - i))
        high = min(length - size, start + i, start + moved + (edits - i))
        for at in range(low, high + 1):
            yield i, at, size


def edit_distance(a: str, b: str, edits: int = EDITS) -> int:
    """Edit distance, or edits + 1 if it is more: a bit-parallel column that slides down a band of 2 x edits + 1 diagonals."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n) if a[:n] != b[:n] else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return edits + 1
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + edits)  # rows before the first are padding
    width = 2 * edits + 1
    band = (1 << width) - 1
    # bit k of column j is row j - edits + k; up and down are the vertical steps inside the band
    up, down = band & ~((1 << edits) - 1), 0
    distance = edits  # of the lowest diagonal; it is reached by ``edits`` insertions from the main one
    last = edits + len(a) - len(b)  # bit of the diagonal that ends at the corner
    up <<= 1
    for j, c in enumerate(b):
        match = (places.get(c, 0) >> j) & band
        v_up, v_down = (up >> 1) & band, (down >> 1) & band
        same = ((((match & v_up) + v_up) ^ v_up) | match | v_down) & band
        h_up = v_down | (~(same | v_up) & band)
        h_down = same & v_up
        distance += not same >> (width - 1) & 1
        shifted = same >> 1
        up = (h_down | (~(shifted | h_up) & band)) << 1
        down = (h_up & shifted) << 1
        corner = (up >> 1, down >> 1)
    v_up, v_down = corner
    for k in range(width - 2, last - 1, -1):  # from the lowest row of the last column up to the corner
        distance += (v_down >> k & 1) - (v_up >> k & 1)
    return min(distance, edits + 1)


def _hash(data: bytes, seed: int = 42) -> int:
    return signed(xxhash.xxh64_intdigest(data, seed))


def keys_of(line: str, edits: int = EDITS) -> list[int]:
    """Keys of a line: first those of its own segments, by which it is found and finds lines of its length, then those it only looks up."""
    own, others = [], []
    placed = set(enumerate(start for start, _ in segments(len(line), edits)))
    for of in range(len(line), max(edits, len(line) - edits - 1), -1):
        for i, at, size in probes(len(line), of, edits):
            key = _hash(line[at:at + size].encode(), of * (edits + 1) + i)
            (own if of == len(line) and (i, at) in placed else others).append(key)
    return own + others


_GROUPS = bytes(b % 8 if b < 128 else 8 for b in range(256))


def letters(line: str) -> int:
    """How many characters each of eight groups of ASCII characters has, modulo 16, four bits a group."""
    groups = line.encode().translate(_GROUPS)
    return sum((groups.count(k) & 15) << 4 * k for k in range(8))


def letters_differ(a: Column, b: Column) -> Column:
    """At least so many more or fewer characters, over all groups; an edit changes two counts by one at most."""
    out = F.lit(0)
    for k in range(8):
        d = F.abs(F.shiftright(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * k).bitwiseAND(F.lit(15)))
        out = out + F.least(d, 16 - d)
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, h1, h2: every line between line feeds that is not empty; the hashes stand for the line."""
    rows = texts(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''")
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64("line", F.lit(1)))


def near_lines(docs: DataFrame, edits: int = EDITS, share: float = SHARE) -> DataFrame:
    """Pairs of different lines within ``edits`` edits, no more than ``share`` of the longer line: a1, a2, b1, b2 (hashes), distance. Each pair once.

    Lines are cut into edits + 1 segments, one of which every match has unchanged. Each line writes its own segments and
    looks up, length by length, the substrings that may be one; rows that meet on a key are candidates, and the banded
    distance verifies them, if their letters allow it. A line that repeats writes its keys once a task. Keys that only one line has go before the join.
    """

    def keyed(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: set[int] = set()
        for (text,) in rows:
            for line in text.split("\n"):
                if len(line) > edits:
                    own = _hash(line.encode())
                    if own not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(own)
                        yield own, letters(line), keys_of(line, edits)

    arrow = pa.schema([("id", pa.int64()), ("letters", pa.int64()), ("keys", pa.list_(pa.int64()))])
    rows = map_rows(texts(docs), keyed, ["text"], "id long, letters long, keys array<long>", arrow)
    rows = rows.select("id", "letters", F.posexplode("keys").alias("place", "key"))
    rows = rows.select("key", "id", (F.col("letters") + F.when(F.col("place") <= edits, OWN).otherwise(0)).alias("mark"))  # one number, for narrow rows
    bucket = Window.partitionBy("key")
    rows = rows.withColumn("low", F.min("id").over(bucket)).withColumn("high", F.max("id").over(bucket)).withColumn("found", F.max("mark").over(bucket))
    rows = written(rows.where("low <> high").where(F.col("found") >= OWN).select("key", "id", "mark").distinct().select("key", "id", (F.col("mark") >= OWN).alias("own"), (F.col("mark") % OWN).alias("letters")))
    own = rows.where("own").select("key", F.col("id").alias("a"), F.col("letters").alias("letters_a"))
    looks = rows.select("key", F.col("id").alias("b"), "own", F.col("letters").alias("letters_b"))
    alike = letters_differ(F.col("letters_a"), F.col("letters_b")) <= 2 * edits
    pairs = own.join(looks, "key").where("a <> b and (not own or a < b)").where(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
    known = written(lines_of(docs).join(wanted, "h1", "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line")))
    left, right = (known.select(F.col("h1").alias(x), F.col("h2").alias(f"{x}2"), F.col("line").alias(f"line_{x}")) for x in "ab")

    def verified(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, a2, x, b, b2, y in rows:
            distance = edit_distance(x, y, edits)
            if distance <= edits and distance <= share * max(len(x), len(y)):
                yield a, a2, b, b2, distance

    arrow = pa.schema([(n, pa.int64()) for n in ("a1", "a2", "b1", "b2", "distance")])
    return map_rows(pairs.join(left, "a").join(right, "b"), verified, ["a", "a2", "line_a", "b", "b2", "line_b"], "a1 long, a2 long, b1 long, b2 long, distance long", arrow)


def line_classes(docs: DataFrame, edits: int = EDITS, share: float = SHARE) -> DataFrame:
    """One row per line that is not empty: doc_id, line_no, class_doc_id, class_line_no, copies, n_links, nearest.

    A class is all equal lines, named by the first (smallest doc_id, then line_no) of its ``copies``; ``n_links`` counts the other classes
    within :func:`near_lines`, ``nearest`` is the least distance, null without links. Lines of one
    or two characters have no links, since any edit exceeds the share. Null and empty texts have no lines; a null doc_id sorts
    last as a class name; rows that repeat have lines each; other columns are ignored; an empty table gives none.
    """
    lines = written(lines_of(docs).drop("line"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no"))
    classes = lines.groupBy("h1", "h2").agg(F.count("*").alias("copies"), first.alias("first"))
    links = near_lines(docs, edits, share)
    ends = links.select(F.explode(F.array(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2"), "distance"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2"), "distance"))).alias("x")).select("x.*")
    ends = ends.groupBy("h1", "h2").agg(F.count("*").alias("n_links"), F.min("distance").alias("nearest"))
    classes = classes.join(ends, ["h1", "h2"], "left")
    return lines.join(classes, ["h1", "h2"]).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").cast("long").alias("class_line_no"),
        "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "nearest")
