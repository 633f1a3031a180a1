"""SimHash near-dedup by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structnet.llm.common import map_rows, signed, spread, text_hash, texts, written, written_rows
from structnet.llm.components import components

SEED = 42
#: Buckets of more fingerprints are linked through their neighbours, not pair by pair.
BUCKET = 64


def words_of(text: str) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return text.encode().lower().split()


def shingles(words: list[bytes], width: int) -> list[bytes]:
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def shingle_hashes(words: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the shingles, of which a long text never holds more than PART at once."""
    parts = [hashes(shingles(words[i:i + PART + width - 1], width), seed) for i in range(0, max(1, len(words) - width + 1), PART)]
    return np.concatenate(parts)


def hashes(items: list[bytes], seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in items), np.uint64, len(items))


def majority(h: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint: bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 3) -> int:
    return majority(shingle_hashes(words_of(text), width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def found(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, signed(fingerprint(text, width))

    return map_rows(texts(docs), found, ["doc_id", "text"], "doc_id long, fp long", pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]))


def variants(words: list[Column], bits: int, of: int) -> Column:
    """Array of keys of a signature: each segment of ``bits`` bits with each of its bits left out.

    ``words``: the signature as longs of ``of`` bits. A key is a hash of the segment, the place left out, and the other bits.
    """
    out = []
    for segment in range(len(words) * of // bits):
        word = words[segment * bits // of]
        value = F.shiftrightunsigned(word, segment * bits % of).bitwiseAND(F.lit((1 << bits) - 1))
        out += [F.xxhash64(F.lit(segment * bits + i), value.bitwiseAND(F.lit(~(1 << i)))) for i in range(bits)]
    return F.array(*out)


def differing(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``(a, b)`` that connect what fingerprints ``fp`` within ``radius`` (up to 3) bits of each other connect.

    Of 64 bits cut into two segments, one differs by one bit at most, so links share a key of one segment with
    one bit left out. Fingerprints that meet on a key are joined, and every pair is verified. Members of a bucket with
    more than BUCKET fingerprints are linked exactly without pairs: two are within two bits if and only if they share a
    point within one bit of both, and each is tied to the smallest that has the point. (Beyond two bits, such buckets are joined as well.)
    """
    keyed = spread(fps.select("fp").distinct()).select("fp", F.explode(variants([F.col("fp")], 32, 64)).alias("key"))
    members = written(keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))
    hot = F.col("n") > BUCKET if radius <= 2 else F.lit(False)
    close = differing([F.col("a")], [F.col("b")]) <= radius
    some = members.where(~hot)
    edges = some.select("key", F.col("fp").alias("a")).join(some.select("key", F.col("fp").alias("b")), "key").where(F.col("a") < F.col("b")).where(close).select("a", "b").distinct()
    if radius <= 2:
        hub = members.where(hot).select("fp").distinct()
        points = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)))
        point = hub.select("fp", F.explode(points).alias("point"))
        lows = point.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("high")).where("a < high").select("point", "a")
        edges = edges.union(point.join(lows, "point").where("fp <> a").select("a", F.col("fp").alias("b")).distinct())
    return edges


def near_groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id that links lead to).

    ``fp``: bits set in over half the XXH64 hashes of the word shingles, repeats included. Texts with fewer words than ``width`` have one
    shingle, those without words (null and empty ones) the fingerprint 0, which links like any other. Rows with equal
    fingerprints are one node, however many they are. A null doc_id gets a component, its own being null only if nobody
    in it has an id; rows that repeat are listed each; other columns are ignored; an empty table gives none.
    """
    rows = written(fingerprints(docs, width))
    nodes = components(near_links(rows, radius))
    lows = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    lows = lows.join(nodes, lows["fp"] == nodes["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    firsts = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows.join(lows.join(firsts, "component").select("fp", "component_id"), "fp")


# --- near duplicates by similarity ---------------------------------------------------------------------------------

#: The keys of :func:`near_duplicates`: BANDS, each a hash of the least shingles by BAND_ROWS orders. Of pairs with similarity j a
#: share of 1 - (1 - j ** BAND_ROWS) ** BANDS meets on a key, whatever kind of edit parts them: 0.9993 at 0.8, 0.99999 at 0.85.
BANDS, BAND_ROWS = 24, 6
#: What a member and its buckets' smallest ones differ by at most: bits of the SHAPE longs, a SimHash of the shingles. Pairs at the threshold differ by
#: 116 of 768 (deviation 10), those of four and five shingles by 144 (deviation 11).
SHAPE, SHAPE_FARTHEST = 12, 190
#: Counters of shingles that order them by rarity, and how much larger the sizes of a class of sets are than those of the one before.
CELLS, CLASS_STEP = 1 << 22, 1.05
#: Buckets' smallest members that a member is compared with before its groups are looked at: those that it shares most keys with.
TRIES = 6
#: Longs that mark a set in the last round: a bit each for whether an odd number of its shingles falls there.
MARKS = 8
#: Shingles that are hashed at a time.
PART = 1 << 14


def remixed(h: np.ndarray) -> np.ndarray:
    """Other hashes from hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majorities(h: np.ndarray, n: int) -> list[int]:
    out = []
    for _ in range(n):
        out.append(signed(majority(h)))
        h = remixed(h + np.uint64(1))
    return out


_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each band of the MinHash of shingle hashes; the same ones for all empty sets."""
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(h), 1 << 10):
        np.minimum(least, ((h[i:i + (1 << 10)] ^ _ORDERS[0]) * (_ORDERS[1] | np.uint64(1))).min(1), out=least)
    return [signed(xxhash.xxh64_intdigest(x.tobytes(), i)) for i, x in enumerate(least.reshape(BANDS, BAND_ROWS))]


def shingle_set(words: list[bytes], width: int = 5) -> np.ndarray:
    """Distinct shingles as 32-bit hashes: of a thousand, two meet by chance in one text of ten thousand."""
    return np.unique(shingle_hashes(words, width, 5).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sequence_hashes(words: list[bytes]) -> tuple[int, int]:
    whole = b" ".join(words)
    return signed(xxhash.xxh64_intdigest(whole, 1)), signed(xxhash.xxh64_intdigest(whole, 2))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs whose shingle sets, hashes as bytes, have at least the similarity."""
    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")

    def similar(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, x, y in rows:
            if jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= least:
                yield a, b

    return map_rows(both, similar, ["a", "b", "of_a", "of_b"], "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]))


@lru_cache(maxsize=1024)
def class_starts(most: int, step: float = CLASS_STEP) -> np.ndarray:
    """The smallest size of each class of set sizes, up to ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * step))))
    return np.array(out)


def prefix_keys(shingles: np.ndarray, cells: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sides, and how many elements each key's and all after it are: two sets with a similarity of ``least`` or more have a
    key in common, on opposite sides, from which on both hold as many elements as they must share.

    Sets of n and m elements with that similarity share at least o = least / (1 + least) * (n + m) of them, so in any common order of all
    elements their first n - o + 1 and m - o + 1 have one in common. The order is by ``cells``, counts by hash, so rare ones
    come first: of sets that share a passage but are not as similar, the passage lies beyond these. How many places count depends on
    both sizes, so keys name the classes of both: the smaller one's set is on side 0, the larger one's on side 1, of the same class on both.
    """
    n = len(shingles)
    if not n:
        return np.zeros(2, np.uint64), np.array([0, 1]), np.zeros(2, np.int64)
    own = shingles[np.lexsort((shingles, cells[shingles % np.uint32(len(cells))]))].astype(np.uint64)
    starts = class_starts(int(n / least) + 1)
    mine = int(np.searchsorted(starts, n, "right")) - 1
    exact = Fraction(str(least))
    out, sides, rest = [], [], []
    for other in range(len(starts) - 1):
        low = max(int(starts[other]), -(-n * exact.numerator // exact.denominator))
        shared = exact / (1 + exact) * (n + low)  # with the smallest set of that class; more with any other
        places = n - -(-shared.numerator // shared.denominator) + 1
        if low < starts[other + 1] and places > 0:
            keys = remixed(own[:places] | np.uint64(min(mine, other) << 16 | max(mine, other)) << np.uint64(32))
            for side in {0, 1} if mine == other else {int(mine > other)}:
                out.append(keys)
                sides.append(np.full(len(keys), side))
                rest.append(n - np.arange(len(keys)))
    return np.concatenate(out), np.concatenate(sides), np.concatenate(rest)


_LINK = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("rest", pa.int32()), ("size", pa.int32()), ("node", pa.int64()), ("part", pa.int64())])


def _rarity(some: DataFrame) -> np.ndarray:
    """A count for each of CELLS hashes of shingles, as a byte: eight steps for each doubling from four on. Of fixed size whatever the input is."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column("shingles"):
                np.add.at(counts, np.frombuffer(x.as_buffer(), np.uint32) % np.uint32(CELLS), 1)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 50_000]), pa.array(counts[at[i:i + 50_000]])], ["cell", "n"])

    rows = some.select("shingles").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n >= 4")
    found = rows.select(F.col("cell").cast("int"), F.least(F.floor(8 * F.log2("n")), F.lit(255)).cast("short").alias("level")).toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[found["cell"].to_numpy()] = found["level"].to_numpy()
    return out


def parities(shingles: np.ndarray) -> np.ndarray:
    """MARKS longs. Each shingle that only one of two sets has changes one bit, so they differ by as many bits as the sets by shingles, or by fewer."""
    odd = np.bincount(remixed(shingles.astype(np.uint64)) % np.uint64(64 * MARKS), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _marks(some: DataFrame) -> DataFrame:
    """``parities`` of every node: node, m0 to the last."""

    def marked(rows: Iterator[tuple]) -> Iterator[tuple]:
        for node, x in rows:
            yield node, *parities(np.frombuffer(x, np.uint32)).tolist()

    names = ["node", *(f"m{i}" for i in range(MARKS))]
    return map_rows(some, marked, ["node", "shingles"], ", ".join(f"{n} long" for n in names), pa.schema([(n, pa.int64()) for n in names]))


def _across(members: DataFrame, groups: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Keys that connect different groups within buckets: key, side, rest, size, node. No pair that is ``least`` similar shares none.

    And the nodes' :func:`parities`.
    """
    member = members.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    mixed = member.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    some = written(member.join(mixed, "key", "left_semi").select("node", "part").distinct().join(sets, F.col("node") == F.col("row")).drop("row"))
    cells = _rarity(some)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, part, x in zip(*(batch.column(c) for c in ("node", "part", "shingles")), strict=True):
                shingles = np.frombuffer(x.as_buffer(), np.uint32)
                own, side, rest = prefix_keys(shingles, cells, least)
                fixed = [np.full(len(own), v, t) for v, t in ((len(shingles), np.int32), (node.as_py(), np.int64), (part.as_py(), np.int64))]
                columns = [own.view(np.int64), side.astype(np.int32), rest.astype(np.int32), *fixed]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=_LINK)

    keyed = written(some.mapInArrow(keys, "key long, side int, rest int, size int, node long, part long"))
    return written(keyed.join(_mixed(keyed), "key", "left_semi").drop("part")), _marks(some)


def _mixed(keyed: DataFrame, hub: Callable[[Column], Column] = F.min) -> DataFrame:
    """Keys whose two sides hold different groups, with a member of each side (``hub``, the smallest or the largest) and its group."""
    on = lambda side, x: F.when(F.col("side") == side, x)
    hubs = [hub(on(1 - i, F.struct("node", "part"))).alias(f"hub_{i}") for i in (0, 1)]  # of the other side
    ends = F.min("part").alias("low"), F.max("part").alias("high")
    return keyed.groupBy("key").agg(*ends, *hubs).where("low <> high AND hub_0 IS NOT NULL AND hub_1 IS NOT NULL").select("key", "hub_0", "hub_1")


def _alike(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges that tie the nodes whose fingerprints ``fp`` are linked, by deletion variants, to the smallest node of each component."""
    linked = components(near_links(nodes, radius)).withColumnsRenamed({"node": "fp"})
    near = written_rows(nodes.select("node", "fp").join(linked, "fp", "left").select("node", F.coalesce("component", "fp").alias("near")))
    lows = near.groupBy("near").agg(F.min("node").alias("low"))
    return near.join(lows, "near").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))


def _merged(groups: DataFrame, found: DataFrame) -> DataFrame:
    """``groups(node, component)`` after links ``(a, b)``. Only groups that a link joins are looked at again, not every node of them."""
    part = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}"))
    tops = found.join(part("a"), "a", "left").join(part("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    tops = written_rows(components(tops))
    moved = groups.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return written_rows(moved.select("node", F.coalesce("top", "component").alias("component")).union(tops.join(groups.select("node"), "node", "left_anti").select("node", "component")))


def near_duplicates(docs: DataFrame, least: float = 0.8, width: int = 5, radius: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, row (a number), group (the smallest row number among its near duplicates), n_words, text_hash.

    Two rows are near duplicates if their sets of ``width``-word shingles are at least ``least`` similar; groups are what such
    links connect. Candidates share the key of a MinHash band of their shingles, which a pair misses with the probability stated at BANDS.
    First each member is compared with the smallest ones of its buckets, the TRIES that it shares most keys with and whose SimHash differs by SHAPE_FARTHEST bits at most.
    Where that leaves a bucket with more than one group, its members meet again on :func:`prefix_keys`, which no similar pair lacks and texts that
    only share a passage do not have in common: first with the smallest and the largest member of each key, then members of groups that are still apart,
    unless the :func:`parities` of their sets differ by more than similar sets do.
    So no link between groups is lost, copies cost a few comparisons each, and a passage that many share makes no pairs.
    With ``radius``, rows whose :func:`fingerprint` differs by as many bits or fewer are near duplicates too, as in :func:`near_groups`: deletion-variant
    signatures find these links first, all of them.
    Null and empty texts are one group; so are rows with equal word sequences. Null ids and rows that repeat are rows like any
    other, other columns are ignored, an empty table gives none.
    """

    def described(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            words = words_of(text)
            own = np.unique(shingle_hashes(words, width, 5))
            fp = 0 if radius is None else signed(majority(shingle_hashes(words, 3)))
            yield doc_id, text_hash(text), *sequence_hashes(words), len(words), fp, band_keys(own), *majorities(own, SHAPE)

    def set_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in rows:
            words = words_of(text)
            yield *sequence_hashes(words), shingle_set(words, width).tobytes()

    shape = [f"s{i}" for i in range(SHAPE)]
    docs = texts(docs)
    longs = [(x, pa.int64()) for x in ("doc_id", "text_hash", "h1", "h2", "n_words", "fp")]
    arrow = pa.schema([*longs, ("keys", pa.list_(pa.int64())), *((x, pa.int64()) for x in shape)])
    rows = map_rows(docs, described, ["doc_id", "text"], "doc_id long, text_hash long, h1 long, h2 long, n_words long, fp long, keys array<long>, " + ", ".join(f"{x} long" for x in shape), arrow)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    equal = rows.groupBy("h1", "h2").agg(F.min("row").alias("first"))
    rows = written(rows.join(equal, ["h1", "h2"]))
    nodes = rows.where("row = first").select(F.col("row").alias("node"), "fp", "keys", *shape)
    alike = None if radius is None else _alike(nodes, radius)

    bucket = Window.partitionBy("key")
    members = nodes.select("node", F.explode("keys").alias("key")).withColumn("low", F.min("node").over(bucket)).withColumn("n", F.count("*").over(bucket))
    members = written(members.where("n > 1"))
    nodes = nodes.drop("keys", "fp")
    sides = [nodes.select(F.col("node").alias(x), *(F.col(n).alias(f"{x}_{n}") for n in shape)) for x in "ab"]
    shapes = [[F.col(f"{x}_{n}") for n in shape] for x in "ab"]
    near = differing(*shapes) <= SHAPE_FARTHEST
    tries = members.where("node <> low").groupBy("node", "low").agg(F.count("*").alias("shared"), F.min("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "low"))  # a node has BANDS keys
    tries = written_rows(tries.withColumn("later", nth > TRIES).where("not later or n = 2").select(F.least("low", "node").alias("a"), F.greatest("low", "node").alias("b"), "later"))
    star = tries.where("not later").select("a", "b").distinct()
    star = written_rows(star.join(sides[0], "a").join(sides[1], "b").where(near).select("a", "b"))
    ends = F.explode(F.array("a", "b")).alias("row")
    wanted = star.select(ends).union(tries.where("later").select(ends)).union(members.where("n > 2").select("node")).distinct()

    wanted = rows.join(wanted, "row").select("doc_id", "h1", "h2", "row")
    some = docs.alias("d").join(wanted.select(F.col("doc_id").alias("id")).distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = map_rows(some, set_of, ["text"], "h1 long, h2 long, shingles binary", pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("shingles", pa.binary())]), size=500)
    sets = written(sets.join(wanted, ["h1", "h2"]).groupBy("row").agg(F.first("shingles").alias("shingles")))
    links = written_rows(_verified(star, sets, least))

    groups = written_rows(components(links if alike is None else links.union(alike)))
    keyed, marks = _across(members, groups, sets, least)
    share = Fraction(str(least)) / (1 + Fraction(str(least)))
    for hubs in (F.min, F.max, None):  # first a key's members with its smallest and its largest, then what is left between groups
        member = keyed.join(groups, "node", "left").select("key", "side", "rest", "size", "node", F.coalesce("component", "node").alias("part"))
        mixed = _mixed(member, hubs or F.min)
        if hubs:
            hub = F.when(F.col("side") == 0, F.col("hub_0")).otherwise(F.col("hub_1"))
            pairs = member.join(mixed, "key").withColumn("hub", hub).where("part <> hub.part").select(F.col("node").alias("x"), F.col("hub.node").alias("y"))
        else:
            member = member.join(mixed.select("key"), "key", "left_semi").join(marks, "node")
            bits = [f"m{i}" for i in range(MARKS)]
            sides = [member.where(F.col("side") == i).select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "part", "rest", "size", *bits))) for i, x in enumerate("xy")]
            both = (F.col("x_size") + F.col("y_size")).cast("long")
            enough = F.least("x_rest", "y_rest").cast("long") * share.denominator >= both * share.numerator
            apart = differing(*([F.col(f"{x}_{n}") for n in bits] for x in "xy"))  # what they do not share, or less
            enough = enough & (apart.cast("long") * share.denominator <= both * (share.denominator - 2 * share.numerator))
            pairs = sides[0].join(sides[1], "key").where(enough & (F.col("x_part") != F.col("y_part"))).select(F.col("x_node").alias("x"), F.col("y_node").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        found = _verified(pairs.distinct(), sets, least)
        groups = _merged(groups, found)
    return rows.join(groups, rows["first"] == groups["node"], "left").select("doc_id", "row", F.coalesce("component", "first").alias("group"), "n_words", "text_hash")
