"""Exact dedup by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structnet.llm.common import SPACES, map_rows, text_hash, texts, written

#: (prime, base) of the two fingerprints; the primes are below 2**31, so products fit in 64 bits.
MODULI = ((2**31 - 1, 1_000_003), (2**31 - 19, 69_069_077))
CHUNK = 1 << 15
SALTS = 16


def _powers() -> tuple[np.ndarray, ...]:
    out = []
    for p, r in MODULI:
        x = np.ones(CHUNK + 1, np.uint64)
        done = 1
        while done <= CHUNK:  # doubling: r**(done + i) = r**done * r**i
            n = min(done, CHUNK + 1 - done)
            x[done:done + n] = x[:n] * np.uint64(pow(r, done, p)) % np.uint64(p)
            done += n
        out.append(x)
    return tuple(out)


POWERS = _powers()


def chunk_fingerprint(data: bytes) -> tuple[int, int, int]:
    """(first, second, length) of at most CHUNK bytes."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(a)
    return *(int((a * w[:n][::-1]).sum()) % p for (p, _), w in zip(MODULI, POWERS, strict=True)), n


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint of two texts one after the other: the first is shifted by the length of the second."""
    return *((x * pow(r, b[2], p) + y) % p for (p, r), x, y in zip(MODULI, a, b, strict=False)), a[2] + b[2]


def fingerprint(data: bytes) -> tuple[int, int, int]:
    out = (0, 0, 0)
    for i in range(0, len(data), CHUNK):
        out = combine(out, chunk_fingerprint(data[i:i + CHUNK]))
    return out


def normal(text: str) -> bytes:
    return text.encode().translate(None, SPACES)


def _described(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, text in rows:
        data = normal(text)
        yield doc_id, len(text), text_hash(text), hashlib.sha256(data).hexdigest(), *fingerprint(data)


def _chunked(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, text in rows:
        data = normal(text)
        yield doc_id, *fingerprint(data), [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]


def _differing(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Fingerprints that texts share which differ in some chunk.

    Copies are compared chunk by chunk: all are equal if the smallest and the largest chunk at a place are. Both
    are aggregated in every task first, and a fingerprint's rows are dealt over SALTS tasks.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("chunks", pa.list_(pa.binary()))])
    chunks = map_rows(docs, _chunked, ["doc_id", "text"], "doc_id long, h1 long, h2 long, n long, chunks array<binary>", arrow, size=200)
    chunks = chunks.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = chunks.join(shared, ["h1", "h2", "n", "salt"], "left_semi").select("h1", "h2", "n", "salt", F.posexplode("chunks").alias("at", "chunk"))
    place = ["h1", "h2", "n", "at"]
    ends = own.groupBy(*place, "salt").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    ends = ends.groupBy(*place).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return ends.where("low <> high").select("h1", "h2", "n").distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after deleting white space ``[\\x20\\x09-\\x0D]``. The row with the most code
    points stays, then the smallest doc_id; a null doc_id stays only if there is no other, and of rows that are the
    same in all of it exactly one stays. Null texts count as empty, empty ones are equal to each other. Other
    columns are ignored; an empty table gives none.

    Fingerprints gather candidate groups; :func:`_differing` compares their texts. Should texts that differ share
    one, which the comparison would find, their group is split by SHA-256.
    """
    docs = texts(docs)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text_hash", pa.int64()), ("text_sha256", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])
    rows = map_rows(docs, _described, ["doc_id", "text"], "doc_id long, n_chars long, text_hash long, text_sha256 string, h1 long, h2 long, n long", arrow)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    key = ["h1", "h2", "n"]
    differing = _differing(docs, rows.groupBy(*key).count().where("count > 1").select(*key))
    rows = rows.join(differing.withColumn("split", F.lit(True)), key, "left").withColumn("part", F.when(F.col("split"), F.col("text_sha256")).otherwise(""))
    # The bits of a number turned round order backwards, and unlike its negative every number has them.
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("neg"), F.bitwise_not("row").alias("row_neg")))
    groups = rows.groupBy(*key, "part").agg(F.count("*").alias("group_size"), best.alias("best"))
    return rows.join(groups, [*key, "part"]).select(
        "doc_id", F.bitwise_not("best.neg").alias("keep_id"), "group_size", (F.col("row") == F.bitwise_not("best.row_neg")).alias("kept"), "text_sha256", "n_chars", "text_hash", "row")
