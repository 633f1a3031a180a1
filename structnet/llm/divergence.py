"""How far the sources of a language differ in their words: smoothed shares of terms, by Arrow's compute functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structnet.llm.common import written

#: Terms are runs of letters A-Z, a-z and of characters beyond ASCII; this is what parts them.
BETWEEN = "[\x00-\x40\x5b-\x60\x7b-\x7f]+"
LEAST_DOCUMENTS, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: UTF-8 bytes that are split at a time (a longer text alone), and rows of counts that a task holds before it gives them on.
PART_BYTES, HELD_ROWS = 4 << 20, 400_000
#: Rows of counts in a shard, and cells of the matrix (terms by sources) that a shard works on.
SHARD_ROWS, CELLS = 50_000, 4_000_000

_KEYS = ["lang", "source", "term"]


def _counts(part: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences), docs (documents with the term) of some rows."""
    words = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), BETWEEN)
    row, term = pc.list_parent_indices(words), pc.list_flatten(words)
    real = pc.not_equal(term, "")
    term = pc.dictionary_encode(term.filter(real))
    each = pa.table({"row": row.filter(real), "term": term.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    named = pa.table({"lang": part.column("lang").take(each["row"]), "source": part.column("source").take(each["row"]), "code": each["term"], "n": each["count_all"]})
    both = named.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    return pa.table({"lang": both["lang"], "source": both["source"], "term": term.dictionary.take(both["code"].combine_chunks()), "n": both["n_sum"], "docs": both["n_count"]})


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column("text")).to_numpy()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > PART_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _merged(tables: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(tables).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return both.rename_columns([c.removesuffix("_sum") for c in both.column_names]).select([*_KEYS, "n", "docs"])


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's rows by lang, source and term, merged as far as HELD_ROWS allows."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for part in _parts(batch):
            held.append(_counts(part))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches(max_chunksize=50_000)


def _share(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * counts / total), exact for counts up to the total and below 9e15: three digits of the quotient at a time."""
    rest, out = np.asarray(counts, np.int64), np.zeros(np.shape(counts), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _shard(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """What the terms of a shard add to each pair of sources of its language, and each source's TOP terms of the shard."""
    sources = groups["source"].to_pylist()
    place = {s: i for i, s in enumerate(sources)}
    lang, v = groups["lang"][0], groups["v"][0].as_py()
    sizes = groups["n"].to_numpy() + SMOOTH * v
    whole = int(groups["n"].to_numpy().sum()) + SMOOTH * v
    term = pc.dictionary_encode(rows["term"].combine_chunks())
    names = term.dictionary.to_pylist()
    code, count = term.indices.to_numpy(), rows["n"].to_numpy()
    column = np.array([place[s] for s in rows["source"].to_pylist()], np.int64)
    sums = np.zeros((len(sources), len(sources)), np.int64)
    own: list[list[tuple[int, bytes, str]]] = [[] for _ in sources]
    step = max(1, CELLS // max(1, len(sources)))
    order = np.argsort(code, kind="stable")
    code, count, column = code[order], count[order], column[order]
    for low in range(0, len(names), step):
        a, b = np.searchsorted(code, [low, low + step])
        cells = np.zeros((min(step, len(names) - low), len(sources)), np.int64)
        cells[code[a:b] - low, column[a:b]] = count[a:b]
        p, q = _share(cells + SMOOTH, sizes), _share(cells.sum(1) + SMOOTH, whole)
        for i in range(len(sources) - 1):
            sums[i, i + 1:] += np.abs(p[:, i + 1:] - p[:, i:i + 1]).sum(0)
        for i in range(len(sources)):
            more = np.flatnonzero((cells[:, i] > 0) & (p[:, i] > q))
            value = p[more, i] - q[more]
            if len(more) > TOP:  # all that could be among the first, ties included
                near = value >= np.partition(value, len(value) - TOP)[len(value) - TOP]
                more, value = more[near], value[near]
            found = own[i] + [(-int(x), names[low + k].encode(), names[low + k]) for k, x in zip(more.tolist(), value.tolist(), strict=True)]
            own[i] = sorted(found)[:TOP]
    sums += sums.T
    n = len(sources)
    left, right = np.nonzero(~np.eye(n, dtype=bool))
    part = ["pair"] * len(left) + ["term"] * sum(map(len, own))
    source = [sources[i] for i in left] + [s for s, found in zip(sources, own, strict=True) for _ in found]
    item = [sources[i] for i in right] + [name for found in own for _, _, name in found]
    value = sums[left, right].tolist() + [-x for found in own for x, _, _ in found]
    return pa.table({"lang": pa.repeat(lang, len(part)), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def source_divergences(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language of ``docs(text, lang, source, ...)`` differ.

    Null texts, langs and sources count as ''. A language keeps the V terms that occur in ``least_documents`` of its rows at
    least (repeated rows count each). The share of a term in a group of N occurrences of kept terms is
    p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), in whole numbers throughout.

    Part ``pair``: for every other source of the language, the sum over kept terms of what the shares differ by; 0 if no
    term is kept. Part ``term``: the ``top`` (50 at most) terms by which the source's share exceeds the language's. Ranks are from 1
    by value descending, then item in the order of UTF-8. A source that is the only one has no pair; other columns are ignored;
    an empty table gives no row.

    Terms are counted by Arrow within each task, so a hot source costs a row per term and task; all counts of one term and
    language are as many as there are sources. Shards of the kept terms are then worked on side by side.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    partial = named.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    counts = partial.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("lead", F.min("source").over(of_term) == F.col("source"))
    kept = written(kept.where(F.col("in_docs") >= least_documents).select(*_KEYS, "n", "lead"))

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.where("lead").groupBy("lang").agg(F.count("*").alias("v"))
    zero = F.lit(0).cast("long")
    groups = (named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
              .select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v")))
    shards = max(1, -(-kept.count() // SHARD_ROWS))
    left = kept.select(*_KEYS, "n", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"))
    right = groups.withColumn("shard", F.explode(F.sequence(zero, F.lit(shards - 1).cast("long"))))
    found = (left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard"))
             .applyInArrow(_shard, "lang string, source string, part string, item string, value long"))
    # A term is in one shard only, so its sum is the value itself.
    value = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = value.withColumn("rank", F.row_number().over(ranked))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= min(top, TOP))).select("lang", "source", "part", "item", "value", "rank")
