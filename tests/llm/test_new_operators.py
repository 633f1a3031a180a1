"""Token files, hard negatives and source divergences; and every SQL counterpart of these operators."""

from __future__ import annotations

import collections
import glob
import io
import random
import re

import edge
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from oracle_check import compare, connect
from structnet.llm import divergence, hard_negatives, queries, token_files
from structnet.llm.tokens import vocabulary

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, connect(SMALL), name, SMALL) == ""


# --- token files ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary()[0])
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()


AWKWARD = ["a\x1c b", "a \x1cb", "x  y", "x  y", "don't  stop", " lead", "trail ", "\n\n a \n b", "a <|endoftext|> b", "tab\t tab", "é à  ß  ü", "''s 'S  's", "​ ​", "1 2  3   4", "日本 語 é e"]


def test_parts_have_the_ids_of_the_whole(encode, monkeypatch):
    monkeypatch.setattr(token_files, "PART", 3)
    r = random.Random(1)
    some = AWKWARD + ["".join(r.choice(" \n\t  \x1c'a1é.日") for _ in range(60)) for _ in range(300)]
    for text in some:
        assert b"".join(token_files.encoded(text, vocabulary()[0])) + bytes(4) == encode(text), text
    monkeypatch.setattr(token_files, "PART", 1 << 20)
    monkeypatch.setattr(token_files, "MEMO", 20)
    for text in some + some[:50]:
        assert b"".join(token_files.encoded(text, vocabulary()[0])) + bytes(4) == encode(text), text


def test_files_round_trip(spark, tmp_path, encode):
    rows = edge.texts() + [(i, "again") for i in range(100, 140)] + [(7, "same  text")] * 20
    docs, folder = edge.documents(spark, rows), str(tmp_path / "files")
    token_files.write_token_files(docs, folder, file_bytes=50_000)
    got = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == collections.Counter((i, encode(t)) for i, t in rows)
    ends = np.cumsum([r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == [0, *ends[:-1].tolist()] and all(4 * r["n_tokens"] == len(r["ids"]) for r in got)
    some = token_files.read_documents(spark, folder, [4, 9, 1000]).collect()
    assert sorted(r["doc_id"] for r in some) == [4, 9, 9] and {(r["doc_id"], r["start"]) for r in some} <= {(r["doc_id"], r["start"]) for r in got}
    whole = b""
    for name in sorted(glob.glob(f"{folder}/part-*")):  # any zstandard reader can unpack the files
        with open(name, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as unpacked:
            whole += unpacked.read()
    assert whole == b"".join(bytes(r["ids"]) for r in got)


def _file(texts, encode):
    frames = token_files._Frames()
    rows = [piece for i, t in enumerate(texts) for piece in frames.add(i, [encode(t)])]
    return b"".join(piece + token_files.SEPARATOR for piece in [*rows, *frames.close()])


def test_reader_unpacks_only_what_it_needs(encode, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 1000)
    texts = [f"text {i} " * (1 + i % 7) for i in range(400)] + ["long one " * 4000]
    content = _file(texts, encode)
    file = token_files.TokenFile(io.BytesIO(content))
    assert file.ids(200) == encode(texts[200]) and file.frames_read <= 2 < len(file.frames) and file.docs == list(range(401))
    assert file.ids(400) == encode(texts[400]) and all(f[3] == xxhash.xxh64_intdigest(file._frame(i)) & 0xFFFFFFFF for i, f in enumerate(file.frames))
    empty = token_files.TokenFile(io.BytesIO(_file([""], encode)))
    assert empty.ids(0) == bytes(4)


def test_damage_is_found(encode, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 1000)
    content = _file([f"text {i} " * 50 for i in range(60)], encode)
    file = token_files.TokenFile(io.BytesIO(content))
    at, packed, *_ = file.frames[3]
    hurt = bytearray(content)
    hurt[at + packed // 2] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenFile(io.BytesIO(bytes(hurt)))._frame(3)
    table = bytearray(content)
    table[content.rindex(file.frames[3][3].to_bytes(4, "little"))] ^= 1  # the checksum itself
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(bytes(table)))._frame(3)
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(content[:-1]))


def test_no_documents(spark, tmp_path):
    token_files.write_token_files(edge.documents(spark, []), str(tmp_path / "none"))
    assert token_files.read_documents(spark, str(tmp_path / "none")).collect() == []


# --- hard negatives ------------------------------------------------------------------------------------------------

def negatives_brute(rows, anchor, scale=256, n=5):
    rows = [(i, int(label), [int(np.floor(scale * float(x))) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for k, (i, label, v) in enumerate(rows):
        if not anchor(i):
            continue
        scored = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=False))), j, m, other) for m, (j, other, w) in enumerate(rows) if m != k)
        for score, j, _, _ in [x for x in scored if x[3] == label][:n]:
            found = [x for x in scored if x[3] != label and 80 * -score <= 100 * -x[0] <= 100 * -score][:n]
            out += [(i, j, r + 1, x[1], -score, -x[0]) for r, x in enumerate(found)]
    return sorted(out)


def vectors(r, n, dims=6, near=False):
    out = [(i, r.randrange(3), [r.choice([-0.5, 0.25, 0.5, 1.0]) if near else r.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    return out + [(None, 1, [1.0] * dims), (-20, None, [1.0] * dims), (-30, 1, None), (-40, 1, [1.0, None, 1.0]), (-50, 1, [float("nan"), 1.0]), (-60, 0, [float("inf")]),
                  (-70, 0, []), (-80, 1, [0.5, 0.5]), (-90, 1, [0.0] * dims), *[(30, 1, [1.0] * dims)] * 3, *[(40, 2, [0.5] * dims)] * 30]


@pytest.mark.parametrize(("near", "scale", "anchors"), [(False, 256, 4096), (True, 256, 4096), (True, 4, 7), (False, 1 << 40, 4096), (False, 1 << 22, 9)])
def test_negatives(spark, monkeypatch, near, scale, anchors):
    monkeypatch.setattr(hard_negatives, "PASS_ANCHORS", anchors)
    rows = vectors(random.Random(scale), 150, near=near)
    table = spark.createDataFrame([(*x, "z", "z", "z") for x in rows], "id long, label int, vector array<double>, row string, anchor string, rank string").repartition(5)
    got = hard_negatives.hard_negatives(table, F.col("id") % 10 == 0, scale)
    want = negatives_brute(rows, lambda i: i % 10 == 0, scale)
    assert sorted(map(tuple, got.collect())) == want and want


def test_fields_are_exact():
    r = np.random.default_rng(3)
    for low, high, dims in ((-3, 3, 1), (-256, 256, 64), (-1000, 5, 7), (-(1 << 24), 1 << 24, 16), (-(1 << 28), 1 << 28, 5), (0, 0, 4)):
        packing = hard_negatives.Packing.of(low, high, dims)
        a, v = r.integers(low, high + 1, (5, dims)), r.integers(low, high + 1, (71, dims))
        a[0], v[0], v[1] = low, low, high
        assert np.array_equal(packing.scores(a, v), a @ v.T)
    assert hard_negatives.Packing.of(-256, 256, 64).fields > 1


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, label int, vector array<float>")
    assert hard_negatives.hard_negatives(none, F.col("id") % 100 == 0).collect() == []


# --- source divergences --------------------------------------------------------------------------------------------

def divergence_brute(rows, least):
    lower = {i: i + 32 for i in range(65, 91)}
    counts, in_docs = collections.Counter(), collections.Counter()
    groups = sorted({(lang or "", source or "") for _, lang, source in rows})
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        counts.update((lang or "", source or "", t) for t in terms)
        in_docs.update((lang or "", t) for t in set(terms))
    out = []
    for lang in sorted({g[0] for g in groups}):
        kept = sorted(t for (l2, t), n in in_docs.items() if l2 == lang and n >= least)
        sources = [s for l2, s in groups if l2 == lang]
        share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
        n = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s, t], n[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s, t] for s in sources), sum(n.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            more = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            out += [(lang, s, part, item, -value, k + 1) for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:50])) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergences(spark, monkeypatch, small):
    if small:  # many parts, shards and blocks
        for name, value in (("PART_BYTES", 200), ("HELD_ROWS", 40), ("SHARD_ROWS", 50), ("CELLS", 20)):
            monkeypatch.setattr(divergence, name, value)
    r = random.Random(9)
    words = ["Straße", "STRASSE", "The", "of", "x1y", "naïve", "日本語", "É", "é", "a_b", "K", *(f"w{chr(97 + i)}" for i in range(26)), *(f"v{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))]
    rows = [(" ".join(r.choice(words) for _ in range(r.randrange(60))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "S3", "", None, "é"])) for _ in range(200)]
    rows += [(None, "en", "no text"), ("", "xx", "only"), ("!!! 123", "xx", "other"), ("same", None, None), *[("hot word", "hot", "one")] * 90, ("the " * 20_000, "en", "long")]
    docs = spark.createDataFrame([(*x, "z", "z") for x in rows], "text string, lang string, source string, n string, shard string").repartition(6)
    got = sorted(map(tuple, divergence.source_divergences(docs, 5).collect()))
    assert got == divergence_brute(rows, 5) and {x[2] for x in got} == {"pair", "term"}
    assert max(x[5] for x in got if x[2] == "term") == 50


def test_divergences_of_nothing(spark):
    assert divergence.source_divergences(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(300):
        total = r.randrange(1, 9 * 10**15)
        count = r.randrange(0, total + 1)
        assert int(divergence._share(np.array([count]), total)[0]) == 1 + 10**9 * count // total
