"""Exact dedup, SimHash groups, near duplicates and line classes against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import edge
import numpy as np
import pytest
import xxhash

from structnet.llm import components, exact_dedup, line_dedup, simhash_dedup
from structnet.llm.common import only

SF = "/root/testdata/sf0.001"


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(params=["edge", "sf", "empty"])
def docs(request, spark):
    if request.param == "sf":
        return spark.read.parquet(f"{SF}/documents.parquet")
    return edge.documents(spark, None if request.param == "edge" else [])


def test_fingerprints_combine():
    r = random.Random(1)
    data = r.randbytes(3 * exact_dedup.CHUNK + 77)
    for p, base in exact_dedup.MODULI:
        expected = 0
        for x in data[:50_000]:
            expected = (expected * base + x) % p
        assert expected in exact_dedup.fingerprint(data[:50_000])
    for cut in (0, 1, 500, exact_dedup.CHUNK, len(data)):
        parts = exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:])
        assert exact_dedup.combine(*parts) == exact_dedup.fingerprint(data)


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t.encode().translate(None, b" \t\n\r\x0b\x0c")].append((i, t))
    return groups


def test_exact_groups(docs):
    groups = exact_brute(rows_of(docs))
    got = exact_dedup.exact_groups(docs).collect()
    expected = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        expected.update((i, best, len(members), hashlib.sha256(norm).hexdigest()) for i, _ in members)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert only(docs, exact_dedup.exact_groups(docs).where("kept")).count() == len(groups)


def test_shared_fingerprint_is_found(spark, monkeypatch):
    """With fingerprints that say nothing, the comparison of chunks has to tell texts apart."""
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda data: (0, 0, 0))
    docs = edge.documents(spark, [(1, "ab"), (2, "a b"), (3, "cd"), (4, "ef" * 40_000)])
    same = spark.createDataFrame([(0, 0, 0)], "h1 long, h2 long, n long")
    monkeypatch.setattr(exact_dedup, "map_rows", lambda df, f, columns, ddl, arrow, size=0: df.sparkSession.createDataFrame(list(f(map(tuple, df.select(*columns).collect()))), ddl))
    assert exact_dedup._differing(exact_dedup.texts(docs), same).count() == 1
    assert sorted((r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_groups(docs).collect()) == [(1, 2), (2, 2), (3, 3), (4, 4)]


def brute_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_groups(docs):
    rows = [(i, t if len(t) < 100_000 else t) for i, t in rows_of(docs)]
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    part = edge.brute_components({f for _, f in fps}, [(a, b) for a, b in combinations({f for _, f in fps}, 2) if (a ^ b).bit_count() <= 2])
    low = {}
    for i, f in fps:
        low[part[f]] = min((x for x in (low.get(part[f]), i) if x is not None), default=None)
    got = simhash_dedup.near_groups(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter((i, f, low[part[f]]) for i, f in fps)


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_links_of_crowded_fingerprints(spark, monkeypatch, bucket):
    """Random walks by one to three bits, so that buckets are large and chains long."""
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    r = random.Random(bucket)
    fps = [0, (1 << 64) - 1]
    while len(fps) < 700:
        x = r.choice(fps[-40:] + [r.getrandbits(64)])
        for _ in range(r.choice((1, 2, 2, 3, 3))):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    to_signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = {to_signed(x) for x in fps}
    edges = simhash_dedup.near_links(spark.createDataFrame([(x,) for x in nodes], "fp long"))
    got = {x["node"]: x["component"] for x in components.components(edges).collect()}
    expected = edge.brute_components(nodes, [(a, b) for a, b in combinations(nodes, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    assert {n: got.get(n, n) for n in nodes} == expected


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, x) for x in range(2000, 2300)] + [(r.randrange(5000, 5400), r.randrange(5000, 5400)) for _ in range(200)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == edge.brute_components({n for a, b in edges if a != b for n in (a, b)}, edges)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = rows_of(docs)
    grams = {i: set(simhash_dedup.shingle_set(simhash_dedup.words_of(t)).tolist()) for i, t in rows}
    owners = defaultdict(set)
    for i, g in grams.items():
        for x in g or {-1}:
            owners[x].add(i)
    pairs = Counter(p for o in owners.values() if len(o) > 1 for p in combinations(sorted(o), 2))
    near = [(a, b) for (a, b), n in pairs.items() if n >= 0.8 * len(grams[a] | grams[b])]
    expected = edge.brute_components(grams, near)
    got = simhash_dedup.near_duplicates(docs).collect()
    by_group = defaultdict(set)
    for r in got:
        by_group[r["group"]].add(r["doc_id"])
    assert len(got) == len(rows) and all(len({expected[i] for i in g}) == 1 for g in by_group.values())
    kept, least = len(by_group), len(set(expected.values()))
    assert least <= kept <= least + 0.02 * (len(rows) - least) + 1


@pytest.mark.parametrize("edit", ["appended", "removed", "replaced"])
def test_near_duplicates_of_blocks(spark, edit):
    """Recall by band of similarity, where a block of words is new, gone or another one."""
    r = random.Random(edit)
    prose = lambda n: [f"w{int(r.paretovariate(0.6))}" for _ in range(n)]
    rows, bands = [], defaultdict(list)
    for k in range(400):
        n = r.randrange(150, 900)
        words, size = prose(n), int(n * r.uniform(0.02, 0.24))
        at = r.randrange(n - size)
        changed = {"appended": words + prose(size), "removed": words[:at] + words[at + size:], "replaced": words[:at] + prose(size // 2) + words[at + size // 2:]}[edit]
        a, b = (simhash_dedup.shingle_set([x.encode() for x in w]) for w in (words, changed))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
        j = simhash_dedup.jaccard(a, b)
        bands["below" if j < 0.8 else "0.80" if j < 0.85 else "0.85" if j < 0.9 else "0.90"].append(k)
    group = {x["doc_id"]: x["group"] for x in simhash_dedup.near_duplicates(edge.documents(spark, rows)).collect()}
    found = {band: sum(group[2 * k] == group[2 * k + 1] for k in own) for band, own in bands.items()}
    assert all(len(own) > 30 for band, own in bands.items() if band != "below") and not found.get("below")
    assert all(found[band] >= 0.99 * len(own) - (band == "0.80") for band, own in bands.items() if band != "below"), (found, {b: len(x) for b, x in bands.items()})


def test_near_duplicates_of_awkward_rows(spark):
    got = simhash_dedup.near_duplicates(edge.documents(spark)).collect()
    group = defaultdict(set)
    for r in got:
        group[r["group"]].add(r["doc_id"])
    assert len(got) == len(edge.texts())
    assert {1, 2, 3, None} in group.values() and {12, 13, 27} in group.values() and {4, 5} in group.values() and {6, 7, 9, -(1 << 63), (1 << 63) - 1} in group.values()
    assert simhash_dedup.near_duplicates(edge.documents(spark, [])).count() == 0


def test_crowd_of_near_duplicates(spark):
    """Copies of one text with changes of their own are one group, though few are near the smallest."""
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 150):
        own = list(words)
        own[r.randrange(200)] = f"x{i}"
        own[r.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(own)))
    got = simhash_dedup.near_duplicates(edge.documents(spark, rows)).collect()
    assert len({x["group"] for x in got}) == 1


@pytest.mark.parametrize("least", [0.8, 0.5, 0.95])
def test_similar_sets_share_a_prefix_key(least):
    """Every pair at the threshold or above shares a key, at sizes around class borders and with any order."""
    r = np.random.default_rng(8)
    cells = r.integers(0, 9, simhash_dedup.CELLS).astype(np.uint8)
    exact = Fraction(str(least))
    for _ in range(400):
        n = int(r.integers(1, 140))
        a = np.unique(r.integers(0, 1 << 32, n, np.uint64).astype(np.uint32))
        n, gone = len(a), int(r.integers(0, n // 4 + 2))
        kept = r.permutation(a)[: max(1, n - gone)]
        new = r.integers(0, 1 << 32, int(r.integers(0, n // 4 + 2)), np.uint64).astype(np.uint32)
        b = np.unique(np.concatenate([kept, new]))
        shared = len(np.intersect1d(a, b))
        keys = [{(int(k), int(s)): int(left) for k, s, left in zip(*simhash_dedup.prefix_keys(x, cells, least), strict=True)} for x in (a, b)]
        if Fraction(shared, len(a) + len(b) - shared) >= exact:
            met = [min(left, keys[1][k, 1 - s]) for (k, s), left in keys[0].items() if (k, 1 - s) in keys[1]]
            assert met and max(met) >= exact / (1 + exact) * (len(a) + len(b)), (n, len(b), shared)


def test_a_passage_makes_no_pairs(spark, monkeypatch):
    """Texts that share most of their words, but less than the threshold asks for, are compared a few times each."""
    compared = {}
    verified = simhash_dedup._verified

    def counting(pairs, sets, least):
        pairs = pairs.cache()
        compared[n] = compared.get(n, 0) + pairs.count()
        return verified(pairs, sets, least)

    monkeypatch.setattr(simhash_dedup, "_verified", counting)
    r = random.Random(2)
    passage = [f"p{i}" for i in range(330)]
    for n in (100, 200):
        rows = [(i, " ".join(passage + [f"w{r.randrange(10**9)}" for _ in range(70)])) for i in range(n)]
        rows += [(1000 + i, rows[i][1] + " one more") for i in range(0, n, 10)]
        group = defaultdict(set)
        for x in simhash_dedup.near_duplicates(edge.documents(spark, rows)).collect():
            group[x["group"]].add(x["doc_id"])
        assert sorted(map(len, group.values())) == [1] * (n - n // 10) + [2] * (n // 10)
    assert compared[200] <= 2.5 * compared[100] and compared[200] < 8 * 220, compared


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(4)
    for _ in range(4000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(14)))
        b = list(a)
        for _ in range(r.randrange(5)):
            k = r.randrange(len(b) + 1)
            b[k:k + r.randrange(2)] = r.choice(["", "a", "c"])
        for edits in (1, 2, 3):
            assert line_dedup.edit_distance(a, "".join(b), edits) == min(distance(a, "".join(b)), edits + 1)


def line_brute(rows):
    lines = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n")) if x]
    first, copies = {}, Counter(x for *_, x in lines)
    for i, k, x in sorted(lines, key=lambda y: (y[0] is None, y[0] or 0, y[1])):
        first.setdefault(x, (i, k))
    links = defaultdict(list)
    for a, b in combinations(sorted(first), 2):
        if abs(len(a) - len(b)) <= 2:
            d = line_dedup.edit_distance(a, b) if len(a) > 60 else distance(a, b)
            if d <= min(2, 0.2 * max(len(a), len(b))):
                links[a].append(d)
                links[b].append(d)
    return Counter((i, k, *first[x], copies[x], len(links[x]), min(links[x], default=None)) for i, k, x in lines)


def test_line_classes(docs):
    got = Counter(tuple(r) for r in line_dedup.line_classes(docs).collect())
    assert got == line_brute(rows_of(docs))


def test_line_links(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdefé ") for _ in range(n)) for n in (3, 4, 5, 6, 9, 12, 30, 31, 200) for _ in range(4)]
    lines = list(base)
    for x in base * 6:
        y = list(x)
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(y) + 1)
            y[k:k + r.randrange(2)] = r.choice(["", "z", "a"])
        lines.append("".join(y))
    rows = [(i, "\n".join(lines[i::7])) for i in range(7)]
    got = Counter(tuple(x) for x in line_dedup.line_classes(edge.documents(spark, rows)).collect())
    assert got == line_brute(rows) and any(x[5] for x in got)


@pytest.mark.parametrize("n", [0, 1, 4, 5, simhash_dedup.PART - 1, simhash_dedup.PART + 3, simhash_dedup.PART + 4, simhash_dedup.PART + 5, 3 * simhash_dedup.PART])
def test_shingles_in_parts(n):
    words = [b"%d" % (i % 977) for i in range(n)]
    whole = simhash_dedup.hashes(simhash_dedup.shingles(words, 5), 5)
    assert simhash_dedup.shingle_hashes(words, 5, 5).tolist() == whole.tolist()
