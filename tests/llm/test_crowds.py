"""What crowds of texts cost that are alike, but not as alike as the threshold asks."""

from __future__ import annotations

import random
from collections import defaultdict

import edge
import numpy as np

from structnet.llm import common, components, simhash_dedup


def test_parities_differ_by_no_more_than_the_sets():
    r = np.random.default_rng(3)
    for n in (0, 1, 40, 150, 3000):
        a = np.unique(r.integers(0, 1 << 32, n, np.uint32))
        b = np.unique(np.concatenate([a[n // 8:], r.integers(0, 1 << 32, n // 7, np.uint32)]))
        bits = sum(int(x ^ y).bit_count() for x, y in zip(simhash_dedup.parities(a).view("<u8"), simhash_dedup.parities(b).view("<u8"), strict=True))
        assert bits <= len(np.setxor1d(a, b)) and (n != 150 or bits > 0.8 * len(np.setxor1d(a, b)))


def test_edited_copies_below_the_threshold_make_no_pairs(spark, monkeypatch):
    """Copies of one text with seven other words each: 0.7 similar, so that all pairs share prefix keys. A few are as similar as the threshold asks."""
    compared = {}
    verified = simhash_dedup._verified

    def counting(pairs, sets, least):
        pairs = pairs.cache()
        compared[n] = compared.get(n, 0) + pairs.count()
        return verified(pairs, sets, least)

    monkeypatch.setattr(simhash_dedup, "_verified", counting)
    r = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    for n in (60, 120):
        rows = []
        for i in range(n):
            own = list(base)
            for k in r.sample(range(1, 78), 7):
                own[5 * k + 2] = f"w{r.randrange(10**9)}"
            rows.append((i, " ".join(own)))
        rows += [(1000 + i, rows[i][1] + " one more") for i in range(0, n, 10)]
        group = defaultdict(set)
        for x in simhash_dedup.near_duplicates(edge.documents(spark, rows)).collect():
            group[x["group"]].add(x["doc_id"])
        assert sorted(map(len, group.values())) == [1] * (n - n // 10) + [2] * (n // 10)
    assert compared[120] < 20 * 132, compared


def test_components_of_stars_need_no_round(spark, monkeypatch):
    rounds = []
    step = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or step(edges))
    stars = [(1, 5), (6, 1), (1, 7), (8, 2), (3, 3)]
    found = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert found == {1: 1, 5: 1, 6: 1, 7: 1, 2: 2, 8: 2} and not rounds
    path = [(i, i + 1) for i in range(40)]
    found = components.components(spark.createDataFrame(path, "a long, b long")).collect()
    assert sorted((x["node"], x["component"]) for x in found) == [(i, 0) for i in range(41)] and rounds


def test_small_written_tables_have_few_partitions(spark):
    rows = common.written_rows(spark.range(300).repartition(8))
    assert rows.rdd.getNumPartitions() == 1 and sorted(x["id"] for x in rows.collect()) == list(range(300))
    assert common.written_rows(spark.range(0)).count() == 0
    assert common.written_rows(spark.range(0, 3 * common.TASK_ROWS, 1, 8)).rdd.getNumPartitions() == 3
