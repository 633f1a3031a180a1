import math
import random

import pytest

import workload
from structnet.operators import search
from structnet.operators.search import Scoring

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def stretch(scoring, q, t, d):
    best = run = 0
    for i, a in enumerate(q):
        if 0 <= i + d < len(t):
            b = t[i + d]
            known = a in scoring.letters and b in scoring.letters
            run = max(0, run + (scoring.table[scoring.letters.index(a)][scoring.letters.index(b)] if known else scoring.unknown))
            best = max(best, run)
    return best


def brute(queries, targets, scoring, k=5, min_seeds=2, min_letters=3, expect=1e-5, best=8):
    targets = [(i, t) for i, t in targets if t is not None]
    residues = sum(len(t) for _, t in targets)
    firsts = {t: min(i for i, u in targets if u == t) for _, t in targets}
    ok = lambda m: "X" not in m and len(set(m)) >= min_letters
    out = set()
    for i, q in queries:
        found = []
        for t, target in firsts.items():
            seeds = [y - x for x in range(len(q or "") - k + 1) for y in range(len(t) - k + 1) if q[x:x + k] == t[y:y + k] and ok(q[x:x + k])]
            diagonals = [d for d in set(seeds) if seeds.count(d) >= min_seeds]
            if diagonals:
                score = max(stretch(scoring, q, t, d) for d in diagonals)
                if scoring.scale * len(q) * residues * math.exp(-scoring.decay * score) <= expect:
                    found.append((-score, target))
        out |= {(i, target, r + 1, -s) for r, (s, target) in enumerate(sorted(found)[:best])}
    return out


def relatives(r):
    """Sequences with substitutions, insertions, deletions, unknown letters and runs of one letter."""
    word = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    base = [word(70) for _ in range(5)]
    targets = []
    for i in range(40):
        s = list(base[i % 5])
        for _ in range(i // 3):
            at = r.randrange(len(s))
            s[at:at + r.randrange(2)] = [r.choice(LETTERS + "X") for _ in range(r.randrange(3))]
        targets.append((f"T{i:02}", "".join(s)[i % 7:]))
    targets += [("T99", targets[0][1]), ("A00", targets[3][1]), ("N", None), ("E", ""), ("P", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"), ("M", "ACACACACACACACACACACACACACAC"), ("L", word(300) + base[2] + word(300)), ("S", "ACD")]
    queries = [(i, base[i % 5][i:i + 50]) for i in range(10)] + [(20, None), (21, ""), (22, "ACDEF"), (23, "A" * 40), (24, "AC" * 20), (25, word(60)), (26, base[0][:50]), (27, base[1][:30] + "XXXX" + base[2][20:])]
    return queries, targets


@pytest.mark.parametrize("more", [{}, {"k": 3, "min_seeds": 1, "expect": 1.0, "best": 3}, {"min_letters": 1, "expect": 1e6, "best": 100}])
def test_against_brute_force(spark, more):
    queries, targets = relatives(random.Random(4))
    scoring = Scoring.of_groups()
    q = spark.createDataFrame(queries, "q int, sequence string").repartition(3)
    t = spark.createDataFrame(targets, "t string, sequence string").repartition(3)
    hits = search.scored_hits(q, t, "q", "t", **more)
    got = {tuple(r) for r in hits.collect()}
    assert got == brute(queries, targets, scoring, **more) and len(got) > 20
    firsts = {r.q: r.hit_id for r in search.first_hits(hits, "q").collect()}
    assert firsts == {i: t for i, t, rank, _ in got if rank == 1} and firsts[0] == firsts[26]


def test_table_text_and_decay():
    text = "# a table\n   A  C  D *\nA  4 -1 -2 -4\nC -1  9 -3 -4\nD -2 -3  6 -4\n* -4 -4 -4 1\n"
    scoring = Scoring.from_text(text, frequencies=(0.6, 0.1, 0.3))
    assert scoring.letters == "ACD" and scoring.table[1] == (-1, 9, -3)
    with pytest.raises(ValueError):
        scoring.decay  # unrelated letters score above 0 at these frequencies
    groups = Scoring.of_groups()
    total = sum(math.exp(groups.decay * s) for row in groups.table for s in row) / 400
    assert abs(total - 1) < 1e-9 and groups.expected(80, 30, 10**6) < 1e-5 < groups.expected(40, 30, 10**6)


def test_nothing_to_search(spark):
    some = spark.createDataFrame([("T", "ACDEFGHIKL" * 4)], "t string, sequence string")
    none = spark.createDataFrame([], "q int, sequence string")
    assert search.scored_hits(none, some, "q", "t").collect() == []
    assert search.scored_hits(spark.createDataFrame([(1, "ACDEFGHIKL" * 4)], "q int, sequence string"), some.limit(0), "q", "t").collect() == []


def test_seeds_seen_ahead_are_all_of_them(spark):
    """Lengths around the words' reach, seeds far apart, letters beyond the alphabet: the same hits as letter by letter."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    a, b = word(8), word(8)
    targets = [(f"T{i:03}", a + word(gap) + b + word(end)) for i, (gap, end) in enumerate((g, e) for g in (0, 1, 40, 47, 48, 49, 50, 60, 90) for e in (0, 1, 30))]
    queries = [(i, a + word(gap) + b + word(20 * (i % 2))) for i, gap in enumerate([0, 1, 40, 47, 48, 49, 50, 60, 90] * 2)] + [(30, a[:5] + "é" + b[:4] + "ÿ" * 3), (31, a + "x" * 40 + b), (32, a[:5])]
    more = {"expect": 1e6, "best": 1000}
    q, t = spark.createDataFrame(queries, "q int, sequence string"), spark.createDataFrame(targets, "t string, sequence string")
    got = {tuple(x) for x in search.scored_hits(q, t, "q", "t", **more).collect()}
    assert got == brute(queries, targets, Scoring.of_groups(), **more) and len(got) > 100


def test_seeds_that_meet_by_chance_go_no_further(spark):
    """Sequences with one seed in common each: none of the meetings is shuffled."""
    r = random.Random(3)
    sides = [(c, [(i, "".join(r.choice(some) for _ in range(12)) + "MKVLW" + "".join(r.choice(some) for _ in range(12))) for i in range(300)], end)
             for c, some, end in (("query", "ACDEF", 31), ("target", "GHINP", 30))]
    q, t = (search._seeds(spark.createDataFrame(rows, f"{c} long, sequence string"), c, 5, 3, c[0], end) for c, rows, end in sides)
    met = q.join(t.drop("t_ok"), "seed")
    assert met.count() == 90_000 and met.where(search._met_ahead(5) >= 2).count() == 0


@pytest.mark.parametrize("lengths", [(24, 36), (40, 63), (60, 68)])
def test_unlikely_diagonals_go_no_further(spark, lengths):
    """Pairs with two seeds in common and nothing else are not shuffled if no stretch of theirs can be a hit; the hits are the same as letter by letter."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    base = [word(r.randint(*lengths)) for _ in range(12)]
    changed = lambda s, n: "".join(r.choice(LETTERS) if r.random() < n else c for c in s)
    planted = lambda n: word(r.randrange(n - 6)) + "MKVLWR" + word(n)
    queries = [(i, changed(base[i % 12][i % 5:], 0.05 * (i % 6))) for i in range(60)] + [(100 + i, planted(12)) for i in range(60)]
    targets = [(f"T{i:03}", changed(base[i % 12], 0.06 * (i % 7))) for i in range(60)] + [(f"U{i:03}", planted(12)) for i in range(60)]
    scoring = Scoring.of_groups()
    q, t = spark.createDataFrame(queries, "q int, sequence string"), spark.createDataFrame(targets, "t string, sequence string")
    for expect in (1e-5, 1e-2, 1.0):
        got = {tuple(x) for x in search.scored_hits(q, t, "q", "t", expect=expect, best=100).collect()}
        assert got == brute(queries, targets, scoring, expect=expect, best=100) and len(got) > 30
    some = [search._seeds(spark.createDataFrame([x for x in rows if len(x[1]) < 32 and "MKVLWR" in x[1]], f"{c} {kind}, sequence string"), c, 5, 3, c[0], end)
            for c, kind, rows, end in (("query", "int", queries, 31), ("target", "string", targets, 30))]
    met = some[0].join(some[1], "seed").where(search._met_ahead(5) >= 2)
    chance = lambda n, score: 0.1 * n * 10**4 * search.F.exp(-scoring.decay * score)
    assert met.count() >= 1000 and search._likely(met, scoring, chance, 1e-5).count() < met.count() / 20


@pytest.mark.parametrize("name", ["search_hits", "annotate_by_search"])
def test_sequences_are_gathered_once(spark, name, monkeypatch):
    """Both tables of sequences come from one spread of the line items, and none is gathered where it is read."""
    plans = []

    def stage(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    real = workload.stage
    monkeypatch.setattr(workload, "stage", stage)
    monkeypatch.setattr(search, "stage", stage)
    workload.queries()[name](spark, "/root/testdata/sf0.001")
    gathered = [p for p in plans if "partial_collect_list(struct(l_orderkey" in p]
    assert len(gathered) == 1
    lines = gathered[0].splitlines()
    at = next(i for i, x in enumerate(lines) if "partial_collect_list(struct(l_orderkey" in x)
    assert any("Exchange hashpartitioning(l_partkey" in x for x in lines[at:]) and not any("Exchange" in x for x in lines[:at])
