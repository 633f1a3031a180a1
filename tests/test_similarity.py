import random

import pytest
from pyspark.sql import functions as F

from structnet.operators import similarity


def kmers(s, k):
    return {s[i:i + k] for i in range(len(s) - k + 1) if "X" not in s[i:i + k]}


def brute(queries, targets, k, share):
    out = {}
    for q, s in queries:
        own = kmers(s, k)
        best = [(-len(own & kmers(t, k)), i) for i, t in targets
                if own and len(own & kmers(t, k)) / len(own) >= share and own & kmers(t, k)]
        if best:
            out[q] = (min(best)[1], -min(best)[0])
    return out


@pytest.mark.parametrize("share", [0.05, 0.3, 0.6, 1.0])
def test_against_brute_force(spark, share):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACDEX" if rng.random() < 0.1 else "ACDE") for _ in range(n))
    base = [word(60) for _ in range(6)]
    common = word(25)  # grams that half of the targets share
    targets = [(f"T{i:02d}", base[i % 6][i:40 + i] + (common if i % 2 else "") + word(5)) for i in range(30)]
    targets += [("T99", targets[0][1]), ("T00b", targets[3][1])]
    queries = [(i, base[i % 6][5:35]) for i in range(8)] + [(50 + i, word(20)) for i in range(5)]
    queries += [(90, common), (91, "AC"), (92, ""), (93, base[0][5:35]), (94, "XXXXXXXX")]
    q = spark.createDataFrame(queries, "q int, s string")
    t = spark.createDataFrame(targets, "t string, s string")
    got = similarity.best_matches(q, t, "q", "t", "s", lambda c: similarity.residue_kmers(c, 3), share)
    assert {r.q: (r.hit_id, r.shared) for r in got.collect()} == brute(queries, targets, 3, share)


def test_grams(spark):
    row = spark.createDataFrame([("ABCDABCX", " One two\nthree  FOUR five")], "a string, b string").select(
        similarity.residue_kmers(F.col("a"), 3).alias("k"), similarity.word_shingles(F.col("b"), 3).alias("w"),
        similarity.residue_kmers(F.lit("AB"), 3).alias("short")).first()
    assert row.k == ["ABC", "BCD", "CDA", "DAB"]
    assert row.w == ["one two three", "two three four", "three four five"]
    assert row.short == []
