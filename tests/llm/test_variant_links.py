"""The near-dedup stage of the pipeline links by deletion-variant signatures too."""

import random

import edge

import corpus_pipeline
from structnet.llm import simhash_dedup


def test_stage_links_by_deletion_variants(spark):
    """Texts whose repeats decide the fingerprint, with few shingles in common: linked by the signatures alone, and on to what is similar to one of them."""
    r = random.Random(6)
    own = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    tail, last = own(60), own(60)
    rows = [(1, "a b c " * 400 + own(60)), (2, "a b c " * 400 + tail), (3, "a b c " * 100 + tail + " end"), (4, last), (5, own(60))]
    fps = [simhash_dedup.fingerprint(t) for _, t in rows]
    assert bin(fps[0] ^ fps[1]).count("1") <= 2
    docs = edge.documents(spark, rows)
    groups = {radius: {x["doc_id"]: x["group"] for x in simhash_dedup.near_duplicates(docs, radius=radius).collect()} for radius in (None, 2)}
    assert len(set(groups[None].values())) == 4 and groups[None][2] == groups[None][3]
    assert len(set(groups[2].values())) == 3 and groups[2][1] == groups[2][2] == groups[2][3]
    assert sorted(x["doc_id"] for x in corpus_pipeline.distinct_contents(spark, docs, "").collect()) == [1, 4, 5]


def test_stage_keeps_every_link_of_op7(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    group = {x["doc_id"]: x["group"] for x in simhash_dedup.near_duplicates(docs, radius=2).collect()}
    op7 = simhash_dedup.near_groups(docs).collect()
    assert all(group[x["doc_id"]] == group[x["component_id"]] for x in op7) and len({x["component_id"] for x in op7}) < len(op7)
