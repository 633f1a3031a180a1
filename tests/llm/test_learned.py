"""The quality classifier, and the pipeline."""

from __future__ import annotations

import zlib

import edge
import numpy as np

import corpus_pipeline
from structnet.llm import decontaminate, packing, quality, queries
from structnet.llm.common import read

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    label = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    got = queries.op10_quality(spark, SF).collect()
    assert len(got) == read(spark, SF, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    test = [(label[r["doc_id"]], r["score"]) for r in got if r["held_out"] and r["doc_id"] in label]
    good, bad = [s for y, s in test if y == 1], [s for y, s in test if y == 0]
    assert len(test) > 50 and np.mean([a > b for a in good for b in bad]) > 0.99
    assert np.mean([(s >= 0.3) == y for y, s in test]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.98


def test_held_out_labels_teach_nothing(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    odd = turned.union(spark.createDataFrame([(None, 1), (-5, 0), (3, None)], "doc_id long, quality int"))
    assert np.array_equal(quality.train(docs, labels), quality.train(docs, odd))


def test_quality_of_awkward_rows(spark):
    docs = edge.documents(spark)
    weights = quality.train(docs, spark.createDataFrame([(4, 1), (6, 0), (6, 1), (12, 1)], "doc_id long, quality int"))
    scores = quality.score_documents(docs, weights).collect()
    assert len(scores) == docs.count() and len({r["score"] for r in scores if r["doc_id"] in (1, 2, 3)}) == 1
    kept = quality.keep_good(docs, weights, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert not quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")).any()
    assert quality.score_documents(edge.documents(spark, []), weights).count() == 0


def test_stages_one_by_one(spark, tmp_path):
    docs = read(spark, SF, "documents")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns and docs.join(before, docs.columns).count() >= docs.count() > 0.5 * before.count()
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    label = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    first = {r["doc_id"] for r in read(spark, SF, "documents").collect()}
    assert np.mean([label[i] for i in first - seen[0] if i in label]) < 0.1
    text = {r["doc_id"]: r["text"] for r in read(spark, SF, "documents").collect()}
    norm = lambda i: "".join(text[i].split())
    assert len({norm(i) for i in seen[0]}) == len(seen[1]) == len({norm(i) for i in seen[1]})
    index = decontaminate.Index([(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()])
    assert seen[3] == {i for i in seen[2] if not index.search(text[i])} and seen[3] < seen[2]
    assert seen[4] == seen[3]
    assert sum(r["length"] for r in docs.collect()) == sum(r["doc_tokens"] for r in docs.where("start = 0").collect())
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["start"]) for r in got.collect() if r["start"] == 0) == sorted((i, 0) for i in seen[4])


def test_stages_on_awkward_rows(spark):
    for rows in (None, []):
        docs = edge.documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "packing" or out.columns == docs.columns
            n = out.count()
            assert (n == 0) if rows == [] else n > 0
    assert packing.WINDOW == 1024
