import os

import numpy as np
import pytest

import voltlane.llm.quality_classifier as m

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_held_out_accuracy(spark):
    scored = m.op5_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = scored[scored.quality == 1].score.to_numpy(), scored[scored.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean() > 0.95
    assert (scored[scored.quality == 1].predicted == 1).mean() > 0.97


def test_votes_are_exact_neighbours():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, m.TOPICS)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    labels = rng.integers(0, 2, 300)
    model = m.Classifier(0.6, np.eye(m.TERMS, m.TOPICS, dtype=np.float32), vectors, labels, np.array([0.4, 0.6]))
    block = np.abs(rng.normal(size=(40, m.TERMS))).astype(np.float32)
    for row, score in zip(block[:, : m.TOPICS], model.score(block), strict=True):
        cosines = vectors.astype(np.float64) @ (row / np.linalg.norm(row))
        near = np.argsort(-cosines)[: m.NEIGHBOURS]
        weight = np.maximum(cosines[near], 0) ** m.POWER * model.class_weight[labels[near]]
        assert abs(score - (weight * labels[near]).sum() / weight.sum()) < 1e-4


def test_odd_texts_and_labels(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b a", "x"), (3, "a b a", "x"), (4, " \n", "x"), (5, "W!! " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (5, None), (9, 1)], "doc_id long, quality int")
    scored, name = m.classify(df, m.learn(df, labels))
    got = {r.doc_id: r[name] for r in scored.collect()}
    assert name == "score_" and scored.count() == 6
    assert got[1] == got[2] == got[4] == 0.75 and all(0 <= s <= 1 for s in got.values()) and got[3] < 0.5 < got[5]
    assert m.classify(df.limit(0), m.learn(df, labels.limit(0)))[0].count() == 0
    assert {r[name] for r in m.classify(df, m.learn(df, labels.limit(0)))[0].collect()} == {0.5}
