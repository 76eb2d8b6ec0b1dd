"""The line field against enumeration of all labellings, its gradient against differences, held-out accuracy and corner cases."""

import itertools

import numpy as np
import pytest

from swipesight.llm import queries, quality_crf

MID = "/root/testdata/sf0.01"


def enumerate_chain(x, theta, label):
    w, trans, start = quality_crf._unpack(theta)
    n = len(x)
    scores = {}
    for ys in itertools.product((0, 1), repeat=n):
        s = start[ys[0]] + sum(x[t] @ w for t in range(n) if ys[t] == 1) + sum(trans[ys[t - 1], ys[t]] for t in range(1, n))
        scores[ys] = s
    log_z = np.log(sum(np.exp(v) for v in scores.values()))
    marg = [sum(np.exp(v - log_z) for ys, v in scores.items() if ys[t] == 1) for t in range(n)]
    return np.array(marg), log_z - scores[(label,) * n]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_forward_backward_equals_enumeration(n):
    rng = np.random.default_rng(n)
    x = quality_crf._inputs(rng.random((n, quality_crf.OWN)))
    theta = rng.normal(size=quality_crf.FEATURES + 6)
    marg, loss = enumerate_chain(x, theta, 1)
    assert np.allclose(quality_crf.chain(x, theta), marg)
    got_loss, grad = quality_crf.chain(x, theta, 1)
    assert np.isclose(got_loss, loss)
    for i in rng.choice(len(theta), 8, replace=False):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        numeric = (quality_crf.chain(x, theta + step, 1)[0] - quality_crf.chain(x, theta - step, 1)[0]) / 2e-6
        assert np.isclose(grad[i], numeric, atol=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    got = queries.op11_quality_crf(spark, MID).join(labels, "doc_id").where("held_out").toPandas()
    accuracy = ((got.score >= 0.7) == (got.quality == 1)).mean()
    assert accuracy >= 0.9 and accuracy > (got.quality == 1).mean() + 0.05
    assert ((got.predicted == 1) == (got.score >= 0.7)).all()


def test_corner_cases(spark):
    theta = np.random.default_rng(0).normal(size=quality_crf.FEATURES + 6) * 0.1
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "Good line.\n" * 5000), (4, "Good line.\n" * 5000), (None, "x!! $$$")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS own", "2 AS score", "3 AS held_out")
    got = {(r.doc_id, r.n_lines): r for r in quality_crf.score(docs, theta, "doc_id = 2").collect()}
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got.values())
    assert got[(1, 1)].score == got[(2, 1)].score and got[(2, 1)].held_out and not got[(1, 1)].held_out
    assert got[(4, 5001)].predicted in (0, 1)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_crf.score(empty, theta, "true").count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert not quality_crf.fit(docs.select("doc_id", "text"), no_labels, "true", steps=2).any()
