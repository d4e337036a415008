"""TF-IDF, gradient steps and batch models against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest

from textloom.operators import bag as B
from textloom.operators.batch_model import score_batches

ROWS = [(1, ["a", "b", "a"], 1, 0), (2, ["b"], 0, 0), (3, ["a", "c"], 1, 1), (4, [], 0, 1), (5, None, 1, 0)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "k int, tokens array<string>, y int, z int")


def test_tfidf_is_exact(table):
    bags = B.bag(table, "k")
    idf = {r.token: (r.in_rows, r.idf) for r in B.inverse_frequencies(bags, 5).collect()}
    assert idf == {t: (n, pytest.approx(math.log(6 / (n + 1)))) for t, n in (("a", 2), ("b", 2), ("c", 1))}
    got = {(r.k, r.token): (r.n, r.weight) for r in B.tfidf(bags, B.inverse_frequencies(bags, 5, 2), "k").collect()}
    assert got == {key: (n, pytest.approx(n * math.log(2))) for key, n in {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1, (3, "a"): 1}.items()}


def test_gradient_steps_match_numpy(spark, table):
    bags = B.bag(table, "k").withColumnRenamed("n", "x")
    weights = B.fit_gradient(bags, table, "k", "x", ["y", "z"], 4, rate=0.3, reg=0.1, pos_weight=2.0)
    got = {r.token: (r.w_y, r.w_z) for r in weights.collect()}
    names = ["a", "b", "c", ""]
    x = np.array([[(t or []).count(n) for n in names[:3]] + [1] for _, t, _, _ in ROWS], float)
    logits = {}
    for column, label in enumerate(("y", "z")):
        y, w = np.array([r[2 + column] for r in ROWS], float), np.zeros(4)
        for _ in range(4):
            r = (1 / (1 + np.exp(-x @ w)) - y) * np.where(y == 1, 2.0, 1.0) / 5
            w = w - 0.3 * (x.T @ r + np.array([0.1, 0.1, 0.1, 0.0]) * w)
        assert [got[n][column] for n in names] == pytest.approx(w)
        logits[label] = x @ w
    scored = {r.k: (r.z_y, r.z_z) for r in B.score_weights(bags, table, "k", "x", weights, ["y", "z"]).collect()}
    assert all(scored[row[0]] == pytest.approx((logits["y"][i], logits["z"][i])) for i, row in enumerate(ROWS))


def test_model_is_made_once_a_worker_and_called_on_batches(spark):
    df = spark.range(1000).selectExpr("id", "array(id, id + 1) as a", "array(id * 2) as b").repartition(2)

    def factory():
        made = [0]

        def model(a, b):
            made[0] += 1
            assert a.shape[1] == 2 and b.shape[1] == 1 and len(a) <= 100
            return np.stack([a.sum(axis=1) + b[:, 0], np.full(len(a), made[0])], axis=1)

        return model

    got = score_batches(df, ["id"], {"a": 2, "b": 1}, factory, ["s", "calls"], batch_size=100).collect()
    assert len(got) == 1000 and all(r.s == 4 * r.id + 1 for r in got) and max(r.calls for r in got) >= 5
    with pytest.raises(Exception, match="has not 3 elements"):
        score_batches(df, ["id"], {"a": 3}, factory, ["s"]).collect()
    with pytest.raises(Exception, match="shape"):
        score_batches(df, ["id"], {"a": 2, "b": 1}, lambda: lambda a, b: a, ["s"]).collect()
