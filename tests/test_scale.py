"""Steps whose cost must not grow faster than their input."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import bag, dictionary, embed, rank, subword, vocab
from textloom.operators.subword import Pieces


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_from_texts_that_are_split_once(spark):
    docs = spark.createDataFrame([(1, "Café au lait"), (2, ""), (3, None), (4, "au [UNK] x")], "doc_id long, text string")
    freq = vocab.token_frequencies(subword.basic_tokenize(docs, "text", "tokens"))
    plan = _plan(freq)
    assert plan.count("ArrowEvalPython") == 1 and "size(" not in plan
    assert {tuple(r) for r in freq.collect()} == {("cafe", 1), ("au", 2), ("lait", 1), ("[UNK]", 1), ("x", 1)}


def test_elements_keep_nulls_and_skip_empty_arrays(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None), (1, ["a"])], "k int, t array<string>")
    assert sorted(map(str, (tuple(r) for r in dictionary.elements(df, "t", "x", "k").collect()))) == ["(1, 'a')", "(1, 'a')", "(1, None)"]


def test_tasks_work_on_bounded_slices():
    sizes = [0, 3, 9, 0, 1, 1, 4, 0]
    rows = pa.RecordBatch.from_arrays([pa.array([list(range(n)) for n in sizes], pa.list_(pa.int64()))], ["a"])
    parts = list(dictionary.in_parts(rows, 0, 5))
    assert [x for p in parts for x in p.column(0).to_pylist()] == rows.column(0).to_pylist()
    assert all(p.num_rows == 1 or len(p.column(0).flatten()) <= 5 for p in parts) and len(parts) == 4


def test_pieces_are_remembered_as_numbers():
    table = Pieces(["ab", "##c", "a"])
    assert table.of("abc") == ["ab", "##c"] and table.of("zz") == ["[UNK]"] and table.of("") == []
    assert isinstance(table.known["abc"], bytes) and len(table.known["abc"]) == 8


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_pooling_joins_only_ids_that_do_not_fit(spark, most):
    vectors = spark.createDataFrame([(0, [0.5, 1.0]), (1, [1.0, 2.0]), (7, [3.0, -1.0])], "id long, vec array<float>")
    df = spark.createDataFrame([(1, [1, 7, 7, 0], 3), (1, [0, 0, 0, 0], 0), (1, [1, 7, 7, 0], 3), (None, [9, 0, 0, 0], 1)], "k int, ids array<long>, n int")
    got = sorted((str(r.k), list(r.pooled)) for r in embed.mean_pool(df, "k", "ids", "n", vectors, 4, 2, False, 0, most).collect())
    assert got == [("1", [0.5, 1.0]), ("1", [1.875, 0.25]), ("1", [1.875, 0.25]), ("None", [0.375, 0.75])]  # equal keys stay apart


def test_a_step_shuffles_no_features(spark):
    df = spark.createDataFrame([(i, [f"w{j}" for j in range(i % 7)], i % 2) for i in range(50)], "k long, tokens array<string>, y int")
    bags = bag.bag(df, "k")
    assert _plan(bags).count("Exchange hashpartitioning") == 1
    from pyspark.sql.classic.dataframe import DataFrame

    seen, checkpoint = [], DataFrame.checkpoint

    def noted(frame, *args, **kwargs):
        seen.append(_plan(frame))
        return checkpoint(frame, *args, **kwargs)

    DataFrame.checkpoint = noted
    try:
        weights = bag.fit_gradient(bags.withColumn("x", F.lit(1.0)), df, "k", "x", ["y"], 2)
    finally:
        DataFrame.checkpoint = checkpoint
    assert weights.count() == 7 and all("BroadcastHashJoin" in p for p in seen[-2:])


def test_one_bucket_still_joins_by_key(spark):
    got = rank.exact_rank(rank.with_quantile_bucket(spark.range(5), "id", "b", 1)[0], F.col("b"), ["id"])
    assert "NestedLoop" not in _plan(got) and "Cartesian" not in _plan(got)
    assert sorted(r["rank"] for r in got.collect()) == [1, 2, 3, 4, 5]
