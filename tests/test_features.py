"""Classifier, features with a tokenizer, processors, strict lookups, ranks in two levels: small cases worked by hand."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import bayes, embed
from textloom.operators import features as X
from textloom.operators import history as H
from textloom.operators import metrics as M
from textloom.operators import profile as P
from textloom.operators import split as SP
from textloom.operators import subword as SW
from textloom.operators import vocab as V
from textloom.operators.rank import MAX_BUCKETS, ROWS_PER_BUCKET, bucket_count, exact_rank, with_quantile_bucket
from textloom.plans import feature_plans  # noqa: F401 - registers the processors
from textloom.sources import committed as C


def _train(spark):
    rows = [(1, ["a", "a", "b"], 1, 0), (2, ["b"], 0, 0), (3, [], 0, 0)]
    return spark.createDataFrame(rows, "k long, tokens array<string>, x int, y int")


def test_bayes_by_hand(spark, tmp_path):
    model = bayes.fit(_train(spark), "tokens", ["x", "y"], pos_weight=2.0)
    bayes.save(model, str(tmp_path / "m"))
    docs = spark.createDataFrame([(1, ["a", "b", "b", "new"]), (2, []), (3, None)], "k long, tokens array<string>")
    got = {(r["k"], r["label"]): r["logit"] for r in bayes.score(bayes.load(spark, str(tmp_path / "m")), docs, "k", "tokens", ["x", "y"]).collect()}
    # x: positive counts a 2, b 1, doubled, of 3; negative b 1, of 1; two tokens and one unseen
    a, b, new = (math.log((2 * p + 1) / (2 * 3 + 3)) - math.log((n + 1) / (1 + 3)) for p, n in ((2, 0), (1, 1), (0, 0)))
    prior = math.log(2 * 1 + 1) - math.log(2 + 1)
    assert got[1, "x"] == pytest.approx(prior + a + 2 * b + new)
    assert got[2, "x"] == got[3, "x"] == pytest.approx(prior)
    assert got[2, "y"] == pytest.approx(math.log(1) - math.log(4))  # a label without positives
    assert len(got) == 6


def test_bayes_without_rows(spark):
    empty = _train(spark).where("k < 0")
    priors, weights = bayes.fit(empty, "tokens", ["x"])
    assert weights.count() == 0 and priors.first()["prior"] == 0


def test_strict_lookup(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id long")
    good = spark.createDataFrame([(1, ["b", "a"]), (2, [])], "k int, tokens array<string>")
    assert {r["k"]: r["ids"] for r in V.strict_ids(good, vocab, "k").collect()} == {1: [1, 0], 2: []}
    assert V.unknown_tokens(good, vocab).count() == 0
    bad = spark.createDataFrame([(1, ["b", "z", "z"])], "k int, tokens array<string>")
    assert [tuple(r) for r in V.unknown_tokens(bad, vocab).collect()] == [("z", 2)]
    with pytest.raises(Exception, match="not in the vocabulary"):
        V.strict_ids(bad, vocab, "k").collect()


def test_processor_by_name():
    assert X.processor("COMMENTS") is X.processor("comments")
    assert set(X.processor("comments").parts) == {"train", "test"}
    with pytest.raises(ValueError, match="nothing"):
        X.processor("nothing")


def test_features_with_pieces(spark):
    entries = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##do", "it"]
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(entries)], "token string, id long")
    tokenizer = X.wordpiece_tokenizer(vocab, clean=True)
    df = spark.createDataFrame([(1, "Undo<br />it!", "it"), (2, None, None), (3, "qq", "")], "k long, a string, b string")
    one = {r["k"]: r for r in X.single_features(df, "k", "a", tokenizer, vocab, 6, [2], [3]).collect()}
    assert one[1]["input_ids"] == [2, 1, 3, 0, 0, 0]  # the break joins both words, and no piece ##it exists
    assert one[2]["input_ids"] == [2, 3, 0, 0, 0, 0] and one[2]["input_mask"] == [1, 1, 0, 0, 0, 0]
    assert one[3]["input_ids"] == [2, 1, 3, 0, 0, 0] and one[3]["segment_ids"] == [0] * 6
    two = {r["k"]: r for r in X.pair_features(df, ["k"], "a", "b", X.wordpiece_tokenizer(vocab), vocab, 9, 2, 3).collect()}
    assert two[2]["input_ids"] == [2, 3, 0, 0, 0, 0, 0, 0, 0]
    assert two[1]["segment_ids"][two[1]["length"] - 2 : two[1]["length"]] == [1, 1]


def test_case_is_kept_on_request(spark):
    df = spark.createDataFrame([(1, "Caf\u00e9 A")], "k int, t string")
    assert SW.basic_tokenize(df, "t", "o", do_lower_case=False).first()["o"] == ["Caf\u00e9", "A"]


def test_history_grows(spark, tmp_path):
    path = str(tmp_path / "h")
    part = lambda rows: spark.createDataFrame(rows, "run long, epoch long, metric double")
    assert H.read_history(spark, path).count() == 0
    assert H.append_history(part([(1, 0, 3.0)]), path, "first") and H.append_history(part([(1, 1, 2.0), (2, 0, 5.0)]), path, "second")
    assert not H.append_history(part([(1, 0, 3.0)]), path, "first")
    C.write_attempt(part([(1, 2, 1.0)]), path, "third")  # a writer that ends before its commit
    best = {r["run"]: (r["n_epochs"], r["best_epoch"]) for r in H.best_checkpoint(H.read_history(spark, path)).collect()}
    assert best == {1: (2, 1), 2: (1, 0)}
    assert H.append_history(part([(1, 2, 1.0)]), path, "third") and H.read_history(spark, path).count() == 4
    for attempt in [C.write_attempt(part([(3, 0, 1.0)]), path, "fourth") for _ in range(2)]:  # two writers at once
        C.commit(spark, path, "fourth", attempt)
    assert H.read_history(spark, path).count() == 5
    with pytest.raises(ValueError, match="name"):
        H.append_history(part([]), path, "a/b")


def test_best_checkpoints_have_versions(spark, tmp_path):
    path, part = str(tmp_path / "b"), lambda rows: spark.createDataFrame(rows, "run long, epoch long, metric double")
    assert H.read_best(spark, path).count() == 0
    assert H.save_best(part([(1, 0, 3.0), (1, 1, 3.0)]), path) == 1 and H.save_best(part([(1, 0, 3.0), (1, 2, 2.0)]), path) == 2
    C.write_attempt(part([(1, 9, 0.0)]), path, f"{3:012d}")  # a version that was never switched to
    assert [tuple(r) for r in H.read_best(spark, path).collect()] == [(1, 2, 2, 2.0)]
    assert [tuple(r) for r in H.read_best(spark, path, 1).collect()] == [(1, 2, 0, 3.0)]
    with pytest.raises(ValueError, match="no version 3"):
        H.read_best(spark, path, 3)


def test_value_counts_most_frequent_first(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (1, 1)], "x int, y int")
    assert [tuple(r) for r in P.value_counts(df, ["x", "y"]).collect()] == [("x", 1, 2), ("x", 0, 1), ("y", 1, 3)]


def test_describe_of_ties(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [0] * 7 + [1] * 3], "g string, v double")
    r = P.describe(df, "g", "v", quantiles=(0.5, 0.7, 0.75)).first()
    assert (r["q50"], r["q75"]) == (0.0, 0.75) and r["q70"] == pytest.approx(0.3)  # places 4.5, 6.75 and 6.3 of 0 to 9


def test_rank_in_two_levels(spark):
    df = spark.createDataFrame([((i * 37) % 500,) for i in range(500)], "v long")
    got = exact_rank(df, F.floor(F.col("v") / 5), ["v"], "r", coarse=F.floor(F.col("__bk") / 10)).collect()
    assert all(r["r"] == r["v"] + 1 for r in got) and len(got) == 500


@pytest.mark.parametrize("rows,world", [(10, 4), (8, 4), (3, 8), (1, 5), (0, 3)])
@pytest.mark.parametrize("seed", [None, 5])
def test_even_shards(spark, rows, world, seed):
    df = spark.createDataFrame([(i,) for i in range(rows)], "k long")
    got = SP.shard_assign(df, "k", world, seed, even=True)
    assert got.columns == ["k", "shard"]
    got = [(r["k"], r["shard"]) for r in got.collect()]
    full = -(-rows // world) * world
    assert [sum(s == i for _, s in got) for i in range(world)] == [full // world] * world
    times = [sum(k == i for k, _ in got) for i in range(rows)]
    assert sum(times) == full and max(times, default=0) - min(times, default=0) <= 1
    if seed is None:
        assert sorted(got) == sorted((p % rows, p % world) for p in range(full))


def test_histogram_is_the_same_by_both_joins(spark, monkeypatch):
    df = spark.createDataFrame([(g, float(i * i % 17)) for g in "abc" for i in range(40)] + [("d", 2.0)], "g string, v double")
    few = sorted(map(tuple, P.histogram(df, ["g"], "v", 5).collect()))
    monkeypatch.setattr(P, "RANGES_IN_TASKS", 1)
    assert sorted(map(tuple, P.histogram(df, ["g"], "v", 5).collect())) == few and len(few) == 20


def test_buckets_follow_the_rows():
    assert [bucket_count(n) for n in (0, 1, ROWS_PER_BUCKET + 1, 10**12)] == [1, 1, 2, MAX_BUCKETS]


@pytest.mark.parametrize("outliers", [[], ["", "zzz", "\U0001f600"], [None, "a"]])
def test_string_buckets_balance_behind_a_long_prefix(spark, outliers):
    keys = [f"https://example.org/page/{i:06d}" for i in range(20_000)] + outliers
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(4)
    d, n = with_quantile_bucket(df, "k", "b", 16)
    sizes = [r["count"] for r in d.groupBy("b").count().collect()]
    assert n == len(sizes) == 16 and max(sizes) < 2 * len(keys) / 16
    pairs = sorted(((r["k"] or "").encode(), r["b"]) for r in d.collect())
    assert [b for _, b in pairs] == sorted(b for _, b in pairs)
    d, n = with_quantile_bucket(df, "k", "b")
    assert n == bucket_count(len(keys)) > 1


@pytest.mark.parametrize("values", [[1.5] * 9, [float("nan"), 1.0, float("inf"), -0.0, None, 2.0], list(range(9000)), []])
def test_number_buckets_keep_the_order(spark, values):
    d, n = with_quantile_bucket(spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double"), "v", "b")
    got = [r["b"] for r in d.orderBy("v").collect()]
    assert got == sorted(got) and max(got, default=0) < n


@pytest.mark.parametrize("n,levels", [(1, 1), (60, 5), (400, 37), (9000, 9000)])
def test_roc_points_without_straight_ones(spark, n, levels):
    rng = random.Random(n)
    rows = [(g, rng.randrange(levels) / levels, int(rng.random() < 0.4)) for g in "ab" for _ in range(n)]
    df = spark.createDataFrame(rows, "label string, score double, y int")
    for drop in (False, True):
        want = set()
        for g in "ab":
            points, tps, fps = [], 0, 0
            for s in sorted({s for l, s, _ in rows if l == g}, reverse=True) if n < 9000 else []:
                ys = [y for l, t, y in rows if l == g and t == s]
                tps, fps = tps + sum(ys), fps + len(ys) - sum(ys)
                points.append((g, s, tps, fps))
            if n == 9000:
                for s, y in sorted(((s, y) for l, s, y in rows if l == g), reverse=True):
                    tps, fps = tps + y, fps + 1 - y
                    if points and points[-1][1] == s:
                        points.pop()
                    points.append((g, s, tps, fps))
            keep = [i for i in range(len(points)) if not drop or i in (0, len(points) - 1) or any(
                points[i + 1][k] - 2 * points[i][k] + points[i - 1][k] for k in (2, 3))]
            want |= {points[i] for i in keep} | {(g, points[0][1] + 1, 0, 0)}
        got = [(r["label"], r["threshold"], r["tps"], r["fps"]) for r in M.roc_curve(df, drop_intermediate=drop).collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("keys", [["b", "a", "\u00e9", "", "aa", "ab", "\U0001f600"], [f"user-{i}" for i in range(300)], ["same"], []])
def test_batches_of_string_keys(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["batch_id"] for r in SP.batch_assign(df, "k", 4).collect()}
    assert got == {k: i // 4 for i, k in enumerate(sorted(keys, key=str.encode))}


def test_sample_of_all_rows_and_split_bounds(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert SP.sample_n(df, "k", -1).count() == 10
    for ratio in (0.0, 1.0):
        assert {r["is_train"] for r in SP.split_exact(df, "k", 1, ratio).collect()} == {int(ratio)}


def test_masked_mean_and_zero_denominator(spark):
    vecs = spark.createDataFrame([(0, [9.0, 9.0]), (5, [1.0, 3.0]), (6, [3.0, 5.0])], "id long, vec array<float>")
    df = spark.createDataFrame([(1, [5, 6, 0], 2), (2, [0, 0, 0], 0)], "k long, ids array<long>, n int")
    got = {r["k"]: r["pooled"] for r in embed.mean_pool(df, "k", "ids", "n", vecs, 3, 2, masked=True).collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}
    one = spark.createDataFrame([(1,)], "x int")
    assert P.label_prevalence(one, ["x"], denominator=0).first()["pct"] is None
