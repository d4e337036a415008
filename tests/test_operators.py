"""Hand-worked cases (FIXTURES.md part 3) and brute-force cross-checks of the operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.scoring import truncate_pair
from textloom.operators import encode as E
from textloom.operators import history as H
from textloom.operators import metrics as M
from textloom.operators import profile as P
from textloom.operators import subword as SW
from textloom.operators.rank import exact_rank, hash_prefix_bucket, with_quantile_bucket


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x")).alias("y")).first()["y"]


def test_word_tokenizer(spark):
    assert one(spark, T.word_tokens, "Hi!! 3 cats,dogs. End") == ["hi", "cats", ",", "dogs", ".", "end"]
    assert one(spark, T.word_tokens, "a¥nb") == ["ab"]
    assert one(spark, T.word_tokens_html, "a<br />b 3") == ["ab", "3"]
    assert one(spark, T.word_tokens, "") == []
    assert one(spark, T.word_tokens, None) == []


def test_whitespace_matches_python(spark):
    text = "a b c\x1cd\x85e　f\tg\nh  i j"
    assert one(spark, T.whitespace_split, text) == text.split()


def _basic(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    return SW.basic_tokenize(df, "t", "o").first()["o"]


def test_basic_tokenizer(spark):
    assert _basic(spark, "Café[CLS] [CLS] don't") == ["cafe", "[", "cls", "]", "[CLS]", "don", "'", "t"]
    assert _basic(spark, "ab中文c") == ["ab", "中", "文", "c"]
    assert _basic(spark, "a\x00b\tc") == ["ab", "c"]
    assert _basic(spark, "") == []


def test_wordpiece_cases(spark):
    entries = ["un", "##aff", "##able", "a", "##a", "ab", "##b", "##bc", "日"]
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(entries)], "token string, id long")
    cases = {"unaffable": ["un", "##aff", "##able"], "unx": ["[UNK]"], "a" * 100: ["a"] + ["##a"] * 99, "a" * 101: ["[UNK]"],
             "abc": ["[UNK]"], "aabc": ["a", "##a", "##bc"], "日a": ["日", "##a"], "": [], "##a": ["##a"], "😀": ["[UNK]"]}
    words = spark.createDataFrame([(w,) for w in cases], "word string")
    assert {r["word"]: r["pieces"] for r in SW.wordpiece_table(words, vocab).collect()} == cases
    none = spark.createDataFrame([], "token string, id long")
    assert {tuple(r["pieces"]) for r in SW.wordpiece_table(words.where("word <> ''"), none).collect()} == {("[UNK]",)}


def test_wordpiece_join_back(spark):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["un", "##aff", "##able", "[UNK]"])], "token string, id long")
    df = spark.createDataFrame([(1, ["unaffable", "unx", "un"]), (2, [])], "k int, t array<string>")
    out = {r["k"]: r["p"] for r in SW.wordpiece_tokenize(df, "k", "t", vocab, "p").collect()}
    assert out == {1: ["un", "##aff", "##able", "[UNK]", "un"], 2: []}


def test_pair_truncation_closed_form(spark):
    rows = [(a, b, m) for a in range(40) for b in range(40) for m in range(25)]
    df = spark.createDataFrame(rows, "a int, b int, m int")
    ta, tb = truncate_pair(F.col("a"), F.col("b"), F.col("m"))
    got = {(r["a"], r["b"], r["m"]): (r["x"], r["y"]) for r in df.select("a", "b", "m", ta.alias("x"), tb.alias("y")).collect()}
    for (a, b, m), (x, y) in got.items():
        if a + b <= m:
            assert (x, y) == (a, b)
            continue
        assert x + y == m and 0 <= x <= a and 0 <= y <= b, (a, b, m)
        if x < a and y < b:
            assert x - y in (0, 1), (a, b, m)  # of equal lengths the second loses first
        elif x < a:
            assert x >= y, (a, b, m)  # only the longer side loses
        else:
            assert y >= x - 1, (a, b, m)
    assert got[(10, 2, 8)] == (6, 2) and got[(5, 5, 7)] == (4, 3) and got[(3, 9, 7)] == (3, 4)


def test_encode_fixed_and_empty(spark):
    vocab = spark.createDataFrame([("<unk>", 0), ("<pad>", 1), ("a", 5), ("b", 6)], "token string, id long")
    df = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, [])], "k int, t array<string>")
    out = E.encode_single(df, "k", "t", vocab, 6, prefix=[2], suffix=[3], pad_id=0, unk_id=0)
    got = {r["k"]: (r["input_ids"], r["input_mask"], r["length"]) for r in out.collect()}
    assert got[1] == ([2, 5, 6, 0, 3, 0], [1, 1, 1, 1, 1, 0], 5)
    assert got[2] == ([2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], 2)


def test_encode_pair_layout(spark):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "c"])],
                                  "token string, id long")
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["c", "c"]), (2, ["a"], None)], "k int, ta array<string>, tb array<string>")
    out = {r["k"]: r for r in E.encode_pair(df, ["k"], "ta", "tb", vocab, 8, 2, 3, 0, 1).collect()}
    # pair: max 8 -> 5 tokens for a + b: a keeps 3, b keeps 2 -> [CLS] a b c [SEP] c c [SEP]
    assert out[1]["input_ids"] == [2, 4, 5, 6, 3, 6, 6, 3]
    assert out[1]["segment_ids"] == [0, 0, 0, 0, 0, 1, 1, 1]
    assert out[2]["input_ids"] == [2, 4, 3, 0, 0, 0, 0, 0]
    assert out[2]["input_mask"] == [1, 1, 1, 0, 0, 0, 0, 0]
    assert out[2]["segment_ids"] == [0] * 8


def _auc_rows(spark, scores, ys, label="l"):
    return spark.createDataFrame([(i, label, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, ys))],
                                 "k long, label string, score double, y int")


def test_auc_ties_and_one_class(spark):
    r = M.auc(_auc_rows(spark, [0.1, 0.4, 0.5, 0.5, 0.9], [0, 1, 1, 0, 1])).first()
    assert r["auc"] == pytest.approx(0.75)
    r = M.auc(_auc_rows(spark, [0.2, 0.5, 0.8], [0, 0, 0])).first()
    assert r["auc"] == pytest.approx(2 / 3)


def _pairwise_auc(scores, ys):
    pos = [s for s, y in zip(scores, ys) if y == 1]
    neg = [s for s, y in zip(scores, ys) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_and_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rnd = random.Random(3)
    scores = [round(rnd.random(), 2) for _ in range(600)]
    ys = [1 if rnd.random() < s else 0 for s in scores]
    df = _auc_rows(spark, scores, ys)
    ours = M.auc(df).first()["auc"]
    assert ours == pytest.approx(_pairwise_auc(scores, ys), abs=1e-12)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="yd", metricName="areaUnderROC", numBins=0)
    assert ours == pytest.approx(ev.evaluate(df.withColumn("yd", F.col("y").cast("double"))), abs=1e-9)


def test_exact_rank_matches_row_number(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long")
    d, _ = with_quantile_bucket(df, "v", "__b", 16)
    got = {r["k"]: r["r"] for r in exact_rank(d, F.col("__b"), ["v", "k"], "r").collect()}
    want = {k: i + 1 for i, (k, v) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    assert got == want
    h = df.withColumn("h", F.md5(F.col("k").cast("string")))
    got2 = {r["k"]: r["r"] for r in exact_rank(h, hash_prefix_bucket(F.col("h"), 2), ["h", "k"], "r").collect()}
    hs = {k: __import__("hashlib").md5(str(k).encode()).hexdigest() for k, _ in rows}
    want2 = {k: i + 1 for i, k in enumerate(sorted(hs, key=lambda k: (hs[k], k)))}
    assert got2 == want2


def _check_stop(row, series, mode, patience, delta, pct):
    """What the rule says about its own result: the best value is one of the series, nothing between it and
    the stop beats it by the margin, and the stop comes exactly when patience has run out or at a NaN."""
    stop, at, best = row["stop_epoch"], row["best_epoch"], row["best_metric"]
    end = len(series) - 1 if stop is None else stop
    assert at <= end and (series[at] == best or math.isnan(series[at]))
    margin = best * delta / 100 if pct else delta
    beats = (lambda m: m < best - margin) if mode == "min" else (lambda m: m > best + margin)
    assert not any(beats(m) for m in series[at + 1 : end + 1])
    if stop is None:
        assert end - at < patience and not any(math.isnan(m) for m in series[1 : end + 1])
    else:
        assert stop - at == patience or math.isnan(series[stop])
        assert not any(math.isnan(m) for m in series[1:stop])


def _hist_df(spark, runs):
    rows = [(r, e, float(m)) for r, series in runs.items() for e, m in enumerate(series)]
    return spark.createDataFrame(rows, "run long, epoch long, metric double")


# series, mode, patience, delta, percent -> stop, best epoch, best value; worked by hand
STOP_CASES = [
    ([5, 4, 4.5, 4.2, 3.9, 4, 4, 4], "min", 3, 0.0, False, 7, 4, 3.9),
    ([5, 4, 4.5, 4.2, 3.9, 4, 4, 4], "min", 3, 0.05, False, 7, 4, 3.9),
    ([5, 4, 4.5, 4.2, 3.9, 4, 4, 4], "min", 3, 0.2, False, 4, 1, 4.0),
    ([2.6, 2.34, 2.34], "min", 2, 10.0, True, 2, 0, 2.6),
    ([1, 1.05, 1.2, 1.2], "max", 2, 10.0, True, None, 2, 1.2),
    ([-1, -1.05, -2], "min", 2, 10.0, True, None, 2, -2.0),
    ([3, 2, float("nan"), 1], "min", 4, 0.0, False, 2, 1, 2.0),
    ([3, 2, float("nan"), 1], "min", 4, 0.5, False, 2, 1, 2.0),
    ([7], "max", 1, 0.0, False, None, 0, 7.0),
]


def test_early_stop_worked_cases(spark):
    for series, mode, patience, delta, pct, stop, at, best in STOP_CASES:
        r = H.early_stop(_hist_df(spark, {1: series}), mode, patience, delta, pct).first()
        assert (r["stop_epoch"], r["best_epoch"], r["best_metric"]) == (stop, at, best), (series, mode, delta)
    with pytest.raises(ValueError):
        H.early_stop(_hist_df(spark, {1: [1]}), "median", patience=3)


def test_early_stop_without_patience_records_nothing(spark):
    df = _hist_df(spark, {1: [5, 3, 4]})
    for delta in (0.0, 0.1):
        r = H.early_stop(df, "min", 0, delta).first()
        assert (r["n_epochs"], r["stop_epoch"], r["best_epoch"], r["best_metric"]) == (3, None, None, None)


@pytest.mark.parametrize("mode,delta,pct", [("min", 0.0, False), ("max", 0.0, False), ("min", 0.3, False), ("max", 5.0, True), ("min", 10.0, True)])
def test_early_stop_result_keeps_the_rule(spark, mode, delta, pct):
    rnd = random.Random(11)
    runs = {r: [round(rnd.uniform(-3 if r % 4 == 0 else 0, 10), 1) for _ in range(rnd.randint(1, 30))] for r in range(40)}
    runs[98] = [3.0, 2.0, float("nan"), 1.0]
    for r in H.early_stop(_hist_df(spark, runs), mode, 4, delta, pct).collect():
        _check_stop(r, runs[r["run"]], mode, 4, delta, pct)


def test_best_checkpoint_earliest_tie(spark):
    df = _hist_df(spark, {1: [3, 1, 2, 1]})
    r = H.best_checkpoint(df).first()
    assert (r["best_epoch"], r["best_metric"]) == (1, 1.0)


def test_describe_hand_case(spark):
    df = spark.createDataFrame([("c", float(v)) for v in [1, 2, 3, 4, 10]], "g string, v double")
    r = P.describe(df, "g", "v").first()
    assert r["mean"] == pytest.approx(4) and r["std"] == pytest.approx(3.5355339)
    assert (r["q25"], r["q50"], r["q75"], r["min"], r["max"]) == (2, 3, 4, 1, 10)


def test_histogram_hand_case(spark):
    df = spark.createDataFrame([("c", v) for v in [0.0, 0.1, 0.95, 1.0]], "g string, v double")
    h = {r["bin"]: r["n"] for r in P.histogram(df, ["g"], "v", 10).collect()}
    assert h[1] == 1 and h[2] == 1 and h[10] == 2 and sum(h.values()) == 4 and len(h) == 10
    const = spark.createDataFrame([("c", 2.0), ("c", 2.0)], "g string, v double")
    hc = {r["bin"]: r["n"] for r in P.histogram(const, ["g"], "v", 10).collect()}
    assert hc[6] == 2


def test_csv_roundtrip_quotes_and_newlines(spark, tmp_path):
    from pyspark.sql import types as Ty

    from textloom.sources import files as FS

    text = 'line one\nline "two", x  '
    df = spark.createDataFrame([("1", text)], "id string, comment_text string")
    FS.write_csv(df, str(tmp_path / "c"), header=True)
    schema = Ty.StructType([Ty.StructField("id", Ty.StringType()), Ty.StructField("comment_text", Ty.StringType())])
    assert FS.read_csv(spark, str(tmp_path / "c"), schema).first()["comment_text"] == text


def test_vocab_file_order(spark, tmp_path):
    from textloom.sources import files as FS

    words = [(f"w{i:04d}", 999 - i) for i in range(1000)]
    df = spark.createDataFrame(words, "token string, id long").repartition(7)
    FS.write_lines(df, "token", "id", str(tmp_path / "v"))
    back = {r["id"]: r["token"] for r in FS.read_vocab_file(spark, str(tmp_path / "v")).collect()}
    assert back == {i: t for t, i in words}


def test_next_turn_by_rank_join_equals_lead(spark, tmp_path):
    """The sentence-pair fixture pairs each turn with the next one even when turn numbers have gaps."""
    from pyspark.sql import Window

    from textloom.sources import tables as tb

    rows = [(c, t, f"c{c}t{t}") for c in range(5) for t in range(0, 3 * (c + 2), 3)] + [(9, 7, "only")]
    d = tmp_path / "sf"
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(d / "conversations.parquet"))
    got = {(r["conv_id"], r["turn"]): r["text_b"] for r in tb.pairs(spark, str(d)).collect()}
    src = spark.read.parquet(str(d / "conversations.parquet"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    want = {(r["conv_id"], r["turn"]): r["b"] for r in src.select("conv_id", "turn", F.lead("text").over(w).alias("b")).collect()}
    assert got == want


def test_readers_report_what_does_not_fit(spark, tmp_path):
    from textloom.sources import files

    schema = "id string, t string, v int"
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(schema)
    rows = [("1", "", 2), ("2", None, 3), ("3", 'a "q", \n b', None)]
    path = str(tmp_path / "ok.csv")
    files.write_csv(spark.createDataFrame(rows, schema), path)
    assert sorted(files.read_csv(spark, path, schema).collect()) == sorted(spark.createDataFrame(rows, schema).collect())
    for name, text in {"order": "t,id,v\na,1,2\n", "number": "id,t,v\n1,a,xx\n"}.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            files.read_csv(spark, str(tmp_path / name), schema).collect()
    good = tmp_path / "v.vec"
    good.write_text("2 2\nabc 1 2 \nd -1 0.5\n")
    assert {r["token"]: list(r["vec"]) for r in files.read_vectors(spark, str(good), 2).collect()} == {"abc": [1.0, 2.0], "d": [-1.0, 0.5]}
    bad = tmp_path / "bad.vec"
    bad.write_text("2 2\nabc 1 2\nd 1\n")
    with pytest.raises(Exception, match="no 2 numbers"):
        files.read_vectors(spark, str(bad), 2).collect()
    one = tmp_path / "one.vec"
    one.write_text("2 1\na 3\nb 4\n")
    assert files.read_vectors(spark, str(one), 1).count() == 2


def test_accents_equal_the_unicode_rule(spark):
    import unicodedata

    from textloom.functions.accents import strip_accents

    rnd = random.Random(3)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x345), *range(0x1E00, 0x1F00), 0xAC00, 0xD7A3, 0xFB2A, 0x1D15E, 0x0DDA, 0x212B, 0x1F600]]
    texts = [None, "", "plain"] + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", strip_accents("t").alias("s"))
    for r in df.collect():
        t = texts[r["i"]]
        want = t if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        assert r["s"] == want, repr(t)
