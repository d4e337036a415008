"""Files read in parallel: CSV with line breaks, numbered lines; lookups on both ways."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import dictionary as D
from textloom.operators import subword as SW
from textloom.sources import files as FS
from textloom.sources.parallel_csv import read_csv_parallel, split_states


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_csv_is_cut_alike_by_many_tasks(spark, tmp_path, tiny_splits):
    random.seed(2)
    parts = ['"', '""', "\n", "\n\n", "\r\n", ",", "word", "é", " ", "a,b", "'", "\\", "long " * 60]
    rows = [(str(i), "".join(random.choice(parts) for _ in range(random.randint(0, 9))), i) for i in range(300)] + [("x", None, None), ("", "", 0)]
    schema = "id string, body string, n int"
    df = spark.createDataFrame(rows, schema).coalesce(2)
    for header in (True, False):
        path = str(tmp_path / f"c{header}")
        FS.write_csv(df, path, header=header)
        got = read_csv_parallel(spark, path, df.schema, header)
        plain = FS.read_csv(spark, path, df.schema, header)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect())) == sorted(map(repr, df.collect()))
        assert FS.split_lines(spark, path).select("file", "block").distinct().count() > 50


def test_csv_faults_are_errors(spark, tmp_path, tiny_splits):
    schema = spark.createDataFrame([], "id string, n int").schema
    for name, text in (("short", "id,n\n1,2\n3\n"), ("number", "id,n\n1,two\n"), ("head", "n,id\n1,2\n"), ("long", "id,n\n1,2,3\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            read_csv_parallel(spark, str(tmp_path / name), schema).collect()
    (tmp_path / "ok").write_text('id,n\n\n"a\nb",1\n"c""d",2\n\n')
    assert sorted(map(tuple, read_csv_parallel(spark, str(tmp_path / "ok"), schema).collect())) == [("a\nb", 1), ('c"d', 2)]
    (tmp_path / "none").write_text("id,n\n")
    assert read_csv_parallel(spark, str(tmp_path / "none"), schema).count() == 0


def test_split_states_follow_quotes_over_many_splits():
    row = lambda b, q, t: {"file": "f", "block": b, "quotes": q, "turns": t}
    states = split_states([row(0, 1, True), row(10, 0, False), row(20, 2, True), row(30, 1, False), row(40, 0, False)])
    assert states == {("f", 0): (0, 0), ("f", 10): (1, 0), ("f", 20): (1, 0), ("f", 30): (1, 20), ("f", 40): (0, 20)}


def test_vocabulary_file_in_parts_keeps_its_order(spark, tmp_path, tiny_splits):
    rows = [(f"token{i * 7919 % 1000:04d}", i) for i in range(1000)] + [(" padded ", 1000), ("", 1001)]
    df = spark.createDataFrame(rows, "token string, id long")
    for single in (False, True):
        path = str(tmp_path / f"v{single}")
        FS.write_lines(df, "token", "id", path, single)
        got = {r.id: r.token for r in FS.read_vocab_file(spark, path).collect()}
        assert got == {i: t.strip() for t, i in rows}
    (tmp_path / "one.txt").write_text("a\nb\n\nc")
    assert sorted(tuple(r) for r in FS.read_vocab_file(spark, str(tmp_path / "one.txt")).collect()) == [("", 2), ("a", 0), ("b", 1), ("c", 3)]


@pytest.mark.parametrize("most_rows", [None, 0])
def test_lookups_agree_on_both_ways(spark, most_rows):
    rows = [(1, ["a", "b", "a", "zz", None, "a"], "x"), (2, [], "y"), (3, None, "z"), (None, ["b"], "w")]
    df = spark.createDataFrame(rows, "k int, t array<string>, c string")
    table = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "token string, id long")
    got = sorted(map(tuple, D.lookup(df, ["k", "c"], "t", table, "token", "id", "ids", 7, most_rows).collect()), key=repr)
    assert got == sorted([(1, "x", [10, 20, 10, 7, 7, 10]), (2, "y", []), (3, "z", []), (None, "w", [20])], key=repr)
    back = spark.createDataFrame([(1, [20, 99, 10, 20])], "k int, ids array<long>")
    assert D.lookup(back, ["k"], "ids", table, "id", "token", "t", None, most_rows).first().t == ["b", None, "a", "b"]
    shuffled = D._places(df, ["k"], "t")
    assert shuffled.where("k = 1").count() == 4  # distinct elements, not occurrences


@pytest.mark.parametrize("most_rows", [None, 0])
def test_word_pieces_agree_on_both_ways(spark, most_rows):
    vocab = spark.createDataFrame([(t,) for t in ("un", "##aff", "##able", "##a", "a", "##b", "é", "[UNK]", "##")], "token string")
    words = ["unaffable", "una", "unx", "ab", "é", "a" * 101, "", "aab", "un##"]
    df = spark.createDataFrame([(i, [w]) for i, w in enumerate(words)] + [(50, words), (51, []), (52, None)], "k int, t array<string>")
    got = {r.k: r.p for r in SW.wordpiece_tokenize(df, "k", "t", vocab, "p", most_rows).collect()}
    want = [["un", "##aff", "##able"], ["un", "##a"], ["[UNK]"], ["a", "##b"], ["é"], ["[UNK]"], [], ["a", "##a", "##b"], ["[UNK]"]]
    assert [got[i] for i in range(len(words))] == want and got[50] == [p for ps in want for p in ps] and got[51] == got[52] == []


def test_large_tables_are_measured(spark):
    table = spark.range(100).select(F.col("id").cast("string").alias("t"), "id")
    assert D.small_table(table)[1].num_rows == 100 and D.small_table(table, most_rows=99)[1] is None and D.small_table(table, most_bytes=100)[1] is None


@pytest.mark.parametrize("masked", [False, True])
def test_mean_pool_agrees_on_both_ways(spark, masked):
    from textloom.operators.embed import mean_pool

    vectors = spark.createDataFrame([(0, [0.5, 1.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0])], "id long, vec array<float>")
    rows = [(i, [1, 2, 9, 2][: i % 5] + [0] * (4 - i % 5), i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, ids array<long>, n int")
    one, two = ({r.k: [round(x, 9) for x in r.pooled] for r in mean_pool(df, "k", "ids", "n", vectors, 4, 2, masked, 0, most).collect()} for most in (None, 0))
    assert one == two and len(one) == 600
    assert one[2] == ([2.0, 0.5] if masked else [(4.0 + 1.0) / 4, (1.0 + 2.0) / 4]) and one[0] == ([0.0, 0.0] if masked else [0.5, 1.0])
