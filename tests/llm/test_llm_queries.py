"""The registered corpus queries and the pipeline on whole small tables, against DuckDB or brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import bpe, quality, simhash
from textloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)


def components_of(ids, fps, bits):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([fps[i] for i in ids], dtype=np.uint64)
    for k, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= bits).tolist():
            a, b = root(i), root(ids[k + 1 + m])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_op2(spark, rows):
    fps = {i: simhash.text_fingerprint(t) for i, t, _ in rows}
    want = components_of(sorted(fps), fps, 4)
    got = QUERIES["op2_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_op4_and_op10(spark, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_tokenizer_path())
    ids = {i: e.ids for (i, _, _), e in zip(rows, plain.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False))}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    pieces, start, files = [], 0, []
    for i, own in ids.items():
        whole = [*own, 2]
        cuts = [0, *range(len(whole) % 1024 or 1024, len(whole) + 1, 1024)]
        pieces += [(i, k, a, b - a, crc(whole[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        files.append((i, start, len(own) + 1, crc([*own, 0])))
        start += len(own) + 1
    packed = QUERIES["op4_best_fit_packing"](spark, SF).toPandas()
    assert sorted(packed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == pieces
    assert packed.sequence_id.nunique() <= 1.02 * packed.length.sum() / 1024 + 1
    read = QUERIES["op10_token_files"](spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read) == files


def test_op5_takes_reach_their_targets(spark, rows):
    got = QUERIES["op5_source_mixing"](spark, SF).collect()
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    taken, target = {}, {}
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert sum(taken.values()) == round(1.5 * sum(size.values())) and sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in taken)


def often(words, size):
    """Words in windows of `size` words that occur twice or more."""
    windows = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
    count = Counter(windows)
    return {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(size)}


def test_op7(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        words, seen, dup = WORDS.findall(text or ""), set(), 0
        for line in (text or "").split("\n"):
            dup += bool(WORDS.search(line)) and line in seen
            seen.add(line)
        n, repeated = len(words), len(often(words, 3))
        # repeats of m words or more are tiled by repeated windows of m words, and repeat lengths have no gaps
        covered = len(often(words, quality.MIN_REPEAT))
        low, high = 0, n
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if often(words, mid) else (low, mid - 1)
        failed = n < 50 or 100 * repeated > 50 * n
        kept = not failed and covered <= quality.MAX_COVERED * n and (low <= quality.LONGEST_FROM or low <= quality.MAX_LONGEST * n)
        want = {"doc_id": i, "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup,
                "n_repeat_words": repeated, "covered_words": covered, "longest_repeat": low, "base_failed": failed, "kept": kept}
        assert got[i].asDict() == want


def test_op8(spark, rows):
    shards = QUERIES["op8_sharding"](spark, SF).toPandas()
    assert sorted(shards.doc_id) == [i for i, _, _ in rows] and shards.shard.between(0, 23).all() and (shards.law == "bytes").all()
    crc = shards.set_index("doc_id").text_crc32
    assert all(crc[i] == zlib.crc32((t or "").encode()) for i, t, _ in rows)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        was = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        if name == "best_fit_packing":
            assert {r.doc_id for r in after.select("doc_id").collect()} == set(was)
            break
        assert after.columns == columns
        now = after.select("doc_id", "text").collect()
        if name == "quality_rules":
            keep = [row[-1] for row in quality.quality_rows(list(was.values()), quality.MIN_REPEAT, quality.MAX_COVERED, quality.MAX_LONGEST, 10**6)]
            assert {r.doc_id for r in now} == {i for i, k in zip(was, keep) if k}
        elif name == "line_dedup":
            assert [r.doc_id for r in now] and {r.doc_id for r in now} == set(was)
            assert all(set(r.text.split("\n")) <= set(was[r.doc_id].split("\n")) | {""} for r in now)
        elif name == "simhash_near_dedup":
            fps = {i: simhash.text_fingerprint(t) for i, t in was.items()}
            assert sorted(r.doc_id for r in now) == sorted(set(components_of(sorted(fps), fps, 4).values()))
        elif name == "source_mixing":
            total = sum(len(WORDS.findall(t)) for t in was.values())
            assert sum(len(WORDS.findall(r.text)) for r in now) == round(1.5 * total)
            assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        before = after


def test_simhash_stage_keeps_one_row_of_each_group(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(80))
    near = text(1) + " tail"
    assert (simhash.text_fingerprint(near) ^ simhash.text_fingerprint(text(1))).bit_count() <= simhash.MAX_BITS
    rows = [(None, text(n), "a") for n in range(10, 16)] + [(None, text(10), "a"), (7, text(20), "a"), (7, text(21), "a")]
    rows += [(3, text(1), "a"), (9, near, "a"), (9, text(22), "a"), (8, text(23), "a"), (8, text(23), "b"), (None, text(1), "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.simhash_stage(spark, table, SF).collect())
    assert got == sorted([("None", text(n)) for n in range(10, 16)] + [("7", text(20)), ("7", text(21)), ("3", text(1)), ("9", text(22)), ("8", text(23))])
