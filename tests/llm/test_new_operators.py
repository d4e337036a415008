"""Centroid clustering, periodic runs and suffix-array dedup against brute force and awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from textloom.llm import centroids, periodic, repeats
from textloom.llm.common import read_table

DOCS = "doc_id long, text string, t1 string, t2 int, f string, spans string, runs int, collapsed int, n_words int"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 2, 3, 4) for i, t in rows], DOCS)


# ---------------------------------------------------------------- 11 centroids

def slow_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims
            and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            centres[n] = [sum(col) // len(vs) for col in zip(*vs)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), centres


def test_clusters_match_brute_force_with_ties_repeats_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 5) / 4).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (7, [0.1] * 5), (None, [0.5] * 5), (None, [-0.5] * 5)]
    bad = [(300, None), (301, []), (302, [1.0] * 4), (303, [None, 1.0, 1.0, 1.0, 1.0]), (304, [float("nan")] * 5), (305, [float("inf")] * 5), (306, [1e300] * 5)]
    df = spark.createDataFrame([(i, v, 1, [0]) for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, v array<int>")
    for k, rounds, n_pivots in ((12, 5, 6), (3, 2, 1), (1, 1, 4), (500, 1, 6)):
        got, centres = centroids.cluster_vectors(df, k=k, rounds=rounds, dimensions=5, n_pivots=n_pivots)
        want, slow_centres = slow_clusters(rows, k, rounds, 5)
        assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
        assert centres.tolist() == slow_centres
    facts = centroids.with_inertia(got, centres).collect()
    assert len(facts) == len(rows) and all(r.inertia == sum(x.distance for x in facts) for r in facts)
    empty, none = centroids.cluster_vectors(df.limit(0), dimensions=5)
    assert centroids.with_inertia(empty, none).count() == 0


def test_ptolemaic_bounds_hold_and_prune_clustered_vectors():
    rng = np.random.default_rng(2)
    middles = rng.integers(-2000, 2000, (20, 16))
    x = middles[rng.integers(0, 20, 3000)] + rng.integers(-40, 40, (3000, 16))
    pivots = centroids.choose_pivots(x[:40], 8)
    px, pc = centroids._to_pivots(x, pivots), centroids._to_pivots(middles, pivots)
    exact = np.sqrt(np.stack([centroids.squared(x, np.broadcast_to(m, x.shape)) for m in middles], axis=1).astype(float))
    assert (centroids.lower_bounds(px, pc, pivots) <= exact).all()
    c, distance, checked = centroids.nearest(x, px, middles, pivots)
    assert (c == exact.argmin(axis=1)).all() and (distance == np.round(exact.min(axis=1) ** 2)).all()
    assert checked.mean() < 10


# ---------------------------------------------------------------- 12 periodic runs

def slow_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, q, size) for (s, size), q in out.items())


def test_runs_match_brute_force():
    random.seed(4)
    long_ones = 0
    for _ in range(1500):
        w = []
        for _ in range(random.randint(0, 6)):
            k = random.choice([2, 2, 3, 5, 50, 1000])
            unit = [random.randrange(k) for _ in range(random.randint(1, random.choice([3, 10, 40, 90])))]
            if random.random() < 0.3:
                unit = unit * random.randint(1, 3) + unit[:1]
            w += (unit * 9)[: random.randint(1, 8 * len(unit))]
        got = [(s, p, n) for s, n, p in periodic.runs_of(np.array(w, np.int64)).tolist()]
        assert got == slow_runs(w)
        long_ones += sum(p > periodic.SHORT for _, p, _ in got)
    assert long_ones > 200
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(9, np.int64), min_times=3)


def slow_run_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    gone = {i for s, p, size in runs for i in range(s + p, s + size)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
            sha("".join(f"{s},{size},{p}\n" for s, p, size in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_digests_of_awkward_rows(spark, monkeypatch):
    random.seed(9)
    unit = [f"u{i}" for i in range(37)]
    texts = [None, "", " \n\t", "one", "a " * 30, "x y " * 4, "é ß\x0b日本　x " * 7, " ".join(unit * 5), " ".join(f"w{i % 977}" for i in range(5000))]
    texts += [" ".join(random.choice("ab") for _ in range(random.randint(1, 80))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, "one"), (3, "a a a a a a a"), (None, "b c " * 9), (None, "b c " * 9)]
    df = docs(spark, rows)
    for size in (60, 400_000):
        monkeypatch.setattr(periodic, "BATCH_WORDS", size)
        got = periodic.run_digests(periodic.periodic_runs(df, rewrite=periodic.planted_order)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((slow_run_row(*r) for r in rows), key=repr)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_run_query_on_a_whole_table(spark):
    got = {r.doc_id: tuple(r) for r in periodic.op12(spark, SF_SMALL).collect()}
    rows = read_table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r[1] for r in got.values()) > 5
    for r in rows:
        if len(r.text or "") < 20_000:
            assert got[r.doc_id] == slow_run_row(r.doc_id, r.text)


# ---------------------------------------------------------------- 13 suffix-array dedup

def slow_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(int)))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((len(x), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return out


def test_two_stage_order_and_windows_match_brute_force():
    random.seed(3)
    for _ in range(400):
        length, letters = random.choice([8, 13, 16, 24]), random.choice([1, 2, 4, 200])
        source = bytes(random.randrange(letters) for _ in range(200))
        pieces = []
        for _ in range(random.randint(1, 6)):
            at = random.randrange(150)
            piece = source[at : at + random.randint(length, 60)] + bytes(random.randrange(letters) for _ in range(random.choice([0, 30])))
            pieces.append(piece if len(piece) >= length else piece + bytes(length))
        windows = [random.randint(1, len(p) - length + 1) for p in pieces]
        times = Counter(p[i : i + length] for p, n in zip(pieces, windows) for i in range(n))
        want = [[times[p[i : i + length]] > 1 for i in range(n)] for p, n in zip(pieces, windows)]
        assert [x.tolist() for x in repeats.repeated_windows(pieces, windows, length)] == want
        text = b"".join(pieces)
        order = repeats.two_stage_order(text, np.ones(len(text), bool), len(text))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = repeats.common_prefixes(text, order[:-1], order[1:], 24)
        for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), shared.tolist()):
            assert text[a : a + n] == text[b : b + n] and (n == 24 or text[a + n : a + n + 1] != text[b + n : b + n + 1])


def planted(n, length):
    """Texts that share passages, edges, whole copies and periodic parts."""
    random.seed(11)
    word = lambda: "".join(random.choice("abcdé") for _ in range(random.randint(1, 5)))
    prose = lambda k: " ".join(word() for _ in range(k))
    hot, passages = prose(length // 2), [prose(length) for _ in range(4)]
    texts = [None, "", "short", "z" * (3 * length), "ab" * (2 * length), prose(4 * length)]
    texts += [texts[-1], texts[-1][3:], texts[-1][: 2 * length] + "X" + texts[-1][2 * length :]]
    for i in range(n):
        t = prose(random.randint(0, 2 * length))
        if i % 2:
            t += hot + prose(random.randint(0, length))
        if i % 5 == 0:
            t += random.choice(passages)[random.randint(0, 5) :] + prose(3)
        texts.append(t)
    return texts


@pytest.mark.parametrize("kinds,chunk", [(256, 1 << 18), (4, 50), (1, 97)])
def test_repeats_match_brute_force(spark, monkeypatch, kinds, chunk):
    monkeypatch.setattr(repeats, "KINDS", kinds)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "PART_OFFSETS", (5, 1))
    monkeypatch.setattr(repeats, "BLOCK_WINDOWS", 500)
    texts = planted(80, 40)
    rows = list(enumerate(texts)) + [(None, texts[5]), (None, "only here " * 2), (3, "z" * 39)]
    got = repeats.remove_repeats(docs(spark, rows), length=40, anchor=12, kept=True).collect()
    want = slow_removed([t for _, t in rows], 40)
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    have = sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) for r in got), key=key)
    assert have == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(docs(spark, [(1, None)]).limit(0)).count() == 0
    assert [tuple(r)[1:3] for r in repeats.remove_repeats(docs(spark, [(1, None)])).collect()] == [(0, [])]


def test_repeats_query_on_a_whole_table(spark):
    table = read_table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: (n, sum(e - s for s, e in spans), len(spans), sha) for r, (n, spans, sha) in zip(table, slow_removed([r.text for r in table], 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op13(spark, SF_SMALL).collect()}
    assert got == want and sum(x[1] for x in got.values()) > 1000
    assert spark.sql("SHOW TABLES").where(F.col("tableName").startswith("textloom")).count() == 0
