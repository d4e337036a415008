"""Operators of the corpus subpackage against brute force, worked cases and awkward tables."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, embeddings, linededup, mixing, packing, pii, quality, sharding, simhash, simple8b, toolcalls
from textloom.llm.common import running_sums, scratch
from textloom.llm.components import components
from textloom.llm.texts import text_key

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, idx int, fp string, bucket_ long"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, "y", 7) for i, t, s in rows], DOCS)


def awkward(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return docs(spark, [
        (1, None, "a"), (2, "", "a"), (3, "one", None), (4, "a b c\nd e f\ng h", "b"), (4, "a b c\nd e f\ng h", "b"), (None, "null id text", "c"),
        (5, long, "a"), (6, "  \n\t \n", "b"), (7, "a b c\nd e f\ng h", ""), (8, "é ß 日本　x", None)])


# ---------------------------------------------------------------- components

def test_components_of_chains_stars_and_pairs(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101 + i) for i in range(30)] + [(500, 499), (499, 498), (498, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, 1) == 1 for i in range(1, 41)) and all(got.get(101 + i) == 100 for i in range(30))
    assert got[500] == got[499] == 498
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 embeddings

def brute_links(vectors):
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    return linked


@pytest.mark.parametrize("n_pivots,length", [(256, 7), (1024, 9)])
def test_pivot_index_recall_and_precision_at_the_threshold(spark, n_pivots, length):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [base]
    for cos in (0.951, 0.97, 0.99, 0.94):
        noise = rng.normal(size=base.shape)
        noise -= (noise * base).sum(1, keepdims=True) * base
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        rows.append(cos * base + np.sqrt(1 - cos * cos) * noise)
    x = np.concatenate(rows)
    want = brute_links(x)
    got = embeddings.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rep int"),
                                  n_pivots=n_pivots, length=length).orderBy("vec_id").collect()
    n = np.array([r.n_links for r in got])
    assert (n <= want.sum(1)).all() and n.sum() >= 0.9 * want.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_pivot_index_long_lists_equal_vectors_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    near = [(i, (centre + 0.02 * rng.normal(size=16)).tolist()) for i in range(120)]
    rows = near + [(200, near[0][1]), (201, near[0][1]), (202, (2 * np.array(near[0][1])).tolist())]
    bad = [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] + [1.0] * 15), (305, [float("inf")] + [0.0] * 15), (306, [1.0, 2.0])]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) + len(bad)
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id) == (len(rows) - 1, 0)
    for i, _ in bad:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def slow_groups(rows):
    """Links, component and kept of every row by brute force."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v), g in zip(rows, good)]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if good[a] and good[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    root = brute_components(range(len(rows)), linked)
    ids = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            ids[root[n]] = min(i, ids.get(root[n], i))
    count = np.bincount([x for pair in linked for x in pair], minlength=len(rows))
    return sorted(((i, int(count[n]), ids.get(root[n]), i == ids.get(root[n])) for n, (i, _) in enumerate(rows)), key=repr)


def test_vectors_of_mixed_lengths_repeated_and_null_ids_match_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = []
    for n, dim in enumerate((16, 8, 16, 8, 3)):
        centre = rng.normal(size=dim)
        rows += [(100 * n + i % 7, (centre + 0.03 * rng.normal(size=dim)).tolist()) for i in range(12)]
    rows += [(None, rows[0][1]), (None, (np.array(rows[0][1]) * 2).tolist()), (None, [5.0, 1.0, 0.0, 2.0]), (None, [5.0, 1.0, 0.0, 2.1]), (None, None)]
    rows += [(5, [1.0, 0.0, 0.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0, 0.0, 0.0]), (6, [1.0, 0.0, 0.01, 0.0, 0.0])] + [(900, [0.0] * 8), (901, [None, 1.0]), (902, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = embeddings.op1(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == slow_groups(rows)


def test_links_of_a_whole_table_match_brute_force(spark):
    from conftest import SF_SMALL

    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = slow_groups([(r.vec_id, r.embedding) for r in table])
    got = sorted(map(tuple, embeddings.op1(spark, SF_SMALL).collect()), key=repr)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want) and sum(r == w for r, w in zip(got, want)) >= 0.95 * len(want)


def test_pivots_grow_with_the_rows():
    assert embeddings.index_size(10) == (256, 7) and embeddings.index_size(1 << 19) == (512, 9) and embeddings.index_size(10**12)[0] == 4096


# ---------------------------------------------------------------- 2 SimHash

def slow_fingerprint(text, n=4):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(nodes, linked):
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in nodes}


def test_fingerprint_matches_definition():
    random.seed(1)
    for text in [None, "", " \n", "one", "A b C", "A É x\x0by \x85 z　q r s"] + [" ".join(random.choice("abCdé") for _ in range(random.randint(1, 60))) for _ in range(100)]:
        assert simhash.text_fingerprint(text) == slow_fingerprint(text)


def test_multi_index_links_lose_nothing(spark):
    random.seed(2)
    base = [random.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in random.sample(range(64), random.randint(1, 6)):
                x ^= 1 << bit
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    table = spark.createDataFrame([(x, 1) for x in signed], "fp long, n long")
    for bits, segments, block in ((4, 3, 4096), (4, 2, 4096), (3, 4, 4096), (4, 5, 4096), (4, 5, 1), (4, 3, 2)):
        links = simhash.links(table, bits, segments, block)
        got = {r.node: r.component for r in components(links).collect()}
        want = brute_components(signed, [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits])
        assert {x: got.get(x, x) for x in signed} == want


def test_segments_follow_from_the_number_of_fingerprints():
    chosen = [simhash.choose_segments(n, 4) for n in (0, 1_000, 60_000, 10**6, 10**8, 10**10)]
    assert chosen == sorted(chosen, reverse=True) and chosen[0] == 5 and chosen[3:] == [3, 2, 2]
    for m in range(1, 6):
        plan = simhash.segment_plan(4, m)
        assert sum(w for _, w, _ in plan) <= 64 and all(r >= 0 for _, _, r in plan)


def test_long_buckets_are_cut_and_lose_no_link(spark):
    random.seed(11)
    low = {random.getrandbits(42) for _ in range(500)}  # one bucket of the upper 22 bits holds them all
    fps = sorted(low | {x ^ 1 << random.randrange(64) ^ 1 << random.randrange(42) for x in list(low)[:200]})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x, 1) for x in signed], "fp long, n long")
    got = {r.node: r.component for r in components(simhash.links(table, 4, 3, 16)).collect()}
    want = brute_components(signed, [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4])
    assert {x: got.get(x, x) for x in signed} == want


def test_one_row_of_each_group_stays_whatever_its_columns(spark):
    rows = [(1, "a b c d e", {"k": "2"}), (1, "a b c d e", {"k": "1"}), (2, "a b c d e", None), (None, "f g h i j", {}), (None, "f g h i j", {"z": "1"}),
            (3, None, None), (4, "", {"e": "1"})]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept map<string,string>")
    got = {(r.doc_id, r.text): r.kept for r in simhash.keep_one_of_group(table).collect()}
    assert got == {(1, "a b c d e"): {"k": "1"}, (None, "f g h i j"): {"z": "1"}, (3, None): None}
    assert simhash.keep_one_of_group(table.limit(0)).count() == 0


def test_scratch_tables_are_deleted_with_their_block(spark, tmp_path):
    from textloom.llm import common

    with common.scratch_dropped(spark):
        table = common.written(spark.range(5), "dropped")
        assert table.count() == 5
    path = table.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path) and not os.path.exists(os.path.dirname(path))


def test_simhash_awkward(spark):
    got = simhash.simhash_groups(awkward(spark)).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.component_id)
    assert by[1] == by[2] == by[6] == [1] and by[4] == [4, 4] and by[7] == [4]
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 3 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    luhn = sum((int(c) * (1 + i % 2)) // 10 + (int(c) * (1 + i % 2)) % 10 for i, c in enumerate(digits[::-1])) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]


def test_base_spans_match_plain_patterns():
    random.seed(5)
    parts = ["a", "1", "25", "@", ".", "..", "b.c", "+", " ", "-", "(", ")", "4111 1111 1111 1111", "256.1.1.1", "1.2.3.4", "_", "x@y.z", "é", "+1 (555) 010-9999"]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 14)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(PATTERNS[p], text) if passes(p, m[0]))
        assert pii.base_spans(text) == want


def test_patterns_find_unseen_identifiers_and_spare_others(spark):
    rows = [(i, f"so please write to u{i}@ex.org today", "a") for i in range(8)]
    rows += [(20, "now please write to peter99@localhost today", "a"), (21, "the number is 4111111111111112 or room12345 here", "a"), (22, "other words room12345", "a")]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, rows)).collect()}
    text = rows[8][1]
    assert [(s.start, s.kind, s.end) for s in got[20].added] == [(text.index("peter99"), 0, text.index(" today"))]
    assert all(not got[i].added for i in got if i != 20) and all(len(got[i].base) == 1 for i in range(8))


def test_proven_identifiers_are_marked_everywhere_and_prove_others(spark):
    rows = [(i, f"so please write to u{i}@ex.org today", "a") for i in range(12)]
    rows += [(20 + i, f"now please write to peter9{i}@localhost today", "a") for i in range(3)]
    rows += [(30 + i, f"they often sign as peter9{i}@localhost too", "a") for i in range(3)]
    rows += [(40, "but others sign as zed-7788 too", "a"), (41, "seen by zed-7788", "a"), (42, "seen by room12345", "a")]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, rows)).collect()}
    texts = {i: t for i, t, _ in rows}
    added = {i: [(texts[i][s.start : s.end], s.kind) for s in r.added] for i, r in got.items() if r.added}
    want = {20 + 10 * k + i: [(f"peter9{i}@localhost", 0)] for k in range(2) for i in range(3)}
    assert added == want | {40: [("zed-7788", 0)], 41: [("zed-7788", 0)]}


def test_held_out_identifiers_are_found_by_their_patterns(spark):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7)))
    prose = lambda: " ".join(word() for _ in range(random.randint(3, 12)))
    rows, held = [], {}
    for i in range(300):
        kind = i % 2
        lead = [["reachable", "under"], ["connected", "from"]][kind]
        if i < 160:  # seeds that the fixed patterns find
            what = f"{word()}{i}@mail.example.org" if kind == 0 else f"10.{i}.{i % 250}.7"
        else:        # written so that they don't
            what = f"{word()}{i}@intranet" if kind == 0 else f"10-{i}-{i % 250}-7"
            held[i] = (what, kind)
        rows.append((i, " ".join([prose(), *lead, what, "since", prose(), f"room{random.randrange(10**6)}", prose()]), "a"))
    # as many seeds fail as pass after these words, so they prove nothing
    rows += [(1000 + i, f"{prose()} order number {n} {prose()} order number x{i}-77", "a")
             for i, n in enumerate(["4111111111111111", "4111111111111112", "5500005555555559", "5500005555555558"] * 8)]
    rows += [(2000, "call +1 (269) 555-3296 4524132264652876 now", "a")] + [(2001 + i, f"{prose()} +1 (269) 555-{3000 + i} {prose()}", "a") for i in range(6)]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, rows)).collect()}
    texts = {i: t for i, t, _ in rows}
    added = {(i, texts[i][s.start : s.end], s.kind) for i, r in got.items() for s in r.added if i < 2000}
    right = {(i, what, kind) for i, (what, kind) in held.items()}
    assert len(added & right) >= 0.9 * len(right) and len(added & right) >= 0.9 * len(added)
    assert [(texts[2000][s.start : s.end], s.kind) for s in got[2000].added] == [("+1 (269) 555-3296", 3)]


def test_many_unseen_instances_are_no_reason_to_stop(spark):
    rows = [(i, f"so please write to u{i}@ex.org today", "a") for i in range(40)] + [(100 + i, f"so please write to user{i}x99 today", "a") for i in range(36)]
    got = pii.personal_data(docs(spark, rows)).collect()
    assert sum(len(r.added) for r in got) == 36
    rows = rows[:5] + [(100 + i, f"so please write to user{i}x99 today", "a") for i in range(200)]  # too many for few seeds
    assert sum(len(r.added) for r in pii.personal_data(docs(spark, rows)).collect()) == 0


def test_counter_examples_far_back_and_behind_failed_numbers():
    text = "0" * 5000 + "1.2.3.4 x" + "1.2.3.456 " * 5 + "a@b.co"
    base, found = pii.occurrences(text)
    assert text[slice(*base[0][::2])] == "0" * 5000 + "1.2.3.4" and base[-1][1] == 0
    assert pii.patterns_of("first " + " " * 500 + "second" + " " * 300 + "x1@y, next", 812, 816)[:4] == ["second", "first second", "next", "second next"]
    assert pii.shape("(Ab1) 22-é") == "(a9) 99-a" and pii.shape("4111 1111 1111 1111").endswith("L")


def test_base_spans_of_a_whole_table(spark):
    from conftest import SF_SMALL

    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pii.op3(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(PATTERNS[p], r.text or "") if passes(p, m[0]))
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(line.split(",")) - {""} <= set(row.spans.split(","))
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]


def test_personal_data_awkward(spark):
    got = pii.personal_data(awkward(spark)).collect()
    assert len(got) == 10 and all(not r.added for r in got)
    assert pii.personal_data(docs(spark, [])).count() == 0
    assert pii.base_spans("7" * 50_000 + "." + "a" * 50_000) == []


# ---------------------------------------------------------------- 4 packing, and the encoder

def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_tokenizer_path())
    ours = bpe.Encoder(bpe.default_tokenizer_path())
    random.seed(4)
    letters = "aéß.,'!? \n1²日 s t ll\x1c ªʰ"
    texts = ["", " ", "a  b", "it's 'll we 're", "a <|endoftext|> b", "\t\t a\t b", "🙂 🙂🙂 a"] + [
        "".join(random.choice(letters) for _ in range(random.randint(1, 12))) for _ in range(4000)]
    for text, raw in zip(texts, ours.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_equals_linear_search():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 400)
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    room = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        open_ = [(r, j) for j, r in enumerate(room) if r >= lengths[i]]
        if open_:
            room[min(open_)[1]] -= lengths[i]
        else:
            room.append(64 - lengths[i])
    used = np.bincount(bins, weights=lengths)
    assert sorted((64 - used).astype(int).tolist()) == sorted(room)


def test_packing_places_every_piece(spark):
    got = packing.pack_documents(awkward(spark)).toPandas()
    ours = bpe.Encoder(bpe.default_tokenizer_path())
    whole = {}
    for r in awkward(spark).collect():
        whole.setdefault(r.doc_id, []).append(ours.encode([r.text])[0] + np.array([2], "<u4").tobytes())
    assert got.length.between(1, 1024).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1024
    for doc_id, raws in whole.items():
        mine = got[got.doc_id.isna() if doc_id is None else got.doc_id == doc_id]
        assert mine.length.sum() == sum(len(r) // 4 for r in raws)
        raw = raws[0]
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])
            assert r.length == 1024 or r.piece == 0
    assert packing.pack_documents(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 5 mixing

def targets_by_loop(sizes, budget):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = {}
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        level = (budget - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_takes(spark):
    random.seed(7)
    for trial in range(4):
        rows = [(i, " ".join(["w"] * random.randint(0, 40)), random.choice(["a", "b", "c", "Z", "é", None][: trial + 3])) for i in range(300)]
        got = mixing.mix_plan(docs(spark, rows)).select("*", F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"]).alias("taken")).collect()
        sizes = {}
        for r in got:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
        want = targets_by_loop(sizes, 1.5 * sum(sizes.values()))
        taken = dict.fromkeys(sizes, 0)
        for r in got:
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert len(got) == 300 and sum(taken.values()) == round(1.5 * sum(sizes.values()))
        assert all(abs(taken[s] - want[s]) <= 41 for s in want)


def test_mix_returns_taken_copies_and_keeps_columns(spark):
    table = awkward(spark)
    out = mixing.mix(table)
    assert out.columns == table.columns
    plan = mixing.mix_plan(table).collect()
    assert len(plan) == 10
    want = sum(t.words for r in plan for t in r.takes)
    assert out.select(F.sum(mixing.words_in(F.col("text")))).first()[0] == want
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(table).collect()))
    assert mixing.mix(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 6 tool calls

def chat(*turns):
    return [(c, t, r, x if isinstance(x, str) or x is None else json.dumps(x), "k", 0) for c, t, r, x in turns]


def test_tool_calls_are_linked_ordered_and_validated(spark):
    call = lambda i, args, name="search": {"content": None, "tool_calls": [{"id": i, "name": name, "arguments": args}]}
    rows = chat(
        (1, 0, "user", "hi"), (1, 1, "tool", {"tool_call_id": "x", "content": "r"}), (1, 2, "assistant", call("x", {"limit": 3, "query": "q"})), (1, 3, "assistant", "done"),
        (2, 0, "assistant", call("a", {"query": {"$ref": "b"}})), (2, 1, "assistant", call("b", {"query": "z"})), (2, 2, "tool", {"tool_call_id": "b", "content": 1}),
        (2, 3, "tool", {"tool_call_id": "nowhere", "content": 1}), (3, 0, "assistant", call("c", {"limit": "x"})), (3, 1, "assistant", call("d", {}, "none")),
        (4, 0, "assistant", call("p", {"query": {"$ref": "q"}})), (4, 1, "assistant", call("q", {"query": {"$ref": "p"}})),
        (4, 2, "tool", {"tool_call_id": "p", "content": 0}), (4, 3, "tool", {"tool_call_id": "q", "content": 0}), (None, None, None, None), (5, 0, "assistant", "{not json"))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, json string, position int")
    got = toolcalls.format_chats(table).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got}
    assert [t for _, t in sorted((at[1, t].position, t) for t in range(4))] == [0, 2, 1, 3]
    assert [t for _, t in sorted((at[2, t].position, t) for t in range(4))] == [1, 2, 0, 3]
    assert (at[1, 2].linked, at[1, 1].linked, at[1, 2].errors) == (1, 1, [])
    assert at[2, 0].errors == ["a: no result"] and at[2, 3].errors == ["nowhere: no call"]
    assert at[3, 0].errors == ["c: missing query", "c: limit is no integer", "c: no result"] and at[3, 1].errors == ["d: unknown tool none", "d: no result"]
    assert at[4, 0].errors == at[4, 1].errors == ["dependency cycle"] and [at[4, t].position for t in range(4)] == [0, 1, 2, 3]
    assert at[1, 2].json == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"q"},"id":"x","name":"search"}]}'
    assert at[None, None].json == '{"content":null,"role":null}' and at[5, 0].json == '{"content":"{not json","role":"assistant"}'
    assert toolcalls.format_chats(table.limit(0)).count() == 0


# ---------------------------------------------------------------- 7 quality

def brute_repeats(words, least):
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    cover = lambda reach: len({p for i, r in enumerate(reach) for p in range(i, i + r)})
    return cover([3 * (b >= 3) for b in best]), cover([b * (b >= least) for b in best]), max(best, default=0)


def test_repetition_equals_brute_force():
    random.seed(1)
    texts = [" ".join(random.choice("abc") for _ in range(random.choice([0, 1, 2, 5, 30, 60]))) for _ in range(60)] + [None, "a " * 70]
    for text, row in zip(texts, quality.quality_rows(texts, 4, 0.4, 0.25, 300)):
        assert row[4:7] == brute_repeats((text or "").split(), 4)


def maximal_repeats(words):
    """{sequence: starts} of the sequences found twice or more that no word before or after all their places lengthens."""
    n, found = len(words), {}
    for i in range(n):
        for j in range(i + 1, n + 1):
            found.setdefault(tuple(words[i:j]), []).append(i)
    out = {}
    for seq, starts in found.items():
        left = {words[s - 1] if s else None for s in starts}
        right = {words[s + len(seq)] if s + len(seq) < n else None for s in starts}
        if len(starts) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
            out[seq] = starts
    return out


def test_spans_are_those_of_maximal_repeats():
    got = maximal_repeats("x a b c d y a b c d z b c".split())
    assert got == {("a", "b", "c", "d"): [1, 6], ("b", "c"): [2, 7, 11]}
    random.seed(4)
    texts = [" ".join(random.choice(letters) for _ in range(size)) for size in (1, 2, 9, 25, 40) for letters in ("a", "ab", "abcd", "abcdefghijkl") for _ in range(6)]
    for least in (2, 3, 5):
        for text, row in zip(texts, quality.quality_rows(texts, least, 0.4, 0.25, 200)):
            repeats = maximal_repeats(text.split())
            union = {s + k for seq, starts in repeats.items() if len(seq) >= least for s in starts for k in range(len(seq))}
            assert row[5:7] == (len(union), max(map(len, repeats), default=0)), text


def test_quality_measures_and_verdicts(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    copied = clean + "\n" + clean
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, [(1, clean, "a"), (2, copied, "a"), (3, "a#b <c>\n\na#b <c>", "a"), (4, None, "a")])).collect()}
    assert got[1].kept and not got[1].base_failed and got[2].base_failed and not got[2].kept
    assert (got[3].n_words, got[3].word_chars, got[3].n_symbols, got[3].n_dup_lines) == (4, 12, 6, 1)
    assert (got[4].n_words, got[4].base_failed, got[4].kept) == (0, True, False)
    table = awkward(spark)
    assert quality.quality_rules(table).count() == 10 and quality.keep_by_quality(table).columns == table.columns
    assert quality.keep_by_quality(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 8 sharding

def test_shards_are_balanced_and_groups_stay(spark):
    random.seed(9)
    rows = [(i, f"t{i} " + "x" * random.randint(0, 400), "a") for i in range(3000)] + [(5000 + i, "copy " * 30, "a") for i in range(1500)] + [(8000 + i, "few", "a") for i in range(20)]
    got = sharding.shard_rows(docs(spark, rows)).toPandas()
    per = got.groupby("shard").agg(size=("size", "sum"), n=("slot", "count"), top=("slot", "max"), slots=("slot", "nunique"))
    assert len(per) == 24 and (per.n == per.top + 1).all() and (per.n == per.slots).all()
    assert per["size"].max() / per["size"].mean() < 1.01
    assert got[got.doc_id >= 8000].shard.nunique() == 1
    assert got.set_index("doc_id").text_crc32[8000] == zlib.crc32(b"few") and got.set_index("doc_id")["size"][8000] == 11
    assert sharding.shard_rows(awkward(spark)).count() == 10 and sharding.shard_rows(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 9 lines

def test_shifted_passage_is_found_and_first_one_stays(spark):
    passage = [f"line number {i} of the shared passage" for i in range(30)]
    a = "\n".join(["own start", *passage, "own end"])
    b = "\n".join(["other", "start", "here", *passage, "tail"])
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, [(2, b, "a"), (1, a, "a")]), stats=True).collect()}
    assert got[1].text == a and got[1].removed_lines == 0
    left = got[2].text.split("\n")
    assert got[2].removed_lines >= 20 and len(left) + got[2].removed_lines == 34 and {"other", "start", "here", "tail"} <= set(left)


def test_chunks_join_to_the_text_and_awkward_rows(spark):
    table = awkward(spark)
    texts = table.where("text is not null").select(*text_key(F.col("text")), "text", F.lit(1).cast("long").alias("copies"))
    starts = linededup.chunk_starts(texts)
    same = texts.join(starts, ["t1", "t2"]).select("text", F.array_join(F.transform(
        linededup.chunks_of(F.col("text"), F.col("starts")), lambda c: c["body"]), "\n").alias("again"))
    assert same.count() == 9 and same.where("text <> again").count() == 0
    out = linededup.dedup_lines(table)
    assert out.columns == table.columns and out.count() == 10
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] is None and texts[2] == "" and texts[6] == "  \n\t \n"
    # three rows hold one text of a chunk of three lines: the first keeps it, be it one of two with equal ids
    assert sorted(r.text for r in out.collect() if r.doc_id in (4, 7)) == ["", "", "a b c\nd e f\ng h"] and texts[7] == ""
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4, 6, 10, 20])
def test_short_shared_passages_are_found(spark, k):
    random.seed(k)
    line = lambda: " ".join(f"w{random.randrange(5000)}" for _ in range(12))
    rows, shared = [], []
    for p in range(150):
        passage = [line() for _ in range(k)]
        shared.append(passage)
        for side in (0, 1):
            rows.append((2 * p + side, "\n".join([line() for _ in range(random.randint(0, 8))] + passage + [line() for _ in range(random.randint(0, 8))]), "a"))
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, rows), stats=True).collect()}
    gone = sum(got[2 * p + 1].removed_lines for p in range(150))
    assert gone >= 0.9 * 150 * k and all(got[2 * p].text == rows[2 * p][1] for p in range(150))
    for p, passage in enumerate(shared):  # nothing else goes
        assert set(rows[2 * p + 1][1].split("\n")) - set(got[2 * p + 1].text.split("\n")) <= set(passage)


def test_passages_that_meet_or_overlap_are_cut_alike(spark):
    a, b, c = ([f"{n} line {i} of it" for i in range(5)] for n in "abc")
    rows = [(1, a + b), (2, ["x"] + a + ["y"]), (3, ["z"] + b), (4, ["", *c, "", *a, ""]), (5, ["q", "", *c, ""]), (6, a[2:] + ["end"])]
    got = {r.doc_id: r.text.split("\n") for r in linededup.dedup_lines(docs(spark, [(i, "\n".join(x), "a") for i, x in rows])).collect()}
    assert got[1] == a + b and got[2] == ["x", "y"] and got[3] == ["z"] and not set(got[4]) & set(a) and not set(got[5]) & set(c[1:]) and got[6] == ["end"]


def test_copies_with_null_or_equal_ids_lose_what_repeats(spark):
    text = "one line\nand another\nand a third"
    rows = [(None, text, "a")] * 40 + [(9, text, "b")] * 3 + [(None, None, "c")]
    out = linededup.dedup_lines(docs(spark, rows)).collect()
    assert len(out) == 44 and [r.doc_id for r in out if r.text == text] == [9] and sum(r.text is None for r in out) == 1
    only = linededup.dedup_lines(docs(spark, rows[:40])).collect()
    assert sorted(r.text for r in only) == [""] * 39 + [text]


def test_line_dedup_plan_has_no_python(spark):
    plan = linededup.dedup_lines(awkward(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 10 token files

def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 59, 60, 61, 255, 256, 257, 1000):
        for high in (1, 2, 5, 100, 50257, 2**32, 2**60, 2**63):
            v = rng.integers(0, high, n, dtype=np.uint64)
            if n > 3 and high > 2**60:
                v[3] = 2**64 - 1
            words, offsets, escapes = simple8b.encode_blocks(v)
            assert (simple8b.decode_blocks(words, offsets, escapes, n) == v).all()
    words, offsets, escapes = simple8b.encode_blocks(np.array([1] * 60 + [2**63]))
    assert len(words) == 2 and escapes.tolist() == [2**63]


def test_token_files_round_trip(spark):
    table = awkward(spark)
    files = simple8b.write_token_files(table, scratch(spark, "tokens"))
    got = simple8b.read_token_files(files).orderBy("start").collect()
    ours = bpe.Encoder(bpe.default_tokenizer_path())
    want = {}
    for r in table.collect():
        want.setdefault(r.doc_id, ours.encode([r.text])[0] + np.array([0], "<u4").tobytes())
    start = 0
    for r in got:
        assert bytes(r.ids) == want[r.doc_id] and r.ids_crc32 == zlib.crc32(want[r.doc_id]) and r.start == start and r.n_tokens == len(want[r.doc_id]) // 4
        start += r.n_tokens
    ids = [r.doc_id for r in got]
    assert len(got) == 10 and ids[0] is None and ids[1:] == sorted(ids[1:])
    empty = simple8b.write_token_files(docs(spark, []), scratch(spark, "tokens"))
    assert simple8b.read_token_files(empty).count() == 0


def test_token_file_is_rejected_if_damaged():
    import io

    data = simple8b.frame_bytes([1], [3], np.array([5, 6, 0]))
    assert next(simple8b.read_frames(io.BytesIO(data)))[2].tolist() == [5, 6, 0]
    with pytest.raises(ValueError):
        next(simple8b.read_frames(io.BytesIO(b"\0" * 48)))


# ---------------------------------------------------------------- queries

def test_digest_of_spans(spark):
    row = pii.personal_data(docs(spark, [(1, "me@x.org 10.0.0.1 ip", "a")])).select(pii.spans_text(F.col("base")).alias("s")).first()
    assert row.s == "email:0:8,ip:9:17" and hashlib.sha256(row.s.encode()).hexdigest()


def test_hot_copies_with_null_ids_are_cut_and_balanced(spark):
    random.seed(12)
    rows = [(None, "the very same text of all these rows", "a")] * 4000 + [(i, f"{i} other " + "x" * random.randint(5, 60), "b") for i in range(4000)]
    got = sharding.shard_rows(docs(spark, rows)).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == 8000 and len(size) == 24 and size.max() <= 1.01 * size.mean() and size.min() >= 0.99 * size.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


def test_running_sums_over_many_buckets_and_null_keys(spark):
    rows = [(None if i % 3 == 0 else "k", (i * 7919) % 5003, i % 5) for i in range(5003)]
    df = spark.createDataFrame(rows, "key string, place long, n long")
    got = running_sums(df, ["key"], [F.col("place")], F.floor(F.col("place") / 2), {"before": "n", "rows_before": "n"}).collect()
    sums = {}
    for key, place, n in sorted(rows, key=lambda r: r[1]):
        sums[(key, place)] = sums.get(key, 0)
        sums[key] = sums.get(key, 0) + n
    assert len(got) == 5003 and all(r.before == sums[(r.key, r.place)] for r in got)
