"""Sub-word features end to end, strict lookup, processors, metric-history appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import encode as E
from textloom.operators import features as X
from textloom.operators.history import append_history, read_best, read_history, save_best
from textloom.operators.split import batch_assign
from textloom.operators.vocab import unknown_tokens
from textloom.plans import sqlfrag as S
from textloom.plans.encode_plans import CLS, EOS, MAX_LEN, PAD, UNK, sql_ids
from textloom.plans.registry import register
from textloom.plans.text_plans import _sql_piece_vocab, piece_vocab, sql_vocab_with, word_vocab
from textloom.session import materialize, scratch_path
from textloom.sources import tables as tb

PIECE_PAD, PIECE_UNK, PIECE_CLS, PIECE_SEP = 0, 1, 2, 3
SINGLE_LEN = 128
PAIR_LEN = 64
LABELS = tb.LABELS
PARTS = 2


def _text(ids: str) -> F.Column:
    return F.md5(F.array_join(ids, " "))


def _sql_pieces(source: str) -> str:
    """CTEs up to `res(doc_id, pieces)` for the texts of `source`, a query of (doc_id, text)."""
    return f"""WITH RECURSIVE {_sql_piece_vocab()}, vocab AS (SELECT token, id FROM pv),
    src AS ({source}), st AS (SELECT doc_id, {S.basic_tokens('text')} AS t FROM src),
    occ AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM st),
    w AS (SELECT DISTINCT word FROM occ),
    s1 AS (SELECT word, unnest(range(length(word))) AS st FROM w WHERE length(word) <= 100),
    s2 AS (SELECT word, st, unnest(range(1, length(word) - st + 1)) AS k FROM s1),
    cand AS (SELECT word, st, k, CASE WHEN st = 0 THEN '' ELSE '##' END || substr(word, st + 1, k) AS p FROM s2),
    best AS (SELECT c.word, c.st, max(c.k) AS k FROM cand c JOIN pv ON pv.token = c.p GROUP BY c.word, c.st),
    steps(word, st, pieces) AS (
        SELECT word, 0, CAST([] AS VARCHAR[]) FROM w WHERE length(word) <= 100
        UNION ALL
        SELECT s.word, s.st + b.k, list_append(s.pieces, CASE WHEN s.st = 0 THEN '' ELSE '##' END || substr(s.word, s.st + 1, b.k))
        FROM steps s JOIN best b ON b.word = s.word AND b.st = s.st WHERE s.st < length(s.word)),
    fin AS (SELECT w.word, CASE WHEN x.st = length(w.word) THEN x.pieces ELSE ['[UNK]'] END AS pieces
            FROM w LEFT JOIN (SELECT word, arg_max(pieces, st) AS pieces, max(st) AS st FROM steps GROUP BY word) x USING (word)),
    dp AS (SELECT doc_id, flatten(list(f.pieces ORDER BY pos)) AS pieces FROM occ JOIN fin f USING (word) GROUP BY doc_id),
    res AS (SELECT b.doc_id, coalesce(dp.pieces, CAST([] AS VARCHAR[])) AS pieces FROM st b LEFT JOIN dp USING (doc_id))"""


def _md5(ids: str) -> str:
    return f"md5(array_to_string({ids}, ' '))"


def _times(value: int, n: str) -> str:
    return f"list_transform(range({n}), lambda i: {value})"


@register(
    "encode_wordpiece_single",
    _sql_pieces("SELECT doc_id, " + S.clean_text_html("text") + " AS text FROM documents")
    + f", cut AS (SELECT doc_id, len(pieces) AS n_tokens, pieces[1:{SINGLE_LEN - 2}] AS tokens FROM res), "
    + sql_ids("cut", "doc_id", "tokens", "enc")
    + f""", body AS (SELECT doc_id, c.n_tokens, [{PIECE_CLS}] || e.ids || [{PIECE_SEP}] AS b FROM enc e JOIN cut c USING (doc_id))
    SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(len(b) AS INTEGER) AS length,
        {_md5(f'b || {_times(PIECE_PAD, f"{SINGLE_LEN} - len(b)")}')} AS ids_md5,
        {_md5(f'{_times(1, "len(b)")} || {_times(0, f"{SINGLE_LEN} - len(b)")}')} AS mask_md5,
        {_md5(_times(0, str(SINGLE_LEN)))} AS segments_md5 FROM body""",
)
def encode_wordpiece_single(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned documents as word pieces, [CLS] ids [SEP], padded with 0, mask and segments."""
    vocab = materialize(piece_vocab(spark, sf))
    docs = tb.table(spark, sf, "documents").select("doc_id", "text")
    f = X.single_features(docs, "doc_id", "text", X.wordpiece_tokenizer(vocab, clean=True), vocab, SINGLE_LEN,
                          [PIECE_CLS], [PIECE_SEP], PIECE_PAD, PIECE_UNK)
    return f.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("length").cast("int").alias("length"),
                    _text("input_ids").alias("ids_md5"), _text("input_mask").alias("mask_md5"), _text("segment_ids").alias("segments_md5"))


_ROOM = PAIR_LEN - 3


@register(
    "encode_wordpiece_pair",
    _sql_pieces("SELECT conv_id * 200000 + turn * 2 AS doc_id, text_a AS text FROM (" + tb.SQL_FIXTURES["pairs"]
                + ") UNION ALL SELECT conv_id * 200000 + turn * 2 + 1, text_b FROM (" + tb.SQL_FIXTURES["pairs"] + ") WHERE text_b IS NOT NULL")
    + f""", pp AS (SELECT p.conv_id, p.turn, a.pieces AS ta, b.pieces AS tb, b.pieces IS NOT NULL AND len(b.pieces) > 0 AS hb,
            len(a.pieces) AS la, coalesce(len(b.pieces), 0) AS lb
        FROM ({tb.SQL_FIXTURES["pairs"]}) p JOIN res a ON a.doc_id = p.conv_id * 200000 + p.turn * 2
        LEFT JOIN res b ON b.doc_id = p.conv_id * 200000 + p.turn * 2 + 1),
    pc AS (SELECT *, conv_id * 100000 + turn AS k,
        CASE WHEN hb THEN least(la, greatest({_ROOM} - lb, {-(-_ROOM // 2)})) ELSE least(la, {PAIR_LEN - 2}) END AS len_a,
        CASE WHEN hb THEN least(lb, greatest({_ROOM} - la, {_ROOM // 2})) ELSE 0 END AS len_b FROM pp),
    pk AS (SELECT *, ta[1:len_a] AS sa, coalesce(tb, [])[1:len_b] AS sb FROM pc), """
    + sql_ids("pk", "k", "sa", "ea") + ", " + sql_ids("pk", "k", "sb", "eb")
    + f""", body AS (SELECT pk.*, [{PIECE_CLS}] || ea.ids || [{PIECE_SEP}] || CASE WHEN hb THEN eb.ids || [{PIECE_SEP}] ELSE [] END AS b
        FROM pk JOIN ea USING (k) JOIN eb USING (k))
    SELECT conv_id, turn, CAST(len_a AS INTEGER) AS len_a, CAST(len_b AS INTEGER) AS len_b, CAST(len(b) AS INTEGER) AS length,
        {_md5(f'b || {_times(PIECE_PAD, f"{PAIR_LEN} - len(b)")}')} AS ids_md5,
        {_md5(f'{_times(1, "len(b)")} || {_times(0, f"{PAIR_LEN} - len(b)")}')} AS mask_md5,
        {_md5(f'{_times(0, "len_a + 2")} || {_times(1, "CASE WHEN hb THEN len_b + 1 ELSE 0 END")} || {_times(0, f"{PAIR_LEN} - len(b)")}')} AS segments_md5
    FROM body""",
)
def encode_wordpiece_pair(spark: SparkSession, sf: str) -> DataFrame:
    """A turn and the next one as word pieces with segments, longest side cut first."""
    vocab = materialize(piece_vocab(spark, sf))
    f = X.pair_features(tb.pairs(spark, sf), ["conv_id", "turn"], "text_a", "text_b", X.wordpiece_tokenizer(vocab), vocab,
                        PAIR_LEN, PIECE_CLS, PIECE_SEP, PIECE_PAD, PIECE_UNK)
    return f.select("conv_id", "turn", "len_a", "len_b", F.col("length").cast("int").alias("length"),
                    _text("input_ids").alias("ids_md5"), _text("input_mask").alias("mask_md5"), _text("segment_ids").alias("segments_md5"))


@register(
    "encode_specials_last",
    sql_vocab_with()
    + f", docs AS (SELECT doc_id, ({S.word_tokens('text')})[1:{MAX_LEN - 2}] AS tokens FROM documents), "
    + sql_ids("docs", "doc_id", "tokens", "enc")
    + f""" SELECT doc_id, CAST(len(ids) + 2 AS INTEGER) AS length,
        {_md5(f'ids || [{EOS}, {CLS}] || {_times(PAD, f"{MAX_LEN} - 2 - len(ids)")}')} AS ids_md5 FROM enc""",
)
def encode_specials_last(spark: SparkSession, sf: str) -> DataFrame:
    """The layout with both specials at the end, the text cut at its end."""
    f = X.single_features(tb.table(spark, sf, "documents"), "doc_id", "text", X.word_tokenizer, word_vocab(spark, sf), MAX_LEN,
                          [], [EOS, CLS], PAD, UNK)
    return f.select("doc_id", F.col("length").cast("int").alias("length"), _text("input_ids").alias("ids_md5"))


@register(
    "vocab_unknown_tokens",
    sql_vocab_with()
    + f""", f AS (SELECT token, count(*) AS n FROM (SELECT unnest({S.word_tokens('text')}) AS token FROM documents) GROUP BY token)
    SELECT token, CAST(n AS BIGINT) AS n FROM f ANTI JOIN vocab USING (token)""",
)
def vocab_unknown_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """J01, strict side: tokens of the corpus that the vocabulary lacks, with their occurrences."""
    docs = tb.table(spark, sf, "documents").select(T.word_tokens("text").alias("tokens"))
    return unknown_tokens(docs, word_vocab(spark, sf))


X.add_processor("comments", X.Processor(tuple(LABELS), {
    "train": lambda spark, sf: E.examples(tb.six_labels(spark, sf), F.concat(F.lit("train-"), F.col("doc_id").cast("string")), "text", LABELS),
    "test": lambda spark, sf: E.examples(tb.test_comments(spark, sf), F.concat(F.lit("test-"), F.col("doc_id").cast("string")), "text", None),
}))
X.add_processor("turns", X.Processor((), {
    "test": lambda spark, sf: E.examples(tb.pairs(spark, sf), F.concat_ws("-", F.lit("turn"), "conv_id", "turn"), "text_a", None, "text_b"),
}))


@register(
    "prep_task_examples",
    "WITH p AS (" + tb.SQL_FIXTURES["pairs"] + ") SELECT concat('turn-', conv_id, '-', turn) AS guid, md5(text_a) AS text_a_md5, "
    "md5(text_b) AS text_b_md5, CAST(0 AS INTEGER) AS n_labels FROM p",
)
def prep_task_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Examples by the processor of a named task."""
    ex = X.processor("Turns").parts["test"](spark, sf)
    return ex.select("guid", F.md5("text_a").alias("text_a_md5"), F.md5("text_b").alias("text_b_md5"), F.size("labels").cast("int").alias("n_labels"))


@register(
    "history_append",
    tb.sql_with("history")
    + """SELECT run, CAST(count(*) AS BIGINT) AS n_epochs, CAST(arg_min(epoch, struct_pack(m := metric, e := epoch)) AS BIGINT) AS best_epoch,
        round(min(metric), 6) AS best_metric FROM history GROUP BY run""",
)
def history_append(spark: SparkSession, sf: str) -> DataFrame:
    """A history appended in parts, the first of them twice, as by a run that starts over; then the best
    checkpoints of all that was appended, stored as a version and read back."""
    hist, path, bests = materialize(tb.history(spark, sf)), scratch_path(spark, "history"), scratch_path(spark, "best")
    for part in [0, *range(PARTS)]:
        append_history(hist.where(F.col("epoch") % PARTS == part), path, f"epochs-{part}")
    save_best(read_history(spark, path), bests)
    best = read_best(spark, bests)
    return best.select("run", "n_epochs", "best_epoch", F.round("best_metric", 6).alias("best_metric"))


@register(
    "batch_assign_string",
    "SELECT 'doc-' || doc_id AS name, CAST(floor((row_number() OVER (ORDER BY 'doc-' || doc_id) - 1) / 8) AS BIGINT) AS batch_id FROM documents",
)
def batch_assign_string(spark: SparkSession, sf: str) -> DataFrame:
    """W01 with a string key."""
    names = tb.table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"))
    return batch_assign(names, "name", 8)


@register(
    "eda_describe_binary",
    tb.sql_with("six_labels")
    + " UNION ALL ".join(
        f"""SELECT '{l}' AS "column", CAST(count({l}) AS BIGINT) AS count, round(avg({l}), 6) AS mean, round(stddev_samp({l}), 6) AS std,
        quantile_cont(CAST({l} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({l} AS DOUBLE), 0.5) AS q50,
        quantile_cont(CAST({l} AS DOUBLE), 0.75) AS q75 FROM six_labels""" for l in LABELS),
)
def eda_describe_binary(spark: SparkSession, sf: str) -> DataFrame:
    """A06 over columns that hold two values."""
    from textloom.operators.profile import describe

    long = tb.six_labels(spark, sf).select(*LABELS).unpivot([], LABELS, "column", "v")
    d = describe(long, "column", "v")
    return d.select("column", F.col("count").cast("long").alias("count"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "q25", "q50", "q75")
