"""Encoding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import encode as E
from textloom.operators.vocab import lookup_ids, lookup_tokens
from textloom.plans import sqlfrag as S
from textloom.plans.registry import register
from textloom.plans.text_plans import sql_vocab_with, word_vocab
from textloom.session import materialize
from textloom.sources import tables as tb

UNK, PAD, CLS, EOS = 0, 1, 2, 3
MAX_LEN = 256
PAIR_LEN = 64
LABELS = tb.LABELS


def _join(arr):
    return F.array_join(arr, " ")


def _doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "documents").select("doc_id", T.word_tokens("text").alias("tokens"))


def sql_ids(src: str, key: str, toks: str, out: str) -> str:
    """DuckDB: token list -> id list through the `vocab` CTE (unknown -> 0), empty lists kept."""
    return f"""{out} AS (SELECT s.{key}, coalesce(x.ids, []) AS ids FROM {src} s LEFT JOIN (
        SELECT {key}, list(coalesce(v.id, {UNK}) ORDER BY pos) AS ids FROM (
            SELECT {key}, unnest({toks}) AS token, generate_subscripts({toks}, 1) AS pos FROM {src}) u
        LEFT JOIN vocab v USING (token) GROUP BY {key}) x USING ({key}))"""


_SQL_DOCS = f"docs AS (SELECT doc_id, {S.word_tokens('text')} AS tokens FROM documents)"


@register(
    "encode_ids",
    sql_vocab_with()
    + ", "
    + _SQL_DOCS
    + ", "
    + sql_ids("docs", "doc_id", "tokens", "enc")
    + """ SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids,
        CAST(len(list_filter(ids, lambda i: i = 0)) AS BIGINT) AS n_unk,
        md5(array_to_string(ids, ' ')) AS ids_md5 FROM enc""",
)
def encode_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's tokens -> word-vocabulary ids (unknown -> <unk>)."""
    enc = lookup_ids(_doc_tokens(spark, sf), word_vocab(spark, sf), "doc_id", "tokens", UNK, "ids")
    return enc.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"),
        F.size(F.filter("ids", lambda i: i == UNK)).cast("long").alias("n_unk"),
        F.md5(_join(F.col("ids"))).alias("ids_md5"),
    )


@register(
    "decode_ids",
    sql_vocab_with()
    + ", "
    + _SQL_DOCS
    + ", "
    + sql_ids("docs", "doc_id", "tokens", "enc")
    + """, dec AS (SELECT e.doc_id, coalesce(x.toks, []) AS toks FROM enc e LEFT JOIN (
        SELECT doc_id, list(v.token ORDER BY pos) AS toks FROM (
            SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM enc) u
        LEFT JOIN vocab v USING (id) GROUP BY doc_id) x USING (doc_id))
    SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, ' ')) AS decoded_md5 FROM dec""",
)
def decode_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids -> tokens (round trip of J01: unknown words come back as <unk>)."""
    vocab = materialize(word_vocab(spark, sf))
    enc = lookup_ids(_doc_tokens(spark, sf), vocab, "doc_id", "tokens", UNK, "ids").select("doc_id", "ids")
    dec = lookup_tokens(enc, vocab, "doc_id", "ids", "toks")
    return dec.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.md5(_join(F.col("toks"))).alias("decoded_md5"))


SQL_FIXED_CTES = (
    sql_vocab_with()
    + ", "
    + f"docs AS (SELECT doc_id, {S.word_tokens('text')} AS tokens0 FROM documents), "
    + f"docs2 AS (SELECT doc_id, len(tokens0) AS n_tokens, tokens0[1:{MAX_LEN - 2}] AS tokens FROM docs), "
    + sql_ids("docs2", "doc_id", "tokens", "enc")
    + f""", body AS (SELECT e.doc_id, d.n_tokens, [{CLS}] || e.ids || [{EOS}] AS b FROM enc e JOIN docs2 d USING (doc_id)),
    fx AS (SELECT doc_id, n_tokens, len(b) AS length,
        b || list_transform(range({MAX_LEN} - len(b)), lambda i: {PAD}) AS ids FROM body)""" + "\n"
)


@register(
    "encode_fixed",
    SQL_FIXED_CTES
    + f"""    SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(length AS INTEGER) AS length,
        md5(array_to_string(ids, ' ')) AS ids_md5,
        CAST(list_sum(list_transform(ids, lambda x: CASE WHEN x <> {PAD} THEN 1 ELSE 0 END)) AS BIGINT) AS mask_sum,
        CAST(list_sum(list_transform(ids, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS BIGINT) AS mask_gt0_sum,
        CAST(list_sum(ids) AS BIGINT) AS ids_sum
    FROM fx""",
)
def encode_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """<cls> + ids[:254] + <eos>, padded with <pad> to 256; mask id != pad;
    also the id > 0 mask of the XLNet scripts."""
    enc = E.encode_single(_doc_tokens(spark, sf), "doc_id", "tokens", word_vocab(spark, sf), MAX_LEN,
                          prefix=[CLS], suffix=[EOS], pad_id=PAD, unk_id=UNK, mask_rule="ne_pad")
    gt0 = E.attention_mask(F.col("input_ids"), F.col("length"), MAX_LEN, "gt0")
    return enc.select(
        "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("length").cast("int").alias("length"),
        F.md5(_join(F.col("input_ids"))).alias("ids_md5"),
        F.aggregate("input_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"),
        F.aggregate(gt0, F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_gt0_sum"),
        F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids_sum"),
    )


@register(
    "encode_pair",
    sql_vocab_with().replace("WITH ", "WITH ", 1)
    + ", pairs AS ("
    + tb.SQL_FIXTURES["pairs"]
    + f"""), pt AS (SELECT conv_id, turn, {S.word_tokens('text_a')} AS ta,
            CASE WHEN text_b IS NULL THEN NULL ELSE {S.word_tokens('text_b')} END AS tb FROM pairs),
    pl AS (SELECT *, (tb IS NOT NULL AND len(tb) > 0) AS hb, len(ta) AS la, coalesce(len(tb), 0) AS lb FROM pt),
    pc AS (SELECT *,
        CASE WHEN hb THEN least(la, greatest({PAIR_LEN - 3} - lb, CAST(ceil({PAIR_LEN - 3} / 2) AS BIGINT)))
             ELSE least(la, {PAIR_LEN - 2}) END AS len_a,
        CASE WHEN hb THEN least(lb, greatest({PAIR_LEN - 3} - la, CAST(floor({PAIR_LEN - 3} / 2) AS BIGINT)))
             ELSE 0 END AS len_b FROM pl),
    pk AS (SELECT conv_id * 100000 + turn AS k, *, ta[1:len_a] AS sa, coalesce(tb, [])[1:len_b] AS sb FROM pc),
    """
    + sql_ids("pk", "k", "sa", "ea")
    + ", "
    + sql_ids("pk", "k", "sb", "eb")
    + f""", body AS (SELECT pk.conv_id, pk.turn, pk.len_a, pk.len_b, pk.hb,
            CASE WHEN pk.hb THEN [{CLS}] || ea.ids || [{EOS}] || eb.ids || [{EOS}] ELSE [{CLS}] || ea.ids || [{EOS}] END AS b
        FROM pk JOIN ea USING (k) JOIN eb USING (k)),
    fx AS (SELECT *, len(b) AS length, b || list_transform(range({PAIR_LEN} - len(b)), lambda i: {PAD}) AS ids,
        list_transform(range(len_a + 2), lambda i: 0) || list_transform(range(CASE WHEN hb THEN len_b + 1 ELSE 0 END), lambda i: 1)
        || list_transform(range({PAIR_LEN} - len(b)), lambda i: 0) AS seg FROM body)
    SELECT conv_id, turn, CAST(len_a AS INTEGER) AS len_a, CAST(len_b AS INTEGER) AS len_b, CAST(length AS INTEGER) AS length,
        md5(array_to_string(ids, ' ')) AS ids_md5, md5(array_to_string(seg, ' ')) AS seg_md5 FROM fx""",
)
def encode_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence-pair features (turn, next turn) with longest-first truncation."""
    p = tb.pairs(spark, sf).select(
        "conv_id", "turn", T.word_tokens("text_a").alias("ta"),
        F.when(F.col("text_b").isNotNull(), T.word_tokens("text_b")).alias("tb"),
    )
    enc = E.encode_pair(p, ["conv_id", "turn"], "ta", "tb", word_vocab(spark, sf), PAIR_LEN, CLS, EOS, PAD, UNK)
    return enc.select(
        "conv_id", "turn", "len_a", "len_b", F.col("length").cast("int").alias("length"),
        F.md5(_join(F.col("input_ids"))).alias("ids_md5"), F.md5(_join(F.col("segment_ids"))).alias("seg_md5"),
    )


@register(
    "prep_label_vector",
    tb.sql_with("six_labels")
    + "SELECT doc_id, array_to_string(["
    + ", ".join(f"CAST(CAST({l} AS FLOAT) AS VARCHAR)" for l in LABELS)
    + "], ',') AS label_vec FROM six_labels",
)
def prep_label_vector(spark: SparkSession, sf: str) -> DataFrame:
    """The six labels of a row as one float vector (kept row-aligned)."""
    six = tb.six_labels(spark, sf)
    return six.select("doc_id", F.array_join(F.transform(E.label_vector(LABELS), lambda x: x.cast("string")), ",").alias("label_vec"))


@register(
    "prep_examples",
    tb.sql_with("six_labels", "test_comments")
    + "SELECT 'train-' || CAST(doc_id AS VARCHAR) AS guid, md5(text) AS text_a_md5, text_b, CAST(6 AS INTEGER) AS n_labels, "
    + "CAST(" + " + ".join(LABELS) + " AS DOUBLE) AS label_sum FROM (SELECT *, CAST(NULL AS VARCHAR) AS text_b FROM six_labels) "
    + "UNION ALL SELECT 'test-' || CAST(doc_id AS VARCHAR), md5(text), NULL, 0, 0.0 FROM test_comments",
)
def prep_examples(spark: SparkSession, sf: str) -> DataFrame:
    """(guid, text_a, text_b, labels) examples; test rows carry no labels."""
    train = E.examples(tb.six_labels(spark, sf), F.concat(F.lit("train-"), F.col("doc_id").cast("string")), "text", LABELS)
    test = E.examples(tb.test_comments(spark, sf), F.concat(F.lit("test-"), F.col("doc_id").cast("string")), "text", None)
    ex = train.unionByName(test)
    return ex.select(
        "guid", F.md5("text_a").alias("text_a_md5"), "text_b", F.size("labels").cast("int").alias("n_labels"),
        F.aggregate("labels", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")).alias("label_sum"),
    )


def fixed_word_encoding(spark: SparkSession, sf: str, vocab: DataFrame | None = None) -> DataFrame:
    """`doc_id, n_tokens, length, input_ids, input_mask` of every document (the encode_fixed layout)."""
    vocab = vocab if vocab is not None else word_vocab(spark, sf)
    return E.encode_single(_doc_tokens(spark, sf), "doc_id", "tokens", vocab, MAX_LEN,
                           prefix=[CLS], suffix=[EOS], pad_id=PAD, unk_id=UNK, mask_rule="ne_pad")
