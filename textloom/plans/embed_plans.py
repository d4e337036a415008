"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import embed as EM
from textloom.plans.encode_plans import EOS, MAX_LEN, PAD, SQL_FIXED_CTES, UNK, _doc_tokens, fixed_word_encoding
from textloom.plans import sqlfrag as S
from textloom.plans.registry import register
from textloom.plans.text_plans import sql_vocab_with, word_vocab
from textloom.session import scratch_path
from textloom.session import materialize
from textloom.sources import files as FS
from textloom.sources import tables as tb

DIM = 64


def word_vectors(spark: SparkSession, sf: str, vocab: DataFrame | None = None) -> DataFrame:
    """The word-vector file: vocabulary words whose id has a row in `embeddings`, written as
    `word f1 ... f64` text with a header line (S05 format) and read back."""
    vocab = vocab if vocab is not None else word_vocab(spark, sf)
    emb = tb.table(spark, sf, "embeddings").select("vec_id", "embedding")
    words = vocab.join(emb, vocab["id"] == emb["vec_id"]).select("token", F.col("embedding").alias("vec"))
    path = scratch_path(spark, "vectors")
    FS.write_vectors(words, path)
    return FS.read_vectors(spark, path, DIM)


def id_vectors(spark: SparkSession, sf: str, vocab: DataFrame | None = None) -> DataFrame:
    vocab = vocab if vocab is not None else word_vocab(spark, sf)
    return EM.attach_vectors(vocab, word_vectors(spark, sf, vocab), DIM)


SQL_VEC = f""", vectors AS (SELECT v.token, e.embedding AS vec FROM vocab v JOIN embeddings e ON e.vec_id = v.id),
    idvec AS (SELECT v.token, v.id, coalesce(x.vec, list_transform(range({DIM}), lambda i: CAST(0.0 AS FLOAT))) AS vec,
              CAST(x.vec IS NOT NULL AS INTEGER) AS has_vec FROM vocab v LEFT JOIN vectors x USING (token))
"""


def _sql_summary(src: str, key: str) -> str:
    """vec_sum / vec_l2 / vec_0 of a `(key, d, x)` long vector table."""
    return f"""SELECT {key}, round(sum(x), 6) AS vec_sum, round(sqrt(sum(x * x)), 6) AS vec_l2,
        round(max(CASE WHEN d = 1 THEN x END), 6) AS vec_0 FROM {src} GROUP BY {key}"""


@register(
    "embed_lookup",
    sql_vocab_with()
    + SQL_VEC
    + """, lv AS (SELECT token, id, has_vec, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS d FROM idvec),
    s AS ("""
    + _sql_summary("lv", "token, id, has_vec")
    + ") SELECT token, id, has_vec, vec_sum, vec_l2, vec_0 FROM s",
)
def embed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """S05 + J03: vector of every vocabulary entry (zeros when the file has none)."""
    iv = id_vectors(spark, sf, materialize(word_vocab(spark, sf)))
    return iv.select("token", "id", "has_vec", *EM.vec_summary(F.col("vec")))


@register(
    "embed_mean_pool",
    SQL_FIXED_CTES.rstrip()
    + SQL_VEC
    + """, pv AS (SELECT f.doc_id, iv.vec FROM (SELECT doc_id, unnest(ids) AS id FROM fx) f JOIN idvec iv USING (id)),
    pd AS (SELECT doc_id, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS d FROM pv),
    pm AS (SELECT doc_id, d, sum(x) / """
    + f"{float(MAX_LEN)}"
    + """ AS x FROM pd GROUP BY doc_id, d) """
    + _sql_summary("pm", "doc_id"),
)
def embed_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of token vectors over all 256 positions of the fixed encoding (padding included)."""
    vocab = materialize(word_vocab(spark, sf))
    enc = fixed_word_encoding(spark, sf, vocab)
    vecs = id_vectors(spark, sf, vocab).where("has_vec = 1")  # zeros add nothing to a sum
    pooled = EM.mean_pool(enc, "doc_id", "input_ids", "length", vecs, MAX_LEN, DIM, masked=False, pad_id=PAD)
    return pooled.select("doc_id", *EM.vec_summary(F.col("pooled")))


@register(
    "embed_first_pool",
    sql_vocab_with()
    + SQL_VEC
    + f""", docs AS (SELECT doc_id, {S.word_tokens('text')} AS t FROM documents),
    fi AS (SELECT d.doc_id, CASE WHEN len(d.t) = 0 THEN {EOS} ELSE coalesce(v.id, {UNK}) END AS id
           FROM docs d LEFT JOIN vocab v ON v.token = d.t[1]),
    pd AS (SELECT fi.doc_id, fi.id, unnest(iv.vec)::DOUBLE AS x, generate_subscripts(iv.vec, 1) AS d
           FROM fi JOIN idvec iv USING (id)),
    s AS ("""
    + _sql_summary("pd", "doc_id, id")
    + ") SELECT doc_id, CAST(id AS BIGINT) AS first_id, vec_sum, vec_l2, vec_0 FROM s",
)
def embed_first_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Vector of position 0 in the layout with both specials at the end (ids + <eos> <cls>)."""
    vocab = materialize(word_vocab(spark, sf))
    firsts = EM.first_ids(_doc_tokens(spark, sf), "doc_id", "tokens", vocab, EOS, UNK)
    ids = firsts.select("doc_id", F.array("first").alias("input_ids"))
    first = EM.first_pool(ids, "doc_id", "input_ids", id_vectors(spark, sf, vocab), DIM)
    return first.select("doc_id", F.col("id").alias("first_id"), *EM.vec_summary(F.col("pooled")))
