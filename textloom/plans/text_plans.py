"""Text cleaning, tokenising and vocabulary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.accents import strip_accents
from textloom.operators import subword
from textloom.operators.split import hash_order, split_exact
from textloom.operators.vocab import WORD_SPECIALS, build_vocab, token_frequencies, top_tokens
from textloom.plans import sqlfrag as S
from textloom.plans.registry import register
from textloom.session import materialize
from textloom.sources import tables as tb

SPLIT_SEED = 23
TRAIN_RATIO = 0.7
MIN_FREQ = 10
TOPK = 100


def _digest(tokens) -> F.Column:
    return F.md5(F.array_join(tokens, " "))


def vocab_train_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Word tokens (T04) of the 70 % training split of the labelled documents."""
    train = split_exact(tb.train_comments(spark, sf).select("doc_id", "text"), "doc_id", SPLIT_SEED, TRAIN_RATIO)
    return train.where("is_train = 1").select("doc_id", T.word_tokens("text").alias("tokens"))


def word_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """The word vocabulary fixture: specials, then words with freq >= 10 of the train split."""
    return build_vocab(token_frequencies(vocab_train_tokens(spark, sf)), MIN_FREQ, WORD_SPECIALS)


# --- SQL side -------------------------------------------------------------
def sql_split(src: str, key: str, seed, ratio: float) -> str:
    """Exact seeded split in SQL: rank by md5(key:seed), key; train = round-half-even(r * N)."""
    return f"""SELECT *, CAST(row_number() OVER (ORDER BY md5(concat(CAST({key} AS VARCHAR), ':', '{seed}')), {key})
        <= round_even({ratio} * count(*) OVER (), 0) AS INTEGER) AS is_train FROM {src}"""


SQL_VOCAB_CTE = (
    "vsplit AS (" + sql_split("train_comments", "doc_id", SPLIT_SEED, TRAIN_RATIO) + "),\n"
    f"vtok AS (SELECT unnest({S.word_tokens('text')}) AS token FROM vsplit WHERE is_train = 1),\n"
    f"vfreq AS (SELECT token, count(*) AS freq FROM vtok GROUP BY token HAVING count(*) >= {MIN_FREQ}),\n"
    "vocab AS (SELECT token, CAST(id AS BIGINT) AS id, CAST(freq AS BIGINT) AS freq FROM ("
    + " UNION ALL ".join(f"SELECT {S.lit(t)} AS token, {i} AS id, 0 AS freq" for i, t in enumerate(WORD_SPECIALS))
    + f" UNION ALL SELECT token, row_number() OVER (ORDER BY freq DESC, token) + {len(WORD_SPECIALS) - 1} AS id, freq"
    " FROM vfreq))\n"
)


def sql_vocab_with() -> str:
    return tb.sql_with("train_comments")[:-1] + ",\n" + SQL_VOCAB_CTE


# --- queries ----------------------------------------------------------------
@register(
    "text_clean",
    f"SELECT doc_id, CAST(length(c) AS BIGINT) AS clean_chars, md5(c) AS clean_md5 "
    f"FROM (SELECT doc_id, {S.clean_text('text')} AS c FROM documents)",
)
def text_clean(spark: SparkSession, sf: str) -> DataFrame:
    c = T.clean_text("text")
    docs = tb.table(spark, sf, "documents")
    return docs.select("doc_id", F.char_length(c).cast("long").alias("clean_chars"), F.md5(c).alias("clean_md5"))


@register(
    "text_clean_html",
    tb.sql_with("html_text")
    + f"SELECT page_id, CAST(length(c) AS BIGINT) AS clean_chars, md5(c) AS clean_md5, "
    f"CAST(len({S.word_tokens_html('html')}) AS BIGINT) AS n_tokens "
    f"FROM (SELECT page_id, html, {S.clean_text_html('html')} AS c FROM html_text)",
)
def text_clean_html(spark: SparkSession, sf: str) -> DataFrame:
    c = T.clean_text_html("html")
    return tb.html_text(spark, sf).select(
        "page_id",
        F.char_length(c).cast("long").alias("clean_chars"),
        F.md5(c).alias("clean_md5"),
        F.size(T.word_tokens_html("html")).cast("long").alias("n_tokens"),
    )


@register(
    "tokenize_words",
    f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5, "
    f"t[1] AS first_token FROM (SELECT doc_id, {S.word_tokens('text')} AS t FROM documents)",
)
def tokenize_words(spark: SparkSession, sf: str) -> DataFrame:
    toks = T.word_tokens("text")
    docs = tb.table(spark, sf, "documents")
    return docs.select("doc_id", toks.alias("t")).select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        _digest(F.col("t")).alias("tokens_md5"),
        F.get(F.col("t"), 0).alias("first_token"),
    )


@register(
    "text_clean_unicode",
    f"SELECT doc_id, CAST(length(c) AS BIGINT) AS clean_chars, md5(c) AS clean_md5 "
    f"FROM (SELECT doc_id, {S.clean_unicode('text')} AS c FROM documents)",
)
def text_clean_unicode(spark: SparkSession, sf: str) -> DataFrame:
    c = T.clean_unicode("text")
    docs = tb.table(spark, sf, "documents")
    return docs.select("doc_id", F.char_length(c).cast("long").alias("clean_chars"), F.md5(c).alias("clean_md5"))


@register(
    "text_cjk_space",
    f"SELECT doc_id, CAST(length(c) AS BIGINT) AS spaced_chars, md5(c) AS spaced_md5 "
    f"FROM (SELECT doc_id, {S.cjk_space('text')} AS c FROM documents)",
)
def text_cjk_space(spark: SparkSession, sf: str) -> DataFrame:
    c = T.cjk_space(F.col("text"))
    docs = tb.table(spark, sf, "documents")
    return docs.select("doc_id", F.char_length(c).cast("long").alias("spaced_chars"), F.md5(c).alias("spaced_md5"))


@register(
    "text_strip_accents",
    "SELECT doc_id, CAST(length(c) AS BIGINT) AS plain_chars, md5(c) AS plain_md5 "
    "FROM (SELECT doc_id, strip_accents(text) AS c FROM documents)",
)
def text_strip_accents(spark: SparkSession, sf: str) -> DataFrame:
    docs = tb.table(spark, sf, "documents").select("doc_id", strip_accents(F.col("text")).alias("c"))
    return docs.select("doc_id", F.char_length("c").cast("long").alias("plain_chars"), F.md5("c").alias("plain_md5"))


@register(
    "tokenize_basic",
    f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 "
    f"FROM (SELECT doc_id, {S.basic_tokens('text')} AS t FROM documents)",
)
def tokenize_basic(spark: SparkSession, sf: str) -> DataFrame:
    docs = subword.basic_tokenize(tb.table(spark, sf, "documents").select("doc_id", "text"), "text", "t")
    return docs.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), _digest(F.col("t")).alias("tokens_md5")
    )


@register("vocab_build", sql_vocab_with() + "SELECT token, id, freq FROM vocab")
def vocab_build(spark: SparkSession, sf: str) -> DataFrame:
    return word_vocab(spark, sf)


@register(
    "vocab_topk",
    f"""WITH f AS (SELECT token, count(*) AS freq FROM (SELECT unnest({S.word_tokens('text')}) AS token FROM documents)
        GROUP BY token)
    SELECT token, CAST(freq AS BIGINT) AS freq,
        CAST(row_number() OVER (ORDER BY freq DESC, token) AS BIGINT) AS rank
    FROM f ORDER BY freq DESC, token LIMIT {TOPK}""",
)
def vocab_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = tb.table(spark, sf, "documents").select(T.word_tokens("text").alias("tokens"))
    top = top_tokens(token_frequencies(docs), TOPK)
    # k rows only: the rank comes from a window over the top-k result, not the table
    from pyspark.sql import Window

    return top.select("token", "freq", F.row_number().over(Window.orderBy(F.col("freq").desc(), "token")).cast("long").alias("rank"))


__all__ = ["word_vocab", "vocab_train_tokens", "sql_vocab_with", "sql_split", "hash_order"]


# --- sub-word tokenizer -------------------------------------------------------
PIECE_WORDS = 2000


def basic_docs(spark: SparkSession, sf: str) -> DataFrame:
    return subword.basic_tokenize(tb.table(spark, sf, "documents").select("doc_id", "text"), "text", "tokens").select(
        "doc_id", "tokens"
    )


def piece_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """The sub-word vocabulary fixture built from the basic tokens of all documents."""
    return subword.piece_vocab(basic_docs(spark, sf), "tokens", PIECE_WORDS)


def _sql_piece_vocab() -> str:
    from textloom.operators.vocab import PIECE_SPECIALS

    specials = " UNION ALL ".join(f"SELECT {S.lit(t)} AS token, 0 AS part, {i} AS r" for i, t in enumerate(PIECE_SPECIALS))
    return f"""bt AS (SELECT doc_id, {S.basic_tokens('text')} AS t FROM documents),
    bw AS (SELECT unnest(t) AS word FROM bt),
    bf AS (SELECT word, count(*) AS freq FROM bw GROUP BY word),
    ch AS (SELECT DISTINCT unnest(regexp_extract_all(word, '.')) AS c FROM bf),
    top AS (SELECT word, row_number() OVER (ORDER BY freq DESC, word) AS r FROM bf ORDER BY freq DESC, word LIMIT {PIECE_WORDS}),
    parts AS ({specials}
        UNION ALL SELECT c, 1, 0 FROM ch UNION ALL SELECT '##' || c, 1, 0 FROM ch
        UNION ALL SELECT word, 2, r FROM top
        UNION ALL SELECT DISTINCT '##' || right(word, 3), 3, 0 FROM top),
    firsts AS (SELECT token, min(struct_pack(part := part, r := r)) AS k FROM parts GROUP BY token),
    pv AS (SELECT token, row_number() OVER (ORDER BY k.part, k.r, token) - 1 AS id FROM firsts)"""


def _sql_wordpiece() -> str:
    return f"""WITH RECURSIVE {_sql_piece_vocab()},
    w AS (SELECT DISTINCT word FROM bw),
    s1 AS (SELECT word, unnest(range(length(word))) AS st FROM w WHERE length(word) <= 100),
    s2 AS (SELECT word, st, unnest(range(1, length(word) - st + 1)) AS k FROM s1),
    cand AS (SELECT word, st, k, CASE WHEN st = 0 THEN '' ELSE '##' END || substr(word, st + 1, k) AS p FROM s2),
    best AS (SELECT c.word, c.st, max(c.k) AS k FROM cand c JOIN pv ON pv.token = c.p GROUP BY c.word, c.st),
    steps(word, st, pieces) AS (
        SELECT word, 0, CAST([] AS VARCHAR[]) FROM w WHERE length(word) <= 100
        UNION ALL
        SELECT s.word, s.st + b.k, list_append(s.pieces, CASE WHEN s.st = 0 THEN '' ELSE '##' END || substr(s.word, s.st + 1, b.k))
        FROM steps s JOIN best b ON b.word = s.word AND b.st = s.st
        WHERE s.st < length(s.word)),
    fin AS (SELECT w.word, CASE WHEN x.st = length(w.word) THEN x.pieces ELSE ['[UNK]'] END AS pieces
            FROM w LEFT JOIN (SELECT word, arg_max(pieces, st) AS pieces, max(st) AS st FROM steps GROUP BY word) x
            USING (word)),
    occ AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM bt),
    dp AS (SELECT doc_id, flatten(list(f.pieces ORDER BY pos)) AS pieces FROM occ JOIN fin f USING (word) GROUP BY doc_id),
    res AS (SELECT b.doc_id, coalesce(dp.pieces, CAST([] AS VARCHAR[])) AS pieces FROM bt b LEFT JOIN dp USING (doc_id))
    SELECT doc_id, CAST(len(pieces) AS BIGINT) AS n_pieces,
        CAST(len(list_filter(pieces, lambda p: p = '[UNK]')) AS BIGINT) AS n_unk,
        md5(array_to_string(pieces, ' ')) AS pieces_md5 FROM res"""


@register("tokenize_wordpiece", _sql_wordpiece())
def tokenize_wordpiece(spark: SparkSession, sf: str) -> DataFrame:
    """T12 + T13 + J07: basic tokens -> greedy WordPiece over distinct words -> pieces per document."""
    # basic tokens feed both the sub-word vocabulary and the tokenization: computed
    # once (one pass of the accent UDF) and checkpointed to the shared folder
    docs = materialize(basic_docs(spark, sf))
    vocab = subword.piece_vocab(docs, "tokens", PIECE_WORDS)
    pieces = subword.wordpiece_tokenize(docs, "doc_id", "tokens", vocab, "pieces")
    return pieces.select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"),
        (F.size("pieces") - F.size(F.array_remove("pieces", subword.UNK_TOKEN))).cast("long").alias("n_unk"),
        _digest(F.col("pieces")).alias("pieces_md5"),
    )


@register(
    "src_vocab_file",
    "WITH " + _sql_piece_vocab() + " SELECT token, CAST(id AS BIGINT) AS id FROM pv",
)
def src_vocab_file(spark: SparkSession, sf: str) -> DataFrame:
    """The sub-word vocabulary written one token per line and read back (id = line number)."""
    from textloom.session import scratch_path
    from textloom.sources.files import read_vocab_file, write_lines

    path = scratch_path(spark, "vocab-txt")
    write_lines(materialize(piece_vocab(spark, sf)), "token", "id", path)
    return read_vocab_file(spark, path)
