"""Line dedup by content-defined chunks of lines.  DataFrame functions only.

Every line is hashed and a polynomial hash rolls over `WINDOW` line hashes.  Windows of one, two
and three lines are counted over the whole table.  Chunks end

- where a window's count changes to the next one's: there a shared passage begins or ends, so
  a passage of two or more lines is cut out of whatever lines stand around it;
- where two windows recur but their union does less: there two passages meet in one line;
- where the rolling hash is a local minimum and the counts around it are equal, so long
  passages are cut alike whatever lies beyond their ends.

A passage's first line that is commoner than its first window is not counted to the passage: it
may as well end another one.  All three rules look at the lines around a place and at corpus
counts of them, so equal passages are cut alike.

Chunks of two or more lines that hold a word and occur more than once in the whole
table are removed, all but the first one (by id, then text hash, then place).
Occurrences are matched by 128 bits of hash; the bytes are compared too, by grouping on
the chunk itself: if a hash stands for two different chunks, none of them is removed.

Shuffles: each distinct text once, into a bucketed table; the text of chunks that recur; and
narrow rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import drop_written, fresh, read_table, written
from textloom.llm.registry import register
from textloom.llm.texts import DistinctTexts, text_key

WINDOW = 2           # lines in the rolling hash
BASE = 1_000_003     # of its polynomial
PRIME = 2_147_483_647
MIN_LINES = 2        # of a chunk that may be removed


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _rolling(hashes: Column) -> Column:
    def at(x: Column, i: Column) -> Column:
        total = x
        for back in range(1, WINDOW):
            total = (F.when(i >= back, F.get(hashes, i - back)).otherwise(F.lit(0)) * F.lit(BASE) + total) % F.lit(PRIME)
        return total

    return F.transform(hashes, at)


def _windows(lines: Column) -> Column:
    """array<struct<i, r, k1, k2, k3>>: the rolling hash at each line and the keys of the windows that begin there."""
    def rows(own: Column, rolled: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            then, third = F.get(own, i + 1), F.get(own, i + 2)
            return F.struct(i.alias("i"), F.get(rolled, i).alias("r"), F.xxhash64(F.lit(1), x).alias("k1"),
                            F.when(then.isNotNull(), F.xxhash64(F.lit(2), x, then)).alias("k2"),
                            F.when(third.isNotNull(), F.xxhash64(F.lit(3), x, then, third)).alias("k3"))

        return F.transform(own, one)

    return _let(lines, lambda held: _let(F.transform(held, lambda x: F.xxhash64(x)), lambda own: _let(
        _let(F.transform(held, _line_hash), _rolling), lambda rolled: rows(own, rolled))))


def chunk_starts(texts: DataFrame) -> DataFrame:
    """(t1, t2, starts array<int>, n_lines) of distinct `texts` (t1, t2, text, copies)."""
    lines = written(texts.select("t1", "t2", "copies", F.explode(_windows(_lines(F.col("text")))).alias("w")).select("t1", "t2", "copies", "w.*"), "line-windows")
    level = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"k{n}").alias("key")) for n in (1, 2, 3)])).alias("e")
    filed = lines.select("t1", "t2", "i", "copies", level).select("t1", "t2", "i", "copies", "e.*").where(F.col("key").isNotNull())
    counts = filed.groupBy("key").agg(F.sum("copies").alias("c")).where("c > 1")
    known = filed.join(counts, "key").select("t1", "t2", "i", "level", "c", F.lit(None).cast("long").alias("r"))
    # windows that are not counted more than once occur once; the last line begins no window of two
    plain = lines.select("t1", "t2", "i", F.lit(0).alias("level"), F.when(F.col("k2").isNotNull(), 1).otherwise(0).cast("long").alias("c"), "r")
    rows = known.unionByName(plain).repartition("t1", "t2").groupBy("t1", "t2", "i").agg(
        F.max("r").alias("r"), F.coalesce(F.max(F.when(F.col("level") == 1, F.col("c"))), F.lit(1)).alias("one"),
        F.max(F.when(F.col("level").isin(0, 2), F.col("c"))).alias("two"),
        F.coalesce(F.max(F.when(F.col("level") == 3, F.col("c"))), F.lit(1)).alias("three"))
    w = Window.partitionBy("t1", "t2").orderBy("i")
    two = lambda back: F.lag("two", back, 0).over(w)
    begins = (two(1) < F.col("two")) & (F.col("two") > 1) & (F.col("one") == F.col("two"))
    ends = (two(2) > two(1)) | ((two(2) == two(1)) & (two(1) > 1) & (F.lag("three", 2, 0).over(w) < two(1))) | (
        (two(2) < two(1)) & (two(1) > 1) & (F.lag("one", 1, 0).over(w) > two(1)))
    r = lambda back: F.lag("r", back).over(w)
    even = (two(3) == two(2)) & (two(2) == two(1)) & (two(1) == F.col("two"))
    least = F.coalesce((r(1) < r(2)) & (r(1) <= F.col("r")), F.lit(False)) & even
    marked = rows.select("t1", "t2", "i", ((F.col("i") == 0) | begins | ends | least).alias("opens"))
    out = written(marked.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.when(F.col("opens"), F.col("i")))).alias("starts"),
                                                 F.count("*").alias("n_lines")), "line-starts")
    drop_written(lines)
    return out


def chunks_of(text: Column, starts: Column) -> Column:
    """array<struct<idx int, lines int, body string>>: the chunks of a text, which joined with \\n give it back."""

    def cut(lines: Column, starts: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            upto = F.when(k + 1 < F.size(starts), F.get(starts, k + 1)).otherwise(F.size(lines))
            return F.struct(k.alias("idx"), (upto - s).alias("lines"), F.array_join(F.slice(lines, s + 1, upto - s), "\n").alias("body"))

        return F.transform(starts, one)

    return _let(_lines(text), lambda lines: _let(starts, lambda at: cut(lines, at)))


def repeated_chunks(texts: DistinctTexts, starts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(t1, t2, idx, lines, first): the chunks that occur more than once in the table, `first` for the
    occurrence that stays.  `firsts` has a place that orders texts for each."""
    cut = texts.all().join(starts, ["t1", "t2"])
    chunks = cut.select("t1", "t2", "copies", F.explode(chunks_of(F.col("text"), F.col("starts"))).alias("c")).where(
        (F.col("c.lines") >= MIN_LINES) & F.col("c.body").rlike(r"[^\x20\x09-\x0D]"))
    hashed = chunks.select("t1", "t2", "copies", "c.idx", "c.lines", F.xxhash64("c.body").alias("h1"), F.xxhash64(F.lit(9), "c.body").alias("h2"))
    narrow = written(hashed.join(firsts, ["t1", "t2"]).withColumn("place", F.struct("place", "idx")), "line-chunks")
    times = narrow.groupBy("h1", "h2").agg(F.sum("copies").alias("times"), F.count("*").alias("places"), F.min("place").alias("first")).where("times > 1")
    found = written(narrow.drop("copies").join(times, ["h1", "h2"]), "line-repeats")
    asked = texts.asked(found.where("places > 1"), ["idx", "h1", "h2"]).join(starts, ["t1", "t2"])
    bodies = asked.select(F.explode(_let(chunks_of(F.col("text"), F.col("starts")), lambda cs: F.transform("asks", lambda a: F.struct(
        a["h1"].alias("h1"), a["h2"].alias("h2"), F.get(cs, a["idx"])["body"].alias("body"))))).alias("b")).select("b.*")
    clash = bodies.distinct().groupBy("h1", "h2").agg(F.count("*").alias("texts")).where("texts > 1").select("h1", "h2")
    out = written(found.join(clash, ["h1", "h2"], "left_anti").select("t1", "t2", "idx", "lines", (F.col("place") == F.col("first")).alias("first")), "line-removals")
    drop_written(narrow), drop_written(found)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stats: bool = False) -> DataFrame:
    """`docs` with repeated chunks removed from its texts; with `stats` also n_lines, n_chunks,
    removed_chunks and removed_lines.

    Every row stays, also if nothing is left of its text (then empty).  A null text stays null
    and has no lines to lose; ids may be null and may repeat: of rows with equal texts one
    (the smallest id, nulls last, any of equal ones) counts as the first; an empty table gives an
    empty one; other columns pass through, whatever their names."""
    others = [c for c in docs.columns if c != text_col]
    held = F.struct(*[F.col(c) for c in others]).alias("held")  # so no name of theirs can clash
    rows = written(docs.select(held, F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none"), *text_key(F.col(text_col)),
                               F.monotonically_increasing_id().alias("row")), "line-rows")
    own = F.col(text_col)
    texts = DistinctTexts(docs.where(own.isNotNull()), own, F.lit(True))
    starts = chunk_starts(texts.all())
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    firsts = written(rows.where(~F.col("none")).groupBy("t1", "t2").agg(first), "line-firsts")
    places = firsts.select("t1", "t2", F.struct("first.no_id", "first.id", "t1", "t2").alias("place"))
    gone = repeated_chunks(texts, starts, places)
    lost = gone.groupBy("t1", "t2").agg(
        F.collect_list("idx").alias("all_gone"), F.sum("lines").alias("all_lines"),
        F.collect_list(F.when(~F.col("first"), F.col("idx"))).alias("own_gone"), F.sum(F.when(~F.col("first"), F.col("lines"))).alias("own_lines"))
    plan = starts.join(lost, ["t1", "t2"], "left")

    def left(out: Column) -> Column:
        kept = F.filter(chunks_of(F.col("text"), F.col("starts")), lambda c: ~F.array_contains(out, c["idx"]))
        return F.when(F.coalesce(F.size(out), F.lit(0)) == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda c: c["body"]), "\n"))

    def numbers(which: str) -> list[Column]:
        return [F.col("n_lines").cast("long").alias("n_lines"), F.size("starts").cast("long").alias("n_chunks"),
                F.greatest(F.coalesce(F.size(f"{which}_gone"), F.lit(0)), F.lit(0)).cast("long").alias("removed_chunks"),
                F.coalesce(F.col(f"{which}_lines"), F.lit(0)).cast("long").alias("removed_lines")]

    cut = texts.all().join(plan, ["t1", "t2"])
    again = written(cut.where("copies > 1").select("t1", "t2", left(F.col("all_gone")).alias("text"), *numbers("all")), "line-copies")
    # one row of each text is its first and meets it in the text's bucket; rows with equal texts meet a short rest
    split = rows.where(~F.col("none")).join(firsts.select(F.col("first.row").alias("row"), F.lit(True).alias("is_first")), "row", "left")
    one = split.where("is_first").select("held", "t1", "t2").join(
        cut.select("t1", "t2", left(F.col("own_gone")).alias("text"), *numbers("own")), ["t1", "t2"])
    more = split.where(F.col("is_first").isNull()).select("held", "t1", "t2").join(again, ["t1", "t2"])
    zero = [F.lit(0).cast("long").alias(n) for n in ("n_lines", "n_chunks", "removed_chunks", "removed_lines")]
    none = rows.where("none").select("held", "t1", "t2", F.lit(None).cast("string").alias("text"), *zero)
    result = one.unionByName(more).unionByName(none)
    texts.forget()
    extra = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"] if stats else []
    return result.select(*[F.col("text").alias(c) if c == text_col else F.col("held").getField(c).alias(c) for c in docs.columns], *extra)


SQL = r"""
WITH lines AS (
  SELECT doc_id, text AS whole, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h,
             lead(line) OVER w AS line2, lead(line, 2) OVER w AS line3 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
counted AS (SELECT *, (coalesce(lag(h) OVER w, 0) * 1000003 + h) % 2147483647 AS r,
              count(*) OVER (PARTITION BY line) AS c1,
              CASE WHEN line2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY line, line2) END AS c2,
              CASE WHEN line3 IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY line, line2, line3) END AS c3
            FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
near AS (SELECT *, lag(c2, 1, 0) OVER w AS p1, lag(c2, 2, 0) OVER w AS p2, lag(c2, 3, 0) OVER w AS p3,
           lag(c1, 1, 0) OVER w AS own1, lag(c3, 2, 0) OVER w AS three2, lag(r, 1) OVER w AS r1, lag(r, 2) OVER w AS r2
         FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
marked AS (SELECT *, CASE WHEN i = 0 OR (p1 < c2 AND c2 > 1 AND c1 = c2) OR p2 > p1
             OR (p2 = p1 AND p1 > 1 AND three2 < p1) OR (p2 < p1 AND p1 > 1 AND own1 > p1)
             OR coalesce(r1 < r2 AND r1 <= r, false) AND p3 = p2 AND p2 = p1 AND p1 = c2 THEN 1 ELSE 0 END AS opens FROM near),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx FROM marked),
chunks AS (SELECT doc_id, idx, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, idx),
ranked AS (SELECT *, lines >= 2 AND regexp_matches(body, '[^\x20\x09-\x0D]')
             AND row_number() OVER (PARTITION BY body ORDER BY doc_id, idx) > 1 AS gone FROM chunks),
per AS (SELECT doc_id, sum(lines)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS removed_chunks,
          coalesce(sum(lines) FILTER (WHERE gone), 0)::BIGINT AS removed_lines,
          coalesce(string_agg(body, chr(10) ORDER BY idx) FILTER (WHERE NOT gone), '') AS text FROM ranked GROUP BY doc_id)
SELECT d.doc_id, per.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks,
  coalesce(removed_chunks, 0) AS removed_chunks, coalesce(removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN per USING (doc_id)
"""


@register("op9_line_dedup", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, stats=True)
