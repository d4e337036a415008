"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, gone through as often as
the repeat limit allows.  A document's virtual finish time is the number of its source's
words up to and with it, divided by the source's target, so all sources reach time 1
together.  The copies of all sources are range-sorted by that time and cut off at the
total budget; the copy that crosses it is the last one and gives its first words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import fresh, read_table, running_sums, words_in, written
from textloom.llm.registry import register

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
SEED = 42
ROWS_PER_BUCKET = 4_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target): targets share `share` of all sizes by weight (sources by code
    point, null last, take `weights` in turn); what a source can't give in `max_repeats`
    rounds is reshared by weight among the others until no target is too large.

    `sizes` has source, size.  Solved by water-filling: with sources ordered by size per
    weight, those up to some place are full and the others share the rest by weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("longest"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", (F.lit(max_repeats) * F.col("source_size")).cast("double"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source"))
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    sharing = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    # the level if all earlier sources are full rises up to the first one that isn't, and falls from there
    level = F.when(sharing > 0, left / sharing).otherwise(F.lit(0.0))
    return per.withColumn("level", level).withColumn("water", F.max("level").over(everything)).select(
        "source", "source_size", "longest", F.least(F.col("limit"), F.col("water") * F.col("weight")).alias("target"))


def _shuffled(seed: int, doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text_hash)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE, max_repeats: int = MAX_REPEATS,
             seed: int = SEED) -> DataFrame:
    """One row per row of `docs`: doc_id, th (xxhash64 of the text), source, size, source_size,
    target, and takes array<struct<copy, words, finish>>: the copies the mix takes, in rounds.

    Null texts have size 0 and no words to take; a null source is a source of its own, the last;
    rows that repeat an id and a text are taken in any order among themselves; a source of
    size 0 has target 0; an empty table gives no rows; other columns are ignored."""
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"),
                               F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")), "mix-sizes")
    targets = written(source_targets(rows, weights, share, max_repeats), "mix-targets")
    buckets = max(1, rows.count() // ROWS_PER_BUCKET)
    rows = rows.withColumn("turn", _shuffled(seed, F.col("doc_id"), F.col("th")))
    order = [F.col("turn"), F.col("doc_id"), F.col("th")]
    # the upper bits of the shuffle hash cut each queue into runs of bounded length
    run = F.floor((F.shiftrightunsigned("turn", 33).cast("double") / float(1 << 31)) * buckets)
    run = F.when(F.col("turn") >= 0, run).otherwise(run - buckets)
    queued = running_sums(rows, ["source"], order, run, {"before": "size"})
    queued = queued.join(targets.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    rounds = F.explode(F.sequence(F.lit(1), F.lit(max_repeats)))
    copies = written(queued.withColumn("copy", rounds).withColumn(
        "upto", F.col("before") + F.col("size") + (F.col("copy") - 1) * F.col("source_size")).withColumn(
        "finish", F.when(F.col("target") > 0, F.col("upto") / F.col("target")).otherwise(F.lit(float("inf")))), "mix-copies")
    total, late = targets.agg(F.sum("target"), F.max(F.when(F.col("target") > 0, F.col("longest") / F.col("target")))).first()
    budget, last = round(total or 0), 1 + (late or 0.0)
    # when time `last` is reached every source has given its target, so no later copy is taken
    place = [F.col("finish"), F.col("source").isNull(), F.col("source"), F.col("turn"), F.col("doc_id"), F.col("th"), F.col("copy")]
    near = copies.where(F.col("finish") <= last).withColumn("all", F.lit(1))
    spent = running_sums(near, ["all"], place, F.floor(F.col("finish") * F.lit(buckets)), {"spent": "size"}).drop("all")
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("spent")))
    taken = spent.withColumn("words", words).drop("spent").unionByName(
        copies.where(F.col("finish") > last).withColumn("words", F.lit(0).cast("long")))
    return taken.groupBy("doc_id", "th", "source", "size", "source_size", "target", "turn", "before").agg(
        F.collect_list(F.when(F.col("words") > 0, F.struct("copy", "words", "finish"))).alias("takes"),
        F.count("*").alias("copies")).withColumn(  # equal rows without words meet in one group
        "row", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("copies") / max_repeats).cast("long")))).drop("turn", "before", "copies", "row")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixture: a row of `docs` for every copy that is taken, cut to its first words where the
    budget ends; columns as in `docs`.  Rows equal in id, source and text share out their copies."""
    key, th, take, rank = (fresh(docs, n) for n in ("mix_key", "mix_hash", "mix_take", "mix_rank"))
    plan = mix_plan(docs, id_col, source_col, text_col, **options).groupBy("doc_id", "th", "source", "size").agg(
        F.flatten(F.collect_list("takes")).alias("takes"), F.count("*").alias("rows")).where(F.size("takes") > 0)
    plan = plan.select(F.struct("doc_id", "th", "source", "size", "takes", "rows").alias(key))
    base = docs.withColumn(th, F.xxhash64(F.col(text_col)))
    joined = base.join(plan, F.col(id_col).eqNullSafe(F.col(f"{key}.doc_id")) & F.col(source_col).eqNullSafe(F.col(f"{key}.source"))
                       & (F.col(th) == F.col(f"{key}.th")))
    takes = F.col(f"{key}.takes")
    alone = joined.where(F.col(f"{key}.rows") == 1).withColumn(take, F.explode(takes))
    equal = joined.where(F.col(f"{key}.rows") > 1).withColumn(rank, F.row_number().over(
        Window.partitionBy(id_col, source_col, th).orderBy(F.lit(0))))
    equal = equal.withColumn(take, F.explode(F.filter(takes, lambda t, i: i % F.col(f"{key}.rows") == F.col(rank) - 1))).drop(rank)
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1),
                                 F.col(f"{take}.words").cast("int")), " ")
    text = F.when(F.col(f"{take}.words") >= F.col(f"{key}.size"), F.col(text_col)).otherwise(first)
    return alone.unionByName(equal).select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


@register("op5_source_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target",
                       F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"]).alias("taken"))
