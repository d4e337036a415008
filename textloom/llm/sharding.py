"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

The rows of one text form a group and stay together, unless the group alone would take
half of a shard: then it is cut into fragments by a hash of the rows' numbers.  A group or fragment is
a vector of its shares of a shard's bytes, tokens and rows, and goes to the shard where
the dot product with the residual capacity is highest.

Large vectors (over 1/200 of a shard in some dimension; their number is bounded by that)
are placed first, in one task.  The others are dealt by hash into runs of bounded
size, each with its part of what room every shard has left, and placed run by run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import read_table, running_sums, words_in, written
from textloom.llm.registry import register

SHARDS = 24
SPLIT_SHARE = 0.5    # of a shard's capacity: larger groups are cut; at most 6 a shard can be
FRAGMENT_SHARE = 0.1
LARGE_SHARE = 0.005
RUN_UNITS = 20_000
ROWS_PER_BUCKET = 20_000
DIMENSIONS = ("bytes", "tokens", "rows")


def place(vectors: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each vector, room left): largest first, each where its dot product with the
    residual capacity is highest, among the shards that hold it if there are any."""
    room = room.copy()
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-vectors.max(axis=1, initial=0), kind="stable").tolist():
        need = vectors[i]
        score = room @ need
        fits = (room >= need).all(axis=1)
        if fits.any() and not fits.all():
            score = np.where(fits, score, -np.inf)
        at = int(score.argmax())
        out[i] = at
        room[at] -= need
    return out, room


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, size (UTF-8 bytes and 8), text_crc32, shard, slot (gapless
    from 0 in its shard, in the order of a hash of the row's number).

    A null text has no bytes and is a group of its own beside the empty text's; ids play no part, so
    null and repeated ones are rows like any; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), F.when(F.col(text_col).isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(F.col(text_col), 256))).alias("group"),
        (F.octet_length(text) + 8).cast("long").alias("bytes"), words_in(text).alias("tokens"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.monotonically_increasing_id()).alias("h")), "shard-rows")
    total = rows.agg(F.sum("bytes"), F.sum("tokens"), F.count("*")).first()
    capacity = [max(1, x or 0) / shards for x in total]
    share = F.greatest(*[F.col(d) / F.lit(c) for d, c in zip(DIMENSIONS, capacity)])
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")]

    groups = written(rows.withColumn("rows", F.lit(1).cast("long")).groupBy("group").agg(*sums), "shard-groups")
    hot = groups.where(share > SPLIT_SHARE).select("group", F.ceil(share / FRAGMENT_SHARE).alias("parts"))
    # at most 3 * shards / SPLIT_SHARE groups can be so large
    units = rows.join(F.broadcast(hot), "group", "left").withColumn(
        "fragment", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("h", F.lit("part")), F.col("parts"))).cast("int")).drop("parts")
    cut = units.join(F.broadcast(hot.select("group")), "group", "left_semi").withColumn("rows", F.lit(1).cast("long")).groupBy("group", "fragment").agg(*sums)
    whole = groups.join(F.broadcast(hot.select("group")), "group", "left_anti").withColumn("fragment", F.lit(0))
    vectors = written(whole.unionByName(cut), "shard-units")

    large = vectors.where(share > LARGE_SHARE)
    small = vectors.where(share <= LARGE_SHARE)
    schema = "group binary, fragment int, shard int"
    scale = np.array(capacity)

    def place_large(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["group", "fragment"])
        at, _ = place(part[list(DIMENSIONS)].to_numpy(float) / scale, np.ones((shards, 3)))
        return part[["group", "fragment"]].assign(shard=at)

    # bounded: at most 3 * shards / LARGE_SHARE vectors are large
    first = written(large.groupBy(F.lit(0).alias("one")).applyInPandas(lambda part: place_large(part), schema), "shard-large")
    used = first.join(large, ["group", "fragment"]).groupBy("shard").agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).collect()  # a row a shard
    room = np.ones((shards, 3))
    for r in used:
        room[r["shard"]] -= np.array([r[d] for d in DIMENSIONS], float) / scale
    rest = small.agg(F.count("*"), *[F.sum(d) for d in DIMENSIONS]).first()
    runs = max(1, -(-rest[0] // RUN_UNITS))
    left = np.array([max(1, x or 0) for x in rest[1:]], float)

    def place_run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["group", "fragment"])
        amounts = part[list(DIMENSIONS)].to_numpy(float)
        mine = room * (amounts.sum(axis=0) / left)  # this run's part of the room
        at, _ = place(amounts / scale, mine)
        return part[["group", "fragment"]].assign(shard=at)

    then = small.withColumn("run", F.pmod(F.xxhash64("group", "fragment"), F.lit(runs))).groupBy("run").applyInPandas(lambda part: place_run(part), schema)
    placed = written(first.unionByName(then), "shard-places")
    buckets = max(1, total[2] // ROWS_PER_BUCKET // shards)
    found = units.join(placed, ["group", "fragment"]).withColumn("one", F.lit(1).cast("long"))
    run = F.floor((F.col("h").cast("double") / float(1 << 63) + 1) / 2 * buckets)
    slotted = running_sums(found.select("doc_id", "h", "group", "bytes", "text_crc32", "shard", "one"), ["shard"],
                           [F.col("h"), F.col("doc_id"), F.col("group")], run, {"slot": "one"})
    return slotted.select("doc_id", F.col("bytes").alias("size"), "text_crc32", "shard", "slot")


@register("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard_rows(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
