"""Deterministic splits, batches, shards and samples.

Random order is `md5(key:seed)` with the key as tie-breaker, the same rule in
Spark and in SQL, so a split is exactly reproducible anywhere.  Exact sizes
come from exact ranks, not from `randomSplit` (whose sizes vary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.rank import exact_rank, hash_prefix_bucket, with_quantile_bucket


def hash_order(key: str, seed) -> Column:
    """Hex digest that defines the seeded random order of rows."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.lit(str(seed))))


def random_rank(df: DataFrame, key: str, seed, out: str = "rank", total: str | None = None) -> DataFrame:
    """Exact 1-based rank in seeded random order; 4,096 hash-prefix buckets."""
    h = hash_order(key, seed)
    d = df.withColumn("__h", h)
    return exact_rank(d, hash_prefix_bucket(F.col("__h"), 3), ["__h", key], out, total).drop("__h")


def split_exact(df: DataFrame, key: str, seed=23, train_ratio: float | None = 0.7,
                test_ratio: float | None = None) -> DataFrame:
    """Add `is_train` (1/0) with an exact train size.

    `train_ratio`: train = round-half-even(r * N) (a ratio split).
    `test_ratio`: test = ceil(r * N) (a test-size split); train is the rest.
    """
    r = random_rank(df, key, seed, "__rank", total="__n")
    n = F.col("__n")
    if test_ratio is not None:
        n_train = n - F.ceil(F.lit(float(test_ratio)) * n)
    else:
        n_train = F.bround(F.lit(float(train_ratio)) * n, 0)
    return r.withColumn("is_train", (F.col("__rank") <= n_train).cast("int")).drop("__rank", "__n")


def ordered_rank(df: DataFrame, key: str, out: str = "rank", n_buckets: int | None = None, total: str | None = None) -> DataFrame:
    """Exact rank along a numeric or string key with quantile buckets, as many as the rows ask for (balanced for unique keys)."""
    d, _ = with_quantile_bucket(df, key, "__qb", n_buckets)
    return exact_rank(d, F.col("__qb"), [key], out, total).drop("__qb")


def batch_assign(df: DataFrame, key: str, batch_size: int, seed=None, epoch: int = 0) -> DataFrame:
    """`batch_id = floor((rank - 1) / batch_size)`; last batch short.

    Sequential order by `key` when `seed` is None, otherwise the seeded
    shuffle order of that epoch.
    """
    if seed is None:
        r = ordered_rank(df, key, "__rank")
    else:
        r = random_rank(df, key, f"{seed}:{epoch}", "__rank")
    return r.withColumn("batch_id", F.floor((F.col("__rank") - 1) / F.lit(batch_size)).cast("long")).drop("__rank")


def shard_assign(df: DataFrame, key: str, world_size: int, seed=None, even: bool = False) -> DataFrame:
    """Replica shard `pmod(rank - 1, world_size)` (round-robin, as a distributed sampler).

    `even=True` gives every shard the same number of rows, as replicas that step together need: the order is
    followed again from its start until the count is a multiple of `world_size`, so its first rows come twice (or
    more often, if there are fewer rows than shards)."""
    total = "__n" if even else None
    r = ordered_rank(df, key, "__rank", total=total) if seed is None else random_rank(df, key, seed, "__rank", total)
    place = F.col("__rank") - 1
    if even:
        full = F.ceil(F.col("__n") / world_size) * world_size
        again = F.sequence(F.lit(0), F.floor((full - F.col("__rank")) / F.col("__n")).cast("int"))
        r = r.withColumn("__again", F.explode(again))
        place = place + F.col("__again") * F.col("__n")
    return r.withColumn("shard", F.pmod(place, F.lit(world_size)).cast("long")).drop("__rank", "__n", "__again")


def sample_n(df: DataFrame, key: str, n: int, seed=0) -> DataFrame:
    """Exactly n rows without replacement in seeded random order (n = -1: all rows)."""
    if n < 0:
        return df
    return df.withColumn("__h", hash_order(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def split_labeled(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Labelled part (inner join) and unlabelled part (left anti join)."""
    return docs.join(labels, key), docs.join(labels.select(key), key, "left_anti")
