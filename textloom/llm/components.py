"""Connected components of a link table, by large-star / small-star rounds.

Before the rounds each partition reduces its own links to a spanning forest,
so a dense group of copies shrinks to one link per member before it moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_written, written

FOREST_LINKS = 500_000  # links that a task reduces at a time; bounds its memory


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    n = 0

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
        n += batch.num_rows
        if n >= FOREST_LINKS:
            yield out()
            parent.clear()
            n = 0
    if parent:
        yield out()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable.  `links` has longs a, b;
    nodes without a link don't occur.  Raises if the rounds don't settle."""
    edges = written(links.select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), "links")
    before = None
    for _ in range(rounds):
        # large star: a node's larger neighbours go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.join(least, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a")
                 .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        after = written(small, "links")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(edges)
        edges = after
        if before == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
