"""Centroid clustering with Ptolemaic pivots.

Vectors are integer grids, so distances, sums and means are exact and runs agree.  Each
vector's distances to a few fixed pivots are computed once and stored beside it.  For a
pair of pivots p, s Ptolemy's inequality bounds the distance of a vector x and a centroid c
from below:  |d(x,p) d(c,s) - d(x,s) d(c,p)| / d(p,s).  The centroid with the least bound is
measured exactly; only those whose bound, rounded down by more than any floating error,
doesn't exceed that distance are measured too.

A round reads the stored table once, without a shuffle of vectors: every batch gives a sum per
cluster, and Spark adds these up.  What reaches the driver is `k` centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import drop_written, read_table, written
from textloom.llm.registry import register

CLUSTERS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = 2
PIVOTS = 6             # reference points, of the first centroids; every pair of them gives a bound
LARGEST = 1 << 27      # of a component's grid number: squared distances stay within 63 bits
ROWS_AT_ONCE = 2048
_SLACK = 1e-12         # relative; some thousand times what a bound's few roundings can add up to


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each row to each pivot."""
    out = [np.sqrt(squared(x, np.broadcast_to(p, x.shape)).astype(np.float64)) for p in pivots]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 0))


def choose_pivots(points: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """`n` of `points` far from each other: the first, then always the one farthest from those chosen."""
    if not len(points):
        return points
    chosen = [0]
    near = squared(points, np.broadcast_to(points[0], points.shape))
    while len(chosen) < min(n, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(points, np.broadcast_to(points[chosen[-1]], points.shape)))
    return points[chosen]


def lower_bounds(px: np.ndarray, pc: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For rows with pivot distances `px` and centroids with `pc`: numbers that no distance is below."""
    out = np.zeros((len(px), len(pc)))
    gaps = _to_pivots(pivots, pivots)
    for p, s in combinations(range(len(pivots)), 2):
        one, other = px[:, p, None] * pc[None, :, s], px[:, s, None] * pc[None, :, p]
        bound = (np.abs(one - other) - _SLACK * (one + other)) * ((1 - _SLACK) / gaps[p, s])
        np.maximum(out, bound, out=out)
    return out


def nearest(x: np.ndarray, px: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, squared distance, distances measured) of each row; ties go to the smaller number."""
    bounds = lower_bounds(px, _to_pivots(centroids, pivots), pivots)
    guess = bounds.argmin(axis=1)
    reach = squared(x, centroids[guess])
    row, c = np.nonzero(bounds * bounds * (1 - _SLACK) <= reach[:, None])
    distance = squared(x[row], centroids[c])
    order = np.lexsort((c, distance, row))  # each row's own guess is among what it measures
    first = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))] if len(order) else order
    return c[first], distance[first], np.bincount(row, minlength=len(x))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def grid(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the vectors with exactly `dimensions` components, none null or not finite."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = (F.size("x") == dimensions) & F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float(LARGEST // scale)))
    return rows.where(F.coalesce(F.col("x").isNotNull() & fine, F.lit(False))).select(
        "vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
                    dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, n_pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): one row per kept vector with vec_id, cluster (int), distance (long, squared),
    checked (int, distances measured in the last round), and the final centroids, a row each.

    Components become floor(scale * x).  Centroids start as the `k` vectors with the smallest
    sha256 of `seed:vec_id` (ties by components; null ids come last); a mean is rounded down; a
    centroid without vectors stays where it was.  Vectors that are null, of another length or
    with null or non-finite components are left out, and so are those with a component of
    2**27 / scale or more, whose squared distances no long holds.  Fewer than `k` vectors give so
    many centroids; no vectors give no rows.  Repeated rows count each; other columns are ignored."""
    spark = vectors.sparkSession
    kept = written(grid(vectors, id_col, vector_col, dimensions, scale), "centroid-grid")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.select("v").orderBy(digest.asc_nulls_last(), "v").limit(k).collect()  # k rows
    centroids = np.array([r.v for r in starts], np.int64).reshape(-1, dimensions)
    pivots = choose_pivots(centroids, n_pivots)
    n_pivots = len(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            to = _to_pivots(_matrix(b.column(1), dimensions, np.int64), pivots)
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * n_pivots)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(to.reshape(-1)))], ["vec_id", "v", "to_pivots"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    table = written(kept.mapInArrow(measure, f"vec_id {kind}, v array<bigint>, to_pivots array<double>"), "centroid-table")
    drop_written(kept)

    def found(b: pa.RecordBatch, now: np.ndarray) -> tuple[np.ndarray, ...]:
        x = _matrix(b.column("v"), dimensions, np.int64)
        return x, *nearest(x, _matrix(b.column("to_pivots"), n_pivots, np.float64), now, pivots)

    for _ in range(rounds if len(centroids) else 0):
        now = centroids

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(now), dimensions), np.int64), np.zeros(len(now), np.int64)
            for b in _batches(batches):
                x, c, _, _ = found(b, now)
                order = np.argsort(c, kind="stable")
                present, at = np.unique(c[order], return_index=True)
                if len(present):
                    total[present] += np.add.reduceat(x[order], at, axis=0)
                    count += np.bincount(c, minlength=len(now))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
                                             ["cluster", "n", "total"])

        parts = table.select("v", "to_pivots").mapInArrow(sums, "cluster int, n long, total array<bigint>")
        new = parts.select("cluster", "n", F.posexplode("total").alias("d", "t")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        centroids = now.copy()
        for r in new.collect():  # k * dimensions numbers
            centroids[r.cluster, r.d] = r.t // r.n

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            _, c, distance, checked = found(b, centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(c, pa.int32()), pa.array(distance, pa.int64()), pa.array(checked, pa.int32())],
                                             ["vec_id", "cluster", "distance", "checked"])

    out = written(table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long, checked int"), "centroid-rows")
    drop_written(table)
    return out, centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`rows` of `cluster_vectors` with cluster_inertia, inertia and centroid_sha256 (of the
    centroid's components in decimal, comma-joined)."""
    spark = rows.sparkSession
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row per centroid
    total = sum(r.s for r in per)
    known = [(r.cluster, r.s, total, ",".join(map(str, centroids[r.cluster].tolist()))) for r in per]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, components string")
    facts = facts.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(facts), "cluster")  # one row per centroid


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    parts = [f"""
WITH fine AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMENSIONS}
    AND vec_id NOT IN (SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x IS NULL OR NOT isfinite(x))),
comp AS MATERIALIZED (
  SELECT vec_id, d, floor({SCALE} * x::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM fine)),
starts AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR)) - 1 AS c
  FROM fine ORDER BY 2 LIMIT {k}),
cent0 AS MATERIALIZED (SELECT c, d, x FROM starts JOIN comp USING (vec_id))"""]
    for r in range(rounds + 1):
        parts.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, c, dist FROM (
    SELECT vec_id, c, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) AS place FROM (
      SELECT a.vec_id, b.c, sum((a.x - b.x) * (a.x - b.x)) AS dist FROM comp a JOIN cent{r} b USING (d) GROUP BY ALL)) WHERE place = 1)""")
        if r < rounds:
            parts.append(f"""cent{r + 1} AS MATERIALIZED (
  SELECT b.c, b.d, coalesce(m.x, b.x) AS x FROM cent{r} b LEFT JOIN (
    SELECT c, d, (s - ((s % n) + n) % n) // n AS x FROM (
      SELECT c, d, sum(x) AS s, count(*) AS n FROM near{r} JOIN comp USING (vec_id) GROUP BY ALL)) m USING (c, d))""")
    return ",\n".join(parts) + f"""
SELECT n.vec_id, n.c::INTEGER AS cluster, n.dist::BIGINT AS distance,
  (sum(n.dist) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(n.dist) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM near{rounds} n JOIN (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM cent{rounds} GROUP BY c) h USING (c)
"""


@register("op11_centroid_clustering", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster_vectors(read_table(spark, sf_dir, "embeddings"))
    return with_inertia(rows, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
