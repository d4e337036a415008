"""Metric-history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.history import best_checkpoint, early_stop
from textloom.plans.registry import register
from textloom.sources import tables as tb

PATIENCE = 5
DELTA_MODE, DELTA_PATIENCE, DELTA_PCT = "max", 4, 2.0


@register(
    "history_best",
    tb.sql_with("history")
    + """SELECT run, CAST(count(*) AS BIGINT) AS n_epochs,
        CAST(arg_min(epoch, struct_pack(m := metric, e := epoch)) AS BIGINT) AS best_epoch,
        round(min(metric), 6) AS best_metric
    FROM history GROUP BY run""",
)
def history_best(spark: SparkSession, sf: str) -> DataFrame:
    """Best checkpoint = lowest metric, earliest epoch on ties."""
    r = best_checkpoint(tb.history(spark, sf))
    return r.select("run", "n_epochs", "best_epoch", F.round("best_metric", 6).alias("best_metric"))


@register(
    "history_early_stop",
    tb.sql_with("history")
    + f""", p AS (SELECT *, first_value(metric) OVER (PARTITION BY run ORDER BY epoch) AS m0,
            min(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm,
            min(metric) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS cm FROM history),
    i AS (SELECT *, CASE WHEN epoch = 0 OR (NOT isnan(m0) AND metric < pm) THEN epoch END AS imp FROM p),
    l AS (SELECT *, max(imp) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS li FROM i),
    s AS (SELECT run, min(epoch) AS stop_epoch FROM l
          WHERE epoch >= 1 AND (isnan(metric) OR epoch - li >= {PATIENCE}) GROUP BY run),
    e AS (SELECT run, count(*) AS n_epochs, max(epoch) AS last_epoch FROM history GROUP BY run)
    SELECT e.run, CAST(e.n_epochs AS BIGINT) AS n_epochs, CAST(s.stop_epoch AS BIGINT) AS stop_epoch,
        CAST(l.li AS BIGINT) AS best_epoch, round(CASE WHEN isnan(l.m0) THEN l.m0 ELSE l.cm END, 6) AS best_metric
    FROM e LEFT JOIN s USING (run) JOIN l ON l.run = e.run AND l.epoch = coalesce(s.stop_epoch, e.last_epoch)""",
)
def history_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """W04 (min mode, min_delta 0, patience 5): parallel scan form."""
    r = early_stop(tb.history(spark, sf), "min", PATIENCE)
    return r.select("run", "n_epochs", "stop_epoch", "best_epoch", F.round("best_metric", 6).alias("best_metric"))


@register(
    "history_early_stop_delta",
    tb.sql_with("history").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", f(run, epoch, best, best_epoch, bad, stop) AS (
        SELECT run, epoch, metric, epoch, 0, CAST(NULL AS BIGINT) FROM history WHERE epoch = 0
        UNION ALL
        SELECT f.run, h.epoch,
            CASE WHEN isnan(h.metric) THEN f.best WHEN (NOT isnan(f.best) AND h.metric > f.best + {DELTA_PCT} * f.best / 100.0) THEN h.metric ELSE f.best END,
            CASE WHEN isnan(h.metric) THEN f.best_epoch WHEN (NOT isnan(f.best) AND h.metric > f.best + {DELTA_PCT} * f.best / 100.0) THEN h.epoch ELSE f.best_epoch END,
            CASE WHEN isnan(h.metric) THEN f.bad WHEN (NOT isnan(f.best) AND h.metric > f.best + {DELTA_PCT} * f.best / 100.0) THEN 0 ELSE f.bad + 1 END,
            CASE WHEN isnan(h.metric) THEN h.epoch WHEN (NOT isnan(f.best) AND h.metric > f.best + {DELTA_PCT} * f.best / 100.0) THEN NULL
                 WHEN f.bad + 1 >= {DELTA_PATIENCE} THEN h.epoch ELSE NULL END
        FROM f JOIN history h ON h.run = f.run AND h.epoch = f.epoch + 1
        WHERE f.stop IS NULL),
    last AS (SELECT run, arg_max(struct_pack(s := stop, be := best_epoch, b := best), epoch) AS st FROM f GROUP BY run),
    e AS (SELECT run, count(*) AS n_epochs FROM history GROUP BY run)
    SELECT run, CAST(n_epochs AS BIGINT) AS n_epochs, CAST(st.s AS BIGINT) AS stop_epoch,
        CAST(st.be AS BIGINT) AS best_epoch, round(st.b, 6) AS best_metric FROM e JOIN last USING (run)""",
)
def history_early_stop_delta(spark: SparkSession, sf: str) -> DataFrame:
    """W04 (max mode, min_delta 2 % of best, patience 4): sequential fold per run."""
    r = early_stop(tb.history(spark, sf), DELTA_MODE, DELTA_PATIENCE, DELTA_PCT, percentage=True)
    return r.select("run", "n_epochs", "stop_epoch", "best_epoch", F.round("best_metric", 6).alias("best_metric"))
