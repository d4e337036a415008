"""Plan checks over every registered query: no row-at-a-time Python UDF, no nested-loop or
cartesian join, and Arrow UDFs only where Spark has no primitive.  Plans that end in a checkpoint are looked at too."""

from __future__ import annotations

import pytest
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as E
from conftest import SF_SMALL

QUERIES = E.queries()
# accents of texts that aren't ASCII, and a user's own model, are the only Arrow UDFs of the registered queries
ARROW_ALLOWED = {"score_batch_model", "text_strip_accents", "tokenize_basic", "tokenize_wordpiece", "src_vocab_file", "encode_wordpiece_single", "encode_wordpiece_pair"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name, monkeypatch):
    plans, checkpoint = [], DataFrame.checkpoint

    def seen(df, *args, **kwargs):
        plans.append(_plan(df))
        return checkpoint(df, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "checkpoint", seen)
    plans.append(_plan(QUERIES[name](spark, SF_SMALL)))
    for plan in plans:
        for bad in ("BatchEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct"):
            assert bad not in plan, f"{name}: {bad}"
        if name not in ARROW_ALLOWED:
            assert "ArrowEvalPython" not in plan, name
