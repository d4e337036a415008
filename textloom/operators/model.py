"""Per-label classifiers with Spark ML.

Binary relevance: features are built once (hashing TF + IDF over word tokens)
and persisted, then one `LogisticRegression` per label is fitted over the
shared features; fits are submitted from a small thread pool so the label
jobs run concurrently.  Scoring is `model.transform` (JVM), long output.
The optimiser's per-iteration objective becomes a metric-history table for
the best-checkpoint / early-stopping operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feature_pipeline(tokens: str = "tokens", num_features: int = 1 << 18, min_doc_freq: int = 1) -> Pipeline:
    return Pipeline(stages=[
        HashingTF(inputCol=tokens, outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features", minDocFreq=min_doc_freq),
    ])


def fit_features(train: DataFrame, tokens: str = "tokens", num_features: int = 1 << 18) -> PipelineModel:
    return feature_pipeline(tokens, num_features).fit(train)


def fit_per_label(train: DataFrame, labels: Sequence[str], features: str = "features", pos_weight: float | None = None,
                  max_iter: int = 20, reg: float = 0.01, parallelism: int = 4) -> dict[str, LogisticRegressionModel]:
    """One logistic regression per label over the same (persisted) features."""
    data = train.select(features, *labels).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(label: str) -> tuple[str, LogisticRegressionModel]:
        d = data.withColumn("__y", F.col(label).cast("double"))
        kw = {}
        if pos_weight is not None:
            d = d.withColumn("__w", F.when(F.col("__y") == 1.0, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))
            kw["weightCol"] = "__w"
        lr = LogisticRegression(featuresCol=features, labelCol="__y", maxIter=max_iter, regParam=reg, **kw)
        return label, lr.fit(d)

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            return dict(pool.map(fit, labels))
    finally:
        data.unpersist()


def score_per_label(models: dict[str, LogisticRegressionModel], df: DataFrame, key: str,
                    features: str = "features") -> DataFrame:
    """Long `(key, label, logit, prob)` for every row and label."""
    wide, found = df.select(key, features), []
    for i, (label, m) in enumerate(models.items()):  # every model adds its columns to the one pass
        raw, prob = f"__raw{i}", f"__prob{i}"
        wide = m.copy().setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol("").transform(wide)
        found.append(F.struct(F.lit(label).alias("label"), F.get(vector_to_array(raw), 1).alias("logit"),
                              F.get(vector_to_array(prob), 1).alias("prob")))
    return wide.select(key, F.explode(F.array(*found)).alias("__s")).select(key, "__s.*")


def objective_history(spark: SparkSession, models: dict[str, LogisticRegressionModel]) -> DataFrame:
    """K04 history part: the optimiser's objective per iteration as `(run, epoch, metric)`
    (bounded by maxIter per label)."""
    rows = [(label, i, float(v)) for label, m in models.items() for i, v in enumerate(m.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "run string, epoch long, metric double")


def save_models(models: dict[str, LogisticRegressionModel], path: str) -> None:
    """One model folder per label under `path` (no shared, overwritten save path)."""
    for label, m in models.items():
        m.write().overwrite().save(f"{path}/{label}")


def load_models(path: str, labels: Sequence[str]) -> dict[str, LogisticRegressionModel]:
    """Load the per-label models saved by `save_models`."""
    return {label: LogisticRegressionModel.load(f"{path}/{label}") for label in labels}
