"""A user's model called on whole batches.

The factory runs once in every Python worker (it may load weights) and returns a function
from a batch to its outputs; Spark feeds it Arrow batches of fixed-length features.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

Factory = Callable[[], Callable[..., np.ndarray]]


def score_batches(df: DataFrame, key: Sequence[str], inputs: dict[str, int], factory: Factory, outputs: Sequence[str],
                  batch_size: int = 1024) -> DataFrame:
    """`key` and one double column per output name.

    `inputs` names array columns and their fixed lengths.  `factory()` returns a function that gets them, in
    that order, as arrays of shape (rows, length) and returns (rows, outputs).  A batch has at most
    `batch_size` rows, all inputs as doubles; a result of another shape is an error, and so is an input of another length."""
    width, total = len(outputs), sum(inputs.values())
    cuts = np.cumsum(list(inputs.values()))[:-1].tolist()

    def make():
        model = factory()

        def predict(batch: np.ndarray) -> np.ndarray:
            got = np.asarray(model(*np.split(batch, cuts, axis=1)), dtype=np.float64)
            if got.shape != (len(batch), width):
                raise ValueError(f"the model gave shape {got.shape} for {len(batch)} rows and {width} outputs")
            return got

        return predict

    call = predict_batch_udf(make, return_type=Ty.ArrayType(Ty.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[total]])
    whole = [F.when(F.size(c) == n, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} has not {n} elements"))).cast("array<double>")
             for c, n in inputs.items()]
    scored = df.select(*key, F.concat(*whole).alias("__in")).withColumn("__out", call("__in"))
    return scored.select(*key, *[F.col("__out")[i].alias(name) for i, name in enumerate(outputs)])
