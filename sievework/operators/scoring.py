"""Scoring by a model in an Arrow loop: the model is loaded once in each worker, rows keep their order and their number."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(rows: DataFrame, features: str, load: Callable, batch: int = 256, name: str = "logit") -> DataFrame:
    """rows with the logits that the model gives their features (an array column). `load()` runs in a worker, once a task,
    and returns a function from a matrix to a vector; it is called with at most `batch` rows. Null features give null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for column in batches:
            out: list[pa.Array] = []
            for k in range(0, len(column), batch):
                part = column.slice(k, batch)
                there = np.asarray(part.is_valid())
                values = np.full(len(part), np.nan)
                if there.any():
                    values[there] = model(np.array(part.drop_null().to_pylist(), np.float64))
                out.append(pa.array(values, pa.float64(), mask=~there))
            yield pa.concat_arrays(out) if out else pa.array([], pa.float64())

    return rows.withColumn(name, F.arrow_udf(run, "double")(F.col(features)))


def linear(weights: list[float], bias: float) -> Callable:
    """A loader of a linear head."""

    def load():
        w = np.array(weights)
        return lambda x: x @ w + bias

    return load
