"""Penalised least squares for many penalties from one pass over the training vectors.

Every task adds up the products of its rows, (x, 1, y) with itself, and the sums of all tasks are
added row by row of that matrix. The sums hold all that any penalty needs, so a whole grid of them
is solved afterwards, and all candidates are scored in one pass over the validation rows. Products
are taken around the first training row, which keeps large values from cancelling.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators.evaluate import metric_columns

ROWS = 1024  # vectors multiplied at a time


class NormalSums:
    """Sums of products around ``origin``; n rows, inputs first, then the constant and the target."""

    def __init__(self, products: np.ndarray, origin: np.ndarray):
        self.products, self.origin = products, origin
        self.rows = products[-2, -2] if len(products) else 0.0

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        """(weights, bias) minimising the squared errors plus ``alpha`` times the squared weights."""
        if not self.rows:
            raise ValueError("no training rows")
        n, p = self.rows, len(self.products) - 2
        mean = self.products[:p, p] / n
        goal = self.products[p + 1, p] / n
        square = self.products[:p, :p] - n * np.outer(mean, mean)
        cross = self.products[:p, p + 1] - n * mean * goal
        if alpha:
            weights = np.linalg.solve(square + alpha * np.eye(p), cross)
        else:  # collinear inputs have many solutions; this is the shortest
            weights = np.linalg.lstsq(square, cross, rcond=None)[0]
        return weights, float(goal + self.origin[p] - weights @ (mean + self.origin[:p]))


def normal_sums(train: DataFrame, features: str = "features", target: str = "y") -> NormalSums:
    """The sums of ``train``: one distributed pass; the driver gets one matrix of the inputs' size."""
    rows = train.select(vector_to_array(features).alias("x"), F.col(target).cast("double").alias("y"))
    first = rows.first()
    if first is None:
        return NormalSums(np.zeros((0, 0)), np.zeros(0))
    origin = np.array([*first["x"], first["y"]])
    size = len(origin) + 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                y = part.column("y").to_numpy()
                z = np.column_stack([x - origin[:-1], np.ones(len(y)), y - origin[-1]])
                total += z.T @ z
        if total.any():
            values = pa.ListArray.from_arrays(np.arange(0, size * size + 1, size, dtype=np.int32), total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), values], names=["i", "v"])

    parts = rows.mapInArrow(multiply, "i int, v array<double>")
    zero = F.array_repeat(F.lit(0.0), size)
    added = F.aggregate(F.collect_list("v"), zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    found = parts.groupBy("i").agg(added.alias("v")).collect()
    return NormalSums(np.array([r["v"] for r in sorted(found, key=lambda r: r["i"])]), origin)


def ridge_scores(
    train: DataFrame, validation: DataFrame, alphas: Sequence[float], features: str = "features"
) -> list[tuple[float, float, float]]:
    """(mae, rmse, mape) on ``validation`` of the ridge of every alpha."""
    sums = normal_sums(train, features)
    solved = [sums.ridge(a) for a in alphas]
    runs = train.sparkSession.createDataFrame(
        [([(i, w.tolist(), b) for i, (w, b) in enumerate(solved)],)],
        "runs array<struct<run: int, weights: array<double>, bias: double>>",
    )
    tried = validation.select(
        vector_to_array(features).alias("x"), F.col("y").alias("y_true"), F.explode(runs.scalar()).alias("r")
    )
    products = F.zip_with("x", F.col("r.weights"), lambda a, b: a * b)
    predicted = F.aggregate(products, F.col("r.bias"), lambda s, v: s + v)
    scored = tried.select(F.col("r.run").alias("run"), "y_true", predicted.alias("y_pred"))
    found = {r["run"]: (r["mae"], r["rmse"], r["mape"]) for r in scored.groupBy("run").agg(*metric_columns()).collect()}
    return [found.get(i, (None, None, None)) for i in range(len(alphas))]
