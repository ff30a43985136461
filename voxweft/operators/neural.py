"""A small network that turns confidence features into a probability: one layer of tanh units, one sigmoid."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Network:
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w + self.b)
        return h, 1 / (1 + np.exp(-(h @ self.v + self.c)))

    def predict(self, x: Column) -> Column:
        """Probability of an array of features."""

        @F.arrow_udf("double")
        def run(values: pa.Array) -> pa.Array:
            rows = np.array(values.to_pylist(), float)
            return pa.array(self.forward(rows)[1] if len(rows) else [], pa.float64())

        return run(x)


def fit(df: DataFrame, x: str = "x", label: str = "label", hidden: int = 8, epochs: int = 300, rate: float = 0.5, seed: int = 0, sample_rows: int = 20_000) -> Network:
    """Full-batch descent of the log loss over at most ``sample_rows`` rows, chosen by a hash, on the driver."""
    rows = df.select(x, label).orderBy(F.xxhash64(x, label)).limit(sample_rows).collect()
    xs, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    rng = np.random.RandomState(seed)
    net = Network(rng.normal(0, 0.5, (xs.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.5, hidden), 0.0)
    for _ in range(epochs):
        h, p = net.forward(xs)
        e = (p - y) / len(y)
        back = np.outer(e, net.v) * (1 - h**2)
        net.v -= rate * (h.T @ e)
        net.c -= rate * float(e.sum())
        net.w -= rate * (xs.T @ back)
        net.b -= rate * back.sum(0)
    return net
