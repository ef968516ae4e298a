"""Models behind one interface: Arrow batches in, one prediction for each row out.

A model is any object with ``load()`` (once for each Python worker) and
``predict(matrix)``. Neural models plug in by subclassing; none are shipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Model(Protocol):
    def load(self) -> None: ...

    def predict(self, rows: np.ndarray) -> np.ndarray: ...


class FixedVector:
    """Inner product with a fixed vector; a stand-in for tests."""

    def __init__(self, weights: list[float]):
        self.weights = weights

    def load(self) -> None:
        self.w = np.array(self.weights)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.w


class OnnxModel:
    """A model file, opened with onnxruntime on one thread for each worker."""

    def __init__(self, path: str, output: int = 0):
        self.path, self.output = path, output

    def load(self) -> None:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        self.session = ort.InferenceSession(self.path, options)
        self.name = self.session.get_inputs()[0].name

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return np.asarray(self.session.run(None, {self.name: rows.astype(np.float32)})[self.output]).reshape(len(rows), -1)[:, 0]


def score(df: DataFrame, model: Model, vector_col: str, name: str, batch: int = 1024) -> DataFrame:
    """``df`` with the model's prediction on ``vector_col`` (arrays of one length); null vectors get null."""
    at = df.columns.index(vector_col)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.load()
        for whole in batches:
            for first in range(0, whole.num_rows, batch):
                part = whole.slice(first, batch)
                vectors = part.column(at)
                out = np.full(part.num_rows, np.nan)
                good = np.flatnonzero(np.array(vectors.is_valid()))
                if len(good):
                    out[good] = model.predict(np.array([vectors[k].as_py() for k in good.tolist()], np.float64))
                mask = np.ones(part.num_rows, bool)
                mask[good] = False
                yield part.append_column(name, pa.array(out, mask=mask))

    return df.mapInArrow(run, schema)
