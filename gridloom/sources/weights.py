"""Model parameters: a table (name, shape, data) of packed matrices, and the same mapped into memory on the executors.

A trained model's parameters may be larger than the driver's memory.  They
are handed on one at a time: read by Spark, spilled to a file, and sent by
Spark's own file service to each executor once, where the workers map the file
and share its pages.  Nothing is pickled into tasks but names and shapes.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, shape array<int>, kind string, data binary"


def write(parameters: dict[str, np.ndarray], spark: SparkSession, path: str, mode: str = "overwrite") -> None:
    """name -> parameter, as a table; large models may be written in parts, with mode `append`."""
    rows = [(name, list(a.shape), a.dtype.str, bytearray(np.ascontiguousarray(a).tobytes())) for name, a in parameters.items()]
    spark.createDataFrame(rows, SCHEMA).write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A table of parameters; of some names only, which reach the scan as a filter."""
    table = spark.read.parquet(path)
    return table.filter(F.col("name").isin(names)) if names else table


class Stored:
    """Parameters by name, as the models ask for them; picklable, mapped where they are used.

    `mapping` renames what a model asks for to what the table calls it.  A bias,
    norm weight or token that the table lacks is none; a lacking matrix, or a
    shape that doesn't hold the numbers wanted, is an error.
    """

    def __init__(self, table: DataFrame, mapping: dict[str, str] | None = None, dtype=np.float64):
        spark, folder = table.sparkSession, tempfile.mkdtemp(prefix="gridloom-parameters-")
        self.mapping, self.dtype, self.files = mapping or {}, dtype, {}
        self._open: dict = {}
        for row in table.select(*(f.split()[0] for f in SCHEMA.split(", "))).toLocalIterator():
            file = hashlib.md5(f"{folder}/{row['name']}".encode()).hexdigest() + ".parameter"
            at = os.path.join(folder, file)
            with open(at, "wb") as f:
                f.write(row["data"])
            spark.sparkContext.addFile(at)
            self.files[row["name"]] = (file, tuple(row["shape"]), row["kind"])

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def __call__(self, name: str, *shape: int) -> np.ndarray | None:
        stored = self.mapping.get(name, name)
        if stored not in self.files:
            if name.endswith(".weight") and "norm" not in name:
                raise KeyError(stored)
            return None
        file, own, kind = self.files[stored]
        if stored not in self._open:
            self._open[stored] = np.memmap(SparkFiles.get(file), dtype=np.dtype(kind), mode="r", shape=own).astype(self.dtype, copy=False)
        found = self._open[stored]
        # a convolution's kernel is the matrix of its patches; a model may have more learned tokens than are used
        fits = found.size == np.prod(shape) or len(shape) == len(own) and all(a >= b for a, b in zip(own, shape)) and name.endswith("tokens")
        if not fits:
            raise ValueError(f"{stored}: {own} where {shape} is wanted")
        return found.reshape(shape) if found.size == np.prod(shape) else found
