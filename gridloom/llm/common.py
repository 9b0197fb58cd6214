"""What the operators of this subpackage share: reading tables, cutting lineage, sizing partitions."""

from __future__ import annotations

import functools
import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side may have so many rows at most; beyond, the operators use a shuffled join.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; where it is unset, make one if driver and executors are one process, else say so."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridloom-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow that, else as it is (a shuffled join then)."""
    return F.broadcast(df) if rows <= most else df


def blocks(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def finite(vector: str | Column) -> Column:
    """True for an array that is not null and holds neither null nor a non-finite number."""
    c = F.col(vector) if isinstance(vector, str) else vector
    inf = float("inf")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (x == inf) | (x == -inf))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(False))


#: Columns of documents that operators use by name.
OWN_NAMES = ("doc_id", "text", "lang", "source", "n_chars")


def any_names(operator):
    """An operator from docs (and more) to a frame of the same columns, made to work whatever the other columns are called."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        plain = [c if c in OWN_NAMES and names.index(c) == k else f"other{k}" for k, c in enumerate(names)]
        return operator(docs.toDF(*plain), *args, **kwargs).toDF(*names)

    return run
