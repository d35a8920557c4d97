"""Tables written between the steps of an operator.

Lineage is cut by writing Parquet into the folder all executors share (``spark.checkpoint.dir``),
so a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast once it has been written and counted.
BROADCAST_ROWS = 50_000

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the cluster; in local mode one is made where the setting is absent."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="strandlake-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


class Staged:
    """A table written in the shared folder. ``drop()`` removes it when later steps no longer read it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, tag: str, **options: str) -> Staged:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return Staged(spark, path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts a side whose counted rows stay under the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def null_safe(left: DataFrame, right: DataFrame, names: list[str], mark: str = "_r_") -> tuple[Column, DataFrame]:
    """A join condition on names in which null equals null, and the right side with its names marked."""
    marked = right.withColumnsRenamed({n: mark + n for n in names})
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(marked[mark + n])
    return cond, marked


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row, however often and wherever later steps use it.

    Filters are not moved through a generator, so the optimizer can't copy the expression into them.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
