"""Shared helpers of the training-data operators: scratch tables and column names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
#: Scratch tables that are still there; one list for each open scope, the first for the whole session.
_made: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="reelframe-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, runs the expensive part once and gives
    Catalyst real sizes, so that it broadcasts the table only if it is under the threshold.
    The table goes with discard(), at the end of its scratch() scope, or when the driver exits.
    """
    spark = df.sparkSession
    if not any(_made):
        atexit.unregister(_sweep)
        atexit.register(_sweep)
    root = f"{shared_dir(spark)}/reelframe/{uuid.uuid4().hex}"
    _made[-1].append(root)
    df.write.parquet(f"{root}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{root}/{name}")
    out.scratch_root = root
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        root = t.scratch_root
        for made in _made:
            if root in made:
                made.remove(root)
                delete(t.sparkSession, root)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are deleted at the end, so what depends on them must be written inside."""
    _made.append([])
    try:
        yield
    finally:
        for root in _made.pop():
            delete(spark, root)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for made in _made:
            while made:
                delete(spark, made.pop())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out
