"""Cutting lineage through tables in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    fresh = tempfile.mkdtemp(prefix="cairn-")
    spark.conf.set("spark.checkpoint.dir", f"file://{fresh}")
    return f"file://{fresh}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def cuts() -> Iterator[None]:
    """Within it, tables that :func:`cut` writes last until the end of the block: for servers, which answer many requests.

    What a request returns must be collected or written inside.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _remove(spark, path)


def cut(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    A lost executor then costs a re-read instead of a recomputation, and the plan above is planned on true sizes.
    ``by`` names columns to partition the rows by before writing. The table is removed at the end of the innermost block of
    :func:`cuts`, or else when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    (df.repartition(*by) if by else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
