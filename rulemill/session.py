"""Session helpers: shared scratch space, lineage cuts and input parallelism."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in spark.checkpoint.dir. Only where that setting is
    absent (tests, local mode) a local folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + os.path.join(tempfile.gettempdir(), f"rulemill-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_guard, _open = threading.Lock(), {}


@contextmanager
def _tidy(spark: SparkSession):
    """While any thread is inside, the session removes shuffle files of finished queries; the last one out restores the setting."""
    with _guard:
        count, before = _open.get(id(spark), (0, spark.conf.get(CLEANUP)))
        _open[id(spark)] = count + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _guard:
            count, before = _open.pop(id(spark))
            if count > 1:
                _open[id(spark)] = count - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, path: str | None = None, by: list[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage to what made it, so a lost executor costs a
    re-read and iterative plans stay small. Shuffle files of the write are
    removed when it ends, for nothing reads them again. With a ``path`` rows
    are appended to the table there, in folders by the columns ``by``.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give work that is costly a row at least one partition a core.

    Meant for scans. A table of as many files as there are cores has as many
    splits and passes unchanged; a few small files are dealt out. Only the
    number of files is looked at, so no job runs here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df._jdf.inputFiles()) >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
