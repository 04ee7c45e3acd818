"""Session helpers: tables, and results that outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is configured (local tests)."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="chronoweave-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Folders that ``stored`` has written and ``release`` has not deleted.
_STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors. ``release`` deletes the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all that ``stored`` has written so far, and how much that was; results that read it must have been written before."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_STORED)
    for path in _STORED:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    _STORED.clear()
    return n


def small_batches(df: DataFrame, rows: int = 250) -> DataFrame:
    """``df``, with Arrow batches of at most ``rows`` rows from here on: whole texts are large."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
