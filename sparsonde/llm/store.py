"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        there = spark.sparkContext.getCheckpointDir()
        if there is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparsonde-"))
            there = spark.sparkContext.getCheckpointDir()
        folder = there
    return folder.rstrip("/")


def token() -> str:
    return uuid.uuid4().hex


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{token()}"


def release(wait: float = 0.0) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps that have ended: it goes by what the driver still refers to.

    The last step's plan only goes in a second collection; ``wait``: make that one as well, and leave the cleaner so many seconds.
    """
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    gc.collect()
    jvm.System.gc()
    if wait:
        time.sleep(wait / 2)
        gc.collect()
        jvm.System.gc()
        time.sleep(wait / 2)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: its lineage ends there, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release()
    return spark.read.schema(df.schema).parquet(path)


def _system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    p, system = _system(spark, path)
    system.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies in a folder of any store; none if there is no such folder."""
    p, system = _system(spark, folder)
    return sorted(x.getPath().getName() for x in system.listStatus(p)) if system.exists(p) else []


def read_bytes(spark: SparkSession, path: str, start: int = 0, size: int | None = None) -> bytes:
    """``size`` bytes of a file of any store from ``start`` on; all of the rest if None."""
    p, system = _system(spark, path)
    if size is None:
        size = system.getFileStatus(p).getLen() - start
    stream = system.open(p)
    try:
        stream.seek(start)
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole or not at all: under another name, then renamed. There must be none of that name."""
    p, system = _system(spark, path)
    part, _ = _system(spark, f"{path}.{token()}.tmp")
    stream = system.create(part)
    stream.write(bytearray(text.encode()))
    stream.close()
    if system.exists(p) or not system.rename(part, p):
        system.delete(part, False)
        raise FileExistsError(path)
