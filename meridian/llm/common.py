"""What the training-data operators share: table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of bytes other than these (the ASCII separators 0x09-0x0D and 0x20).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and Spark is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return "file://" + tempfile.gettempdir() + "/meridian-scratch"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/meridian-{kind}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit; the folder is then the cluster's to clear
            pass

    atexit.register(clean)
    return path


def materialise(df: DataFrame, kind: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage: what follows survives lost executors without running the plan before it again.
    The shuffle files of that plan are then no longer referenced and Spark may clear them."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Deletes what ``materialise`` wrote for these frames, once nothing reads them any more."""
    for frame in frames:
        path = getattr(frame, "_scratch", None)
        if path is not None:
            _remove(frame.sparkSession, path)
