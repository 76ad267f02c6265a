"""Where jobs keep intermediate tables that must outlive a lost executor."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on which it isn't installed."""
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "strandloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and return the table read back (column pruning, compressed)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Have the shuffle files of jobs that are done deleted, which Spark does once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """stored() in few bytes, for tables as large as the input. What earlier jobs shuffled goes."""
    swept(df.sparkSession)
    out = stored(df, name, "zstd")
    swept(df.sparkSession)
    return out
