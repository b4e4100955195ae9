"""Parquet tables, and intermediate results written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where none is named and one machine does all, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Where written frames lie, as long as they are referred to.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, whichever executor is lost later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/weftline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete written frames that nothing will read again; others are left alone."""
    for df in frames:
        if df is not None and (path := _WRITTEN.pop(df, None)):
            jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)
