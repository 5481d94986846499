"""Tables on the way, written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the driver ends. Only a local session without the setting gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return re.sub("^file:/+", "file:///", fs.makeQualified(folder).toString())


def stage(rows: DataFrame) -> DataFrame:
    """rows as a Parquet table: several plans read it instead of computing it again, and it outlives executors."""
    path = f"{work_folder(rows.sparkSession)}/table"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
