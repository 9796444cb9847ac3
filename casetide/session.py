"""Session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "casetide", **conf: str) -> SparkSession:
    """A local session in UTC with one shuffle partition per core."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {"spark.sql.shuffle.partitions": str(cpus), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names, deleted when the session ends. Only in a local session
    without that setting a folder of our own is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="casetide-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/casetide-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there and survives lost executors."""
    folder = shared_path(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
