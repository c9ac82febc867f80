"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a temporary one is set, but in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='engrammatic-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _files(df: DataFrame):
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._table_path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder, which cuts the lineage and survives lost executors.

    The files go with drop_written(), or at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    fs, p = _files(out)
    fs.deleteOnExit(p)
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes the files of tables that written() made and that nothing reads any more."""
    for df in tables:
        if getattr(df, "_table_path", None):
            fs, p = _files(df)
            fs.delete(p, True)
