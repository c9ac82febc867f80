"""Tables written to the cluster's shared folder, and connected components over them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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
    jvm, path = df.sparkSession._jvm, getattr(df, "_engrammatic_path", None)
    if path:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p
    return None, None


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage ends there, and a lost executor costs nothing.

    The files go with drop_written(), or at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/engrammatic-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._engrammatic_path = path
    fs, p = _files(out)
    fs.deleteOnExit(p)
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes the files of tables that written() made and that nothing reads any more."""
    for df in tables:
        fs, p = _files(df)
        if fs is not None:
            fs.delete(p, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: rows (node, component), the component being its least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum and a join, until the
    edges no longer change; the edges of every step are a written table. Nodes without an edge to another node don't
    occur in the result; loops, repeated edges and edges with a null end count for nothing; no edges give no rows.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
    e = written(e.distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("x")), F.struct(F.col("v").alias("x")))).alias("s"), "m").select(F.col("s.x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = written(small)
        drop_written(e)
        e = new
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


#: Keys up to this many (64-bit integers) are broadcast: about 16 MB on every executor.
BROADCAST_KEYS = 1_000_000


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until df has no column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_key(df: DataFrame, keys: DataFrame, column: str, how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """df joined to ``keys`` (one column, a written table) by a column: how is left_semi or left_anti.

    The keys are counted: up to ``most`` of them are broadcast and df is not shuffled; beyond, a shuffled join whose
    skewed partitions adaptive execution splits. Rows whose key is null match nothing. df may have any columns.
    """
    k = free_name(df, "key")
    few = keys.toDF(k).where(F.col(k).isNotNull()).distinct()
    if few.count() <= most:
        few = F.broadcast(few)
    return df.join(few, F.col(column) == F.col(k), how)


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids (one column, a written table). Null doc_ids stay."""
    return by_key(docs, ids, "doc_id", "left_anti")
