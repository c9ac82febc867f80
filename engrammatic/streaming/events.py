"""Event pipeline: the same functions on batches and, by foreachBatch, on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def latest_versions(events: DataFrame) -> DataFrame:
    """What versioned upserts leave of each node_id: the greatest version, and of equal versions the first to arrive."""
    w = Window.partitionBy("node_id").orderBy(F.desc("version"), "arrival")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def split_bad(events: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed events, and those whose payload isn't JSON of the schema (the dead-letter queue)."""
    p = events.withColumn("data", F.from_json("payload", schema))
    bad = F.col("data").isNull() | F.col("data").getField("node_id").isNull()
    return p.where(~bad).select("arrival", "data.*"), p.where(bad).select("arrival", "payload")


def priority(ego):
    return F.when(ego >= 0.75, "HIGH").when(ego >= 0.45, "MED").otherwise("LOW")


def shadow_state(created, decided, as_of: int, days: int = 7, keep_days: int = 30):
    """pending, approved, rejected, auto_promoted or expired at as_of. decided: null, 'approved' or 'rejected'."""
    age = (F.lit(as_of) - created) / float(DAY)
    return F.when((decided == "approved") & (age > keep_days), "expired").when(decided.isNotNull(), decided).when(age >= days, "auto_promoted").otherwise("pending")


def alive(flushed, as_of: int, backlog, ttl_seconds: int = 600):
    """Whether a buffered item still lives; a backlog of over 1000 doubles its time."""
    return (F.lit(as_of) - flushed) / 1e6 <= F.when(backlog > 1000, 2 * ttl_seconds).otherwise(ttl_seconds)


def vector_upserts(events: DataFrame) -> DataFrame:
    """(node_id, embedded, entities): what upserts and patches of a vector store leave.

    events: (node_id, arrival, entities_only, summary, content, entities). A whole event embeds its summary, or its
    content where that is empty, and is skipped where both are; one that only brings entities replaces those of a vector
    that is there and never makes one.
    """
    text = F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.col("content"))
    e = events.withColumn("embedded", F.when(~F.col("entities_only") & (text != ""), text))
    whole = e.where("embedded IS NOT NULL").groupBy("node_id").agg(F.max(F.struct("arrival", "embedded", "entities")).alias("w"))
    patch = e.where("entities_only").groupBy("node_id").agg(F.max(F.struct("arrival", "entities")).alias("p"))
    later = F.col("p.arrival") > F.col("w.arrival")
    return whole.join(patch, "node_id", "left").select("node_id", F.col("w.embedded").alias("embedded"), F.when(later, F.col("p.entities")).otherwise(F.col("w.entities")).alias("entities"))


#: Files that a table of latest versions is spread over.
BUCKETS = 64


def run_upsert(stream: DataFrame, target: str, checkpoint: str, update: Callable[[DataFrame], DataFrame] = latest_versions, dead: str | None = None, schema: str | None = None):
    """Keeps a Parquet table of the latest versions, in buckets of a hash of node_id. stream: rows with node_id, version
    and arrival; or, with a schema, (arrival, payload), whose unreadable payloads go to the table ``dead``.

    A batch rewrites only the buckets that it touches, each as a new generation bucket=<b>/g=<batch>; a reader takes the
    last of each (see read_upserted). A batch that is run again writes the same, whatever its number, and generations
    before the last but one are removed.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        if schema is not None:
            df, bad = split_bad(df, schema)
            if dead is not None:
                bad.write.mode("overwrite").parquet(f"{dead}/g={number}")
        df = df.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(BUCKETS)).cast("int"))
        touched = [r.bucket for r in df.select("bucket").distinct().collect()]  # at most BUCKETS
        if not touched:
            return
        old = _last(spark, target, number)
        paths = [f"{target}/bucket={b}/g={old[b]}" for b in touched if b in old]
        if paths:
            before = spark.read.schema(df.schema).option("basePath", target).parquet(*paths)
            df = before.select(*df.columns).unionByName(df)
        new = update(df).withColumn("g", F.lit(number))
        conf = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket", "g").parquet(target)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", conf)
        fs, path = _fs(spark, target)
        for b in touched:
            for st in fs.listStatus(path(f"{target}/bucket={b}")):
                g = int(st.getPath().getName().partition("=")[2])
                if b in old and g < old[b]:
                    fs.delete(st.getPath(), True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _last(spark, target: str, before: int) -> dict[int, int]:
    """The last generation below ``before`` of each bucket that has any."""
    fs, path = _fs(spark, target)
    out: dict[int, int] = {}
    if fs.exists(path(target)):
        for st in fs.globStatus(path(f"{target}/bucket=*/g=*")):
            b, g = (int(p.getName().partition("=")[2]) for p in (st.getPath().getParent(), st.getPath()))
            if g < before:
                out[b] = max(g, out.get(b, -1))
    return out


def read_upserted(spark, target: str) -> DataFrame:
    """The table that run_upsert() keeps: of each bucket the last generation."""
    last = _last(spark, target, 1 << 62)
    return spark.read.option("basePath", target).parquet(*(f"{target}/bucket={b}/g={g}" for b, g in sorted(last.items()))).drop("bucket", "g")
