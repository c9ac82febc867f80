"""Exact vector search within groups (a user's vectors): Arrow batches and one matrix product for each pair of chunks.

The vectors of a group fall into parts of about CHUNK by a hash of their ids; every part of queries meets every part of
items in a task of its own, so that no task holds more than two parts however large a group is, and the best of each
query's parts are merged by rank. Null vectors are left out; a vector of length 0 is similar to nothing (0).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 2048


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of doubles; 0 if either has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _parts(v: DataFrame) -> DataFrame:
    """(grp, node_id, embedding, part, parts): each group in parts of about CHUNK rows."""
    sizes = v.groupBy("grp").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    return v.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64("node_id"), F.col("parts")))


def nearest(queries: DataFrame, items: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """For each query its k nearest items of the same group with similarity of at least ``least``:
    (grp, node_id, other_id, similarity, rank). Both have (grp, node_id, embedding); equal ids are one thing and not
    compared. Ties go by other_id."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        q, d = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(q) or not len(d):
            return pd.DataFrame({"grp": [], "node_id": [], "other_id": [], "similarity": []})
        d = d.sort_values("node_id", kind="stable")
        s = np.round(_unit(q["embedding"]) @ _unit(d["embedding"]).T, 9)
        ids, others = q["node_id"].to_numpy(), d["node_id"].to_numpy()
        s[ids[:, None] == others[None]] = -2.0
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        s = np.take_along_axis(s, order, 1)
        r, c = np.nonzero(s >= max(least, -1.5))
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "node_id": ids[r], "other_id": others[order[r, c]], "similarity": s[r, c]})

    q, d = (_parts(v.where("embedding IS NOT NULL").select("grp", "node_id", "embedding")) for v in (queries, items))
    counts = lambda v, n: v.select("grp", F.col("parts").alias(n)).distinct()
    seq = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = q.join(counts(d, "n"), "grp").select("grp", "node_id", "embedding", F.lit(True).alias("asks"), F.col("part").alias("a"), seq("n").alias("b"))
    gives = d.join(counts(q, "n"), "grp").select("grp", "node_id", "embedding", F.lit(False).alias("asks"), seq("n").alias("a"), F.col("part").alias("b"))
    best = asks.unionByName(gives).groupBy("grp", "a", "b").applyInPandas(block, "grp long, node_id long, other_id long, similarity double")
    w = Window.partitionBy("grp", "node_id").orderBy(F.desc("similarity"), "other_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """For each vector its k nearest others of the same user, as nearest() gives them: (user_id, node_id, other_id,
    similarity, rank)."""
    v = vectors.select(F.col("user_id").alias("grp"), "node_id", "embedding")
    return nearest(v, v, k, least).withColumnRenamed("grp", "user_id")


def top_k(vectors: DataFrame, probe: list[float], user_id: int | None, k: int, least: float = -1.0) -> DataFrame:
    """The k vectors most similar to one probe: column expressions and a top-k, without a shuffle of vectors."""
    v = vectors if user_id is None else vectors.where(F.col("user_id") == user_id)
    s = v.withColumn("similarity", cosine(F.col("embedding"), F.array(*map(F.lit, probe)))).where(F.col("similarity") >= least)
    return s.select("node_id", "user_id", "similarity").orderBy(F.desc("similarity"), "node_id").limit(k)


def weighted_mean(vectors: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, pos, value): each key's mean vector by weight; equal weights where these add up to 0 or are null."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    e = vectors.select(*keys, w.alias("_w"), F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    g = e.groupBy(*keys, "pos").agg(F.sum(F.col("_w") * F.col("x")).alias("wx"), F.sum("_w").alias("w"), F.avg("x").alias("plain"))
    return g.select(*keys, "pos", F.when(F.col("w") > 0, F.col("wx") / F.col("w")).otherwise(F.col("plain")).alias("value"))
