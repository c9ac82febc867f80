"""Counts over logs, and measures of classifiers and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tallies(log: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(measure, key, n): how many rows have each value of each measure, in one pass over the log; null counts for none."""
    each = F.array(*(F.struct(F.lit(m).alias("measure"), c.cast("string").alias("key")) for m, c in measures.items()))
    rows = log.select(F.explode(F.filter(each, lambda x: x["key"].isNotNull())).alias("x"))
    return rows.groupBy("x.measure", "x.key").agg(F.count("*").alias("n"))


def label_metrics(log: DataFrame, predicted: str, corrected: str) -> DataFrame:
    """One row: micro_f1, macro_f1 (over labels that were predicted or true) and hamming_loss of one label a row."""
    sides = log.select(F.explode(F.array(F.struct(F.col(predicted).alias("label"), F.lit(1).alias("p"), F.lit(0).alias("c")), F.struct(F.col(corrected).alias("label"), F.lit(0).alias("p"), F.lit(1).alias("c")))).alias("s"), (F.col(predicted) == F.col(corrected)).cast("int").alias("hit"))
    labels = sides.groupBy("s.label").agg(F.sum("s.p").alias("p"), F.sum("s.c").alias("c"), F.sum(F.col("hit") * F.col("s.p")).alias("tp"))
    n = F.sum("c")
    return labels.agg((F.sum("tp") / n).alias("micro_f1"), F.avg(2.0 * F.col("tp") / (F.col("p") + F.col("c"))).alias("macro_f1"), (2.0 * (n - F.sum("tp")) / (n * F.count("*"))).alias("hamming_loss"))


def retrieval_quality(results: DataFrame, k: int = 5, relevant: float = 0.3, sure: float = 0.5) -> DataFrame:
    """(category, queries, hit_rate, precision, recall) of the first k results of each query, and a row for all of them.

    results: (query, category, rank, score). A result is relevant from ``relevant`` on; a query is hit if one of its
    first k scores ``sure``; recall is the share of its relevant results that are among these (1 where it has none).
    """
    top = F.col("rank") <= k
    good = F.col("score") >= relevant
    q = results.groupBy("query", "category").agg(
        F.max((top & (F.col("score") >= sure)).cast("int")).alias("hit"), (F.count_if(top & good) / F.count_if(top)).alias("precision"),
        F.coalesce(F.try_divide(F.count_if(top & good), F.count_if(good)), F.lit(1.0)).alias("recall"),
    )
    both = q.withColumn("category", F.explode(F.array("category", F.lit("all"))))
    return both.groupBy("category").agg(F.count("*").alias("queries"), F.avg("hit").alias("hit_rate"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
