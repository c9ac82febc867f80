"""Retrieval queries: filters, lookups, joins and rankings over memories, relations, edges and messages.

Ties are always broken by the key, so every ranking is total. Null scores come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(as_of: int, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Whether the validity interval, closed at both ends and open where null, holds as_of."""
    return (F.col(start).isNull() | (F.col(start) <= as_of)) & (F.col(end).isNull() | (F.col(end) >= as_of))


def user_relations(relations: DataFrame, most: int = 50) -> DataFrame:
    """Each user's surest current relations."""
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("confidence"), "relation_id")
    return relations.where("effective_to IS NULL").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def context_relations(relations: DataFrame, floor: float = 0.7, most: int = 100, current_only: bool = False) -> DataFrame:
    """Each user's relations for a prompt; a null deprecated counts as false."""
    r = relations.where(~F.coalesce("deprecated", F.lit(False)) & (F.col("confidence") >= floor))
    r = r.where("effective_to IS NULL") if current_only else r
    w = Window.partitionBy("user_id").orderBy(F.desc("confidence"), F.desc("mentions"), "relation_id")
    return r.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def top_per(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= n)


def keyword_score(content: Column, query: Column) -> Column:
    """How many of the query's first five words occur in the content."""
    words = F.slice(F.split(F.trim(F.lower(query)), r"\s+"), 1, 5)
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.lower(content).contains(w).cast("long"))


def fallback_recent(memories: DataFrame, query: str, n: int = 10, floor: float = 0.5) -> DataFrame:
    """Of each user's 2 n newest good memories the n with most of the query's words."""
    m = memories.where((F.col("tier") <= 2) & (F.col("ego") >= floor))
    m = top_per(m, ["user_id"], [F.desc("observed_at"), F.col("node_id")], 2 * n, "_recent")
    m = m.withColumn("keywords", keyword_score(F.col("content"), F.lit(query)))
    return top_per(m, ["user_id"], [F.desc("keywords"), F.desc("ego"), F.col("node_id")], n)


def floating(memories: DataFrame, relations: DataFrame, most: int = 15) -> DataFrame:
    """Of each user's best tier 1 and 2 memories those that no relation in context names: top-k first, then the anti-join."""
    best = top_per(memories.where("tier <= 2"), ["user_id"], [F.desc("ego"), F.col("node_id")], most)
    held = context_relations(relations).select("user_id", F.col("memory_id").alias("node_id"))
    return best.join(held, ["user_id", "node_id"], "left_anti")


def kg_boost(vector_hits: DataFrame, kg_hits: DataFrame, weight: float = 0.4) -> DataFrame:
    """Full outer merge of (user_id, node_id, relevance): found by both, the sum with the graph's part weighted, up to 1."""
    v, k = vector_hits.withColumnRenamed("relevance", "_v"), kg_hits.withColumnRenamed("relevance", "_k")
    both = F.col("_v").isNotNull() & F.col("_k").isNotNull()
    j = v.join(k, ["user_id", "node_id"], "full_outer")
    return j.select("user_id", "node_id", F.when(both, F.least(F.lit(1.0), F.col("_v") + weight * F.col("_k"))).otherwise(F.coalesce("_v", "_k")).alias("relevance"), F.when(both, "vector+kg_boost").when(F.col("_v").isNotNull(), "vector").otherwise("kg").alias("source"))


def memory_rank(hits: DataFrame, n: int = 10) -> DataFrame:
    """One row for each (user_id, node_id), that of greatest relevance, ranked by (relevance, ego)."""
    one = hits.groupBy("user_id", "node_id").agg(F.max("relevance").alias("relevance"), F.max("ego").alias("ego"))
    return top_per(one, ["user_id"], [F.desc("relevance"), F.desc("ego"), F.col("node_id")], n)


def context_budget(messages: DataFrame, limit: int = 128_000) -> DataFrame:
    """Adds tokens, the session's total, the mode (none, intelligent, emergency) and whether the message is kept.

    Over 0.5 of the limit system messages and the last 20 are kept, over 0.8 the last 10.
    """
    s = Window.partitionBy("session_id")
    m = messages.withColumn("tokens", F.floor(F.length("text") / 4).cast("long")).withColumn("total", F.sum("tokens").over(s))
    m = m.withColumn("from_end", F.row_number().over(s.orderBy(F.desc("turn"), F.desc("message_id"))).cast("long"))
    mode = F.when(F.col("total") > 0.8 * limit, "emergency").when(F.col("total") > 0.5 * limit, "intelligent").otherwise("none")
    keep = (F.col("mode") == "none") | (F.col("role") == "system") | (F.col("from_end") <= F.when(F.col("mode") == "emergency", 10).otherwise(20))
    return m.withColumn("mode", mode).withColumn("kept", keep)


def hits_with_memories(hits: DataFrame, memories: DataFrame, tags: DataFrame) -> DataFrame:
    """Memories that vector hits (user_id, node_id, score) stand for, with their tags (node_id, entities), best first.

    A hit whose memory is gone or another user's falls away; a memory without tags has ''. The hits of a query are few,
    yet nothing is broadcast by order: the planner sees the sizes.
    """
    found = hits.join(memories, ["node_id", "user_id"]).join(tags, "node_id", "left").withColumn("entities", F.coalesce("entities", F.lit("")))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "node_id")).cast("long"))


def contradictions(edges: DataFrame, memories: DataFrame, least: float = 0.5, resolved_by: str | None = "pending") -> DataFrame:
    """Active contradictions (src, dst, strength, resolved_by) of at least this strength, of one state of resolution if that
    is given, with the tier and text of both ends; an end that is gone gives nulls."""
    e = edges.where("is_active").where(F.col("strength") >= least)
    if resolved_by is not None:
        e = e.where(F.col("resolved_by") == resolved_by)
    end = lambda c: memories.select(F.col("node_id").alias(c), F.col("tier").alias(f"{c}_tier"), F.col("content").alias(f"{c}_content"))
    return e.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
