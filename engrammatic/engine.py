"""The façade: one method for each route that gives data, over tables that the caller names.

tables maps a name (memories, messages, relations, candidates, mentions, edges, vectors, entities) to a DataFrame or to
a function that gives one; nothing is read before a method needs it, and every method returns a DataFrame that isn't run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrammatic.operators import graph as G
from engrammatic.operators import relations as R
from engrammatic.operators import retrieval as Q
from engrammatic.operators import scoring as S
from engrammatic.operators import text as X
from engrammatic.operators import vectors as V
from engrammatic.sources import chat
from engrammatic.streaming import events as E


class MemoryEngine:
    """All questions and upkeep of a memory store; as_of is microseconds since 1970."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> None:
        self.spark, self._tables = spark, tables

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str) -> MemoryEngine:
        """Over the tables derived from a folder of raw tables."""
        from engrammatic.tables import table

        names = {"memories": "memories", "messages": "messages", "relations": "raw_relations", "candidates": "candidates", "mentions": "mentions", "edges": "edges", "vectors": "vectors", "entities": "entities"}
        return cls(spark, {k: lambda n=n: table(spark, sf_dir, n) for k, n in names.items()})

    def table(self, name: str, user_id: int | None = None) -> DataFrame:
        t = self._tables[name]
        t = t if isinstance(t, DataFrame) else t()
        return t if user_id is None else t.where(F.col("user_id") == user_id)

    # ingestion
    def ingest(self, path: str, kind: str | None = None) -> DataFrame:
        """What a source holds, by its kind or by its path."""
        return chat.read(self.spark, path, kind)

    def ingest_turns(self, messages: DataFrame) -> DataFrame:
        """Messages as turns with their answers, with the commands that they start with and the labels of their triggers."""
        return chat.paired_turns(messages).withColumn("command", X.commands(F.col("content")))

    def upsert(self, events: DataFrame) -> DataFrame:
        """Versioned events as the rows that they leave."""
        return E.latest_versions(events)

    # retrieval
    def search(self, probe: list[float], user_id: int, k: int = 50, least: float = -1.0) -> DataFrame:
        """The user's memories nearest to a vector, best first, with what they mention."""
        hits = V.top_k(self.table("vectors"), probe, user_id, k, least).withColumnRenamed("similarity", "score")
        tags = self.table("mentions").groupBy(F.col("memory_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("object")), ",").alias("entities"))
        return Q.hits_with_memories(hits, self.table("memories"), tags)

    def recent(self, query: str, user_id: int, n: int = 10) -> DataFrame:
        """Recent important memories by the words of a query, for when there are no vectors."""
        return Q.fallback_recent(self.table("memories", user_id), query, n)

    def context(self, user_id: int, limit: int = 128_000) -> DataFrame:
        """The latest messages that fit a budget of tokens."""
        return Q.context_budget(self.table("messages", user_id), limit)

    def relations(self, user_id: int, most: int = 50) -> DataFrame:
        """The user's surest current relations."""
        return Q.user_relations(self.table("relations", user_id), most)

    def neighbourhood(self, seeds: list[str], hops: int = 2) -> DataFrame:
        """What lies within so many edges of the seeds."""
        return G.khop(self.table("edges"), self.spark.createDataFrame([(s,) for s in seeds], "seed string"), hops)

    def paths(self, pairs: list[tuple[str, str]], most: int = 5) -> DataFrame:
        """The shortest path of each pair."""
        return G.shortest_paths(self.table("edges"), self.spark.createDataFrame(pairs, "source string, target string"), most)

    # upkeep of the graph
    def reconsolidate(self, as_of: int) -> DataFrame:
        """All relations merged, the stale ones weaker or ended."""
        return R.full_reconsolidation(self.table("relations"), as_of)

    def cleanup(self, as_of: int) -> DataFrame:
        """Relations without those that ended long ago or were never sure."""
        return R.cleanup(self.table("relations"), as_of)

    def conflicts(self) -> DataFrame:
        """Relations that take one object and have several."""
        return R.functional_conflicts(self.table("relations"))

    def pending(self, priority: str = "LOW", most: int = 100) -> DataFrame:
        """Candidates that wait for consolidation."""
        return R.pending(self.table("candidates"), priority, most)

    def retention(self, references: DataFrame, as_of: int) -> DataFrame:
        """What becomes of each memory by the retention schedule."""
        return R.pruning_action(self.table("memories"), references, as_of)

    # scoring
    def ego(self, as_of: int) -> DataFrame:
        """Each memory's score, its tier and what the score is made of."""
        m = self.table("memories")
        age = (F.lit(as_of) - F.col("observed_at")) / 86_400_000_000.0
        c = S.ego_components(F.col("ego"), S.recency_decay(F.col("tier"), age), F.col("frequency_7d"), X.sentiment(F.col("content")), F.col("response_length"), F.col("followups"), F.col("refs"), novelty=F.col("novelty"))
        return m.select("node_id", "user_id", S.ego_score(c).alias("score"), S.tier_of(S.ego_score(c), "ego").alias("tier"), S.ego_explain(c).alias("explanation"))

    def shadow(self, decisions: DataFrame, as_of: int) -> DataFrame:
        """The state of each memory that waits for its user's decision (node_id, decided)."""
        m = self.table("memories").join(decisions, "node_id", "left")
        return m.select("node_id", E.shadow_state(F.col("observed_at"), F.col("decided"), as_of).alias("state"))

    def stats(self) -> DataFrame:
        """How many candidates there are of each status, and their evidence."""
        return self.table("candidates").groupBy("status").agg(F.count("*").alias("n"), F.sum("evidence").alias("evidence"), F.min("first_seen").alias("first_seen"), F.max("last_fired").alias("last_fired"))
