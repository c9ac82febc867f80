"""Vector queries over the embeddings; a vector's label stands for its user."""

from pyspark.sql import functions as F

from engrammatic.operators import retrieval as Q
from engrammatic.operators import vectors as V
from engrammatic.registry import query
from engrammatic.tables import DAY, table

_SIM = """
    WITH v AS (SELECT node_id, user_id, CAST(embedding AS DOUBLE[]) AS e FROM _vectors),
    s AS (SELECT a.user_id, a.node_id, b.node_id AS other_id, round(list_cosine_similarity(a.e, b.e), 9) AS similarity FROM v a JOIN v b ON a.user_id = b.user_id AND a.node_id <> b.node_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, other_id) AS rank FROM s)"""


def vec(spark, d):
    return table(spark, d, "vectors")


@query("join_similarity", _SIM + " SELECT node_id, other_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5")
def join_similarity(spark, d):
    return V.neighbours(vec(spark, d), 5).select("node_id", "other_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("vector_topk", "WITH p AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM _vectors WHERE node_id = 0) SELECT node_id, user_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 6) AS similarity FROM _vectors, p ORDER BY similarity DESC, node_id LIMIT 10")
def vector_topk(spark, d):
    v = vec(spark, d)
    probe = [float(x) for x in v.where("node_id = 0").first().embedding]  # one vector: the query
    return V.top_k(v, probe, None, 10).withColumn("similarity", F.round("similarity", 6))


@query("cosine", "SELECT a.node_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM _vectors a JOIN _vectors b ON b.node_id = a.node_id + 1")
def cosine(spark, d):
    v = vec(spark, d)
    b = v.select((F.col("node_id") - 1).alias("node_id"), F.col("embedding").alias("next"))
    return v.join(b, "node_id").select("node_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query("novelty", _SIM + " SELECT v.node_id, round(CASE WHEN max(r.similarity) >= 0.7 THEN 1 - max(r.similarity) ELSE 1 END, 6) AS novelty FROM v LEFT JOIN r ON r.node_id = v.node_id AND r.rank <= 5 GROUP BY v.node_id")
def novelty(spark, d):
    best = V.neighbours(vec(spark, d), 5, 0.7).groupBy("node_id").agg(F.max("similarity").alias("s"))
    return vec(spark, d).select("node_id").join(best, "node_id", "left").select("node_id", F.round(F.coalesce(1 - F.col("s"), F.lit(1.0)), 6).alias("novelty"))


@query("frequency", _SIM + " SELECT v.node_id, round(least(1, count(r.rank) / 20e0), 6) AS frequency FROM v LEFT JOIN r ON r.node_id = v.node_id AND r.rank <= 21 AND r.similarity >= 0.6 GROUP BY v.node_id")
def frequency(spark, d):
    n = V.neighbours(vec(spark, d), 21, 0.6).groupBy("node_id").agg(F.count("*").alias("n"))
    return vec(spark, d).select("node_id").join(n, "node_id", "left").select("node_id", F.round(F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 20.0), 6).alias("frequency"))


@query("kg_contradiction_signals", _SIM + f", g AS (SELECT r.node_id, r.other_id, CAST(floor(abs(x.observed_at - y.observed_at) / {DAY}e0) AS BIGINT) AS gap_days FROM r JOIN _vectors x ON x.node_id = r.node_id JOIN _vectors y ON y.node_id = r.other_id WHERE rank <= 5 AND similarity >= 0.3) SELECT node_id, other_id, gap_days, gap_days > 365 AS is_temporal_change FROM g")
def kg_contradiction_signals(spark, d):
    v = vec(spark, d)
    at = lambda c, t: v.select(F.col("node_id").alias(c), F.col("observed_at").alias(t))
    n = V.neighbours(v, 5, 0.3).join(at("node_id", "t1"), "node_id").join(at("other_id", "t2"), "other_id")
    return n.withColumn("gap_days", F.floor(F.abs(F.col("t1") - F.col("t2")) / float(DAY)).cast("long")).select("node_id", "other_id", "gap_days", (F.col("gap_days") > 365).alias("is_temporal_change"))


#: What a mention is embedded as: its entity's vector without the first eight of 64 values.
_MENTIONED = "m AS (SELECT node_id, user_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i > 8 THEN x ELSE 0e0 END) AS e FROM _vectors)"


def mentioned(spark, d):
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i >= 8, x).otherwise(F.lit(0.0)))
    return vec(spark, d).select((-1 - F.col("node_id")).alias("node_id"), "user_id", e.alias("embedding"))  # ids of their own


@query("entity_by_embedding", f"""
    WITH {_MENTIONED}, s AS (SELECT m.node_id, v.node_id AS entity_id, round(list_cosine_similarity(m.e, CAST(v.embedding AS DOUBLE[])), 9) AS s FROM m JOIN _vectors v ON v.user_id = m.user_id)
    SELECT node_id, entity_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY s DESC, entity_id) AS n FROM s) WHERE n = 1 AND s >= 0.9""")
def entity_by_embedding(spark, d):
    q = mentioned(spark, d).withColumnRenamed("user_id", "grp")
    v = vec(spark, d).select(F.col("user_id").alias("grp"), "node_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return V.nearest(q, v, 1, 0.9).select((-1 - F.col("node_id")).alias("node_id"), F.col("other_id").alias("entity_id"), F.round("similarity", 6).alias("similarity"))


_MEAN = "SELECT label AS user_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x, (1 + vec_id % 5) / 5e0 AS w FROM embeddings"


@query("entity_embedding_agg", f"SELECT CAST(user_id AS BIGINT) AS user_id, pos, round(sum(w * x) / sum(w), 6) AS value FROM ({_MEAN}) GROUP BY ALL")
def entity_embedding_agg(spark, d):
    v = vec(spark, d).withColumn("w", (1 + F.col("node_id") % 5) / 5.0)
    return V.weighted_mean(v, ["user_id"], "w").select("user_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("relation_by_embedding", f"""
    WITH {_MENTIONED}, s AS (SELECT m.node_id, v.node_id AS relation, round(list_cosine_similarity(m.e, CAST(v.embedding AS DOUBLE[])), 9) AS s FROM m JOIN _vectors v ON v.node_id < 60)
    SELECT node_id, relation, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY s DESC, relation) AS n FROM s) WHERE n = 1 AND s > 0.6""")
def relation_by_embedding(spark, d):
    """The first 60 vectors stand for the descriptions of relations."""
    one = F.lit(0).cast("long").alias("grp")
    q = mentioned(spark, d).select(one, "node_id", "embedding")
    v = vec(spark, d).where("node_id < 60").select(one, "node_id", F.col("embedding").cast("array<double>").alias("embedding"))
    best = V.nearest(q, v, 1, 0.6).where("similarity > 0.6")
    return best.select((-1 - F.col("node_id")).alias("node_id"), F.col("other_id").alias("relation"), F.round("similarity", 6).alias("similarity"))


_PROBE = "p AS (SELECT user_id, CAST(embedding AS DOUBLE[]) AS q FROM _vectors WHERE node_id IN (SELECT min(node_id) FROM _vectors GROUP BY user_id))"


@query("join_vector_hits_memories", f"""
    WITH {_PROBE}, h AS (SELECT v.user_id, v.node_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q), 9) AS score FROM _vectors v JOIN p ON p.user_id = v.user_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, node_id) AS n FROM h),
    e AS (SELECT memory_id, string_agg(object, ',' ORDER BY object) AS entities FROM _mentions GROUP BY 1)
    SELECT m.node_id, t.user_id, m.tier, round(m.ego, 6) AS ego_score, round(score, 6) AS relevance_score, coalesce(entities, '') AS entities, 'vector_search' AS source, row_number() OVER (PARTITION BY t.user_id ORDER BY score DESC, m.node_id) AS rank
    FROM t JOIN _memories m ON m.node_id = t.node_id AND m.user_id % 10 = t.user_id LEFT JOIN e ON e.memory_id = m.node_id WHERE n <= 50""")
def join_vector_hits_memories(spark, d):
    """The 50 vectors nearest to each user's query, and what is stored of those that are the user's memories."""
    v = vec(spark, d)
    probe = v.groupBy("user_id").agg(F.min_by("embedding", "node_id").alias("q"))
    hits = v.join(probe, "user_id").withColumn("score", F.round(V.cosine(F.col("embedding"), F.col("q")), 9))
    hits = Q.top_per(hits, ["user_id"], [F.desc("score"), F.col("node_id")], 50).select("user_id", "node_id", "score")
    m = table(spark, d, "memories").withColumn("user_id", F.col("user_id") % 10)  # labels name ten users
    tags = table(spark, d, "mentions").groupBy(F.col("memory_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("object")), ",").alias("entities"))
    return Q.hits_with_memories(hits, m, tags).select("node_id", "user_id", "tier", F.round("ego", 6).alias("ego_score"), F.round("score", 6).alias("relevance_score"), "entities", F.lit("vector_search").alias("source"), "rank")
