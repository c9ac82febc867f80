"""Retrieval queries over the derived tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrammatic.operators import retrieval as Q
from engrammatic.operators import relations as R
from engrammatic.registry import query
from engrammatic.tables import AS_OF, DAY, table

_VALID = f"(effective_from IS NULL OR effective_from <= {AS_OF}) AND (effective_to IS NULL OR effective_to >= {AS_OF})"


def t(spark, d, *names):
    found = [table(spark, d, n) for n in names]
    return found[0] if len(found) == 1 else found


@query("user_relations", """
    SELECT user_id, relation_id, predicate, object, round(confidence, 6) AS confidence, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, relation_id) AS rank FROM _raw_relations WHERE effective_to IS NULL) WHERE rank <= 50""")
def user_relations(spark, d):
    return Q.user_relations(t(spark, d, "raw_relations")).select("user_id", "relation_id", "predicate", "object", F.round("confidence", 6).alias("confidence"), "rank")


_CONTEXT = """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, mentions DESC, relation_id) AS rank
      FROM _raw_relations WHERE deprecated IS DISTINCT FROM true AND confidence >= 0.7"""


@query("kg_context_relations", f"SELECT user_id, relation_id, predicate, object, rank FROM ({_CONTEXT}) WHERE rank <= 100")
def kg_context_relations(spark, d):
    return Q.context_relations(t(spark, d, "raw_relations")).select("user_id", "relation_id", "predicate", "object", "rank")


@query("memories_for_entities", "SELECT DISTINCT user_id, memory_id FROM _raw_relations WHERE subject IN ('item1', 'item3') OR object IN ('item1', 'item3')")
def memories_for_entities(spark, d):
    return t(spark, d, "raw_relations").where("subject IN ('item1', 'item3') OR object IN ('item1', 'item3')").select("user_id", "memory_id").distinct()


@query("contradictions", """
    SELECT src, dst, round(strength, 6) AS strength, coalesce(x.tier, 0) AS src_tier, coalesce(x.content, '') AS src_content, coalesce(y.tier, 0) AS dst_tier, coalesce(y.content, '') AS dst_content
    FROM _contradicts LEFT JOIN _memories x ON x.node_id = src LEFT JOIN _memories y ON y.node_id = dst WHERE is_active AND strength >= 0.5 AND resolved_by = 'pending'""")
def contradictions(spark, d):
    c = Q.contradictions(*t(spark, d, "contradicts", "memories"))
    shown = [F.coalesce(f"{e}_tier", F.lit(0)).alias(f"{e}_tier") for e in ("src", "dst")] + [F.coalesce(f"{e}_content", F.lit("")).alias(f"{e}_content") for e in ("src", "dst")]
    return c.select("src", "dst", F.round("strength", 6).alias("strength"), *shown)


_WORDS = " + ".join(f"CAST(contains(lower(content), '{w}') AS BIGINT)" for w in "item3 love visit place sister".split())


@query("fallback_recent", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY observed_at DESC, node_id) AS n FROM _memories WHERE tier <= 2 AND ego >= 0.5),
    k AS (SELECT *, {_WORDS} AS keywords FROM r WHERE n <= 20)
    SELECT user_id, node_id, keywords, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY keywords DESC, ego DESC, node_id) AS rank FROM k) WHERE rank <= 10""")
def fallback_recent(spark, d):
    return Q.fallback_recent(t(spark, d, "memories"), "Item3 love visit place sister never-looked-at").select("user_id", "node_id", "keywords", "rank")




def graph_memories(spark, d):
    """Memories with what was extracted from each as nested arrays."""
    m = t(spark, d, "mentions")
    e = m.groupBy("user_id", "session").agg(
        F.min("memory_id").alias("node_id"), F.max("observed_at").alias("observed_at"), F.collect_list(F.struct(F.col("object").alias("text"), F.col("memory_id").alias("i"))).alias("ents"), F.collect_list(F.struct(F.col("predicate").alias("relation"), F.col("memory_id").alias("i"))).alias("rels")
    )
    return e


@query("inspect_by_entity", "SELECT user_id, session, min(memory_id) OVER (PARTITION BY user_id, session) AS node_id, memory_id FROM _mentions WHERE true QUALIFY object = 'item3'")
def inspect_by_entity(spark, d):
    m = graph_memories(spark, d).where(F.exists("ents", lambda e: e["text"] == "item3"))
    return m.select("user_id", "session", "node_id", F.explode(F.filter("ents", lambda e: e["text"] == "item3")).alias("e")).select("user_id", "session", "node_id", F.col("e.i").alias("memory_id"))


@query("inspect_by_relation", "SELECT user_id, session, min(memory_id) OVER (PARTITION BY user_id, session) AS node_id, memory_id FROM _mentions WHERE true QUALIFY predicate = 'works_at'")
def inspect_by_relation(spark, d):
    m = graph_memories(spark, d).where(F.exists("rels", lambda e: e["relation"] == "works_at"))
    return m.select("user_id", "session", "node_id", F.explode(F.filter("rels", lambda e: e["relation"] == "works_at")).alias("e")).select("user_id", "session", "node_id", F.col("e.i").alias("memory_id"))


@query("recent_graph_memories", """
    WITH g AS (SELECT user_id, session, min(memory_id) AS node_id, max(observed_at) AS observed_at, count(*) AS entity_count FROM _mentions GROUP BY ALL)
    SELECT node_id, user_id, observed_at, entity_count FROM g ORDER BY observed_at DESC, node_id LIMIT 20""")
def recent_graph_memories(spark, d):
    return graph_memories(spark, d).select("node_id", "user_id", "observed_at", F.size("ents").cast("long").alias("entity_count")).orderBy(F.desc("observed_at"), "node_id").limit(20)


@query("join_unextracted", """
    SELECT user_id, node_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ego DESC, node_id) AS rank FROM _memories m
      WHERE tier <= 2 AND NOT EXISTS (SELECT 1 FROM _raw_relations r WHERE r.user_id = m.user_id AND r.memory_id = m.node_id AND r.confidence >= 0.5)) WHERE rank <= 50""")
def join_unextracted(spark, d):
    m, r = t(spark, d, "memories", "raw_relations")
    left = m.where("tier <= 2").join(r.where("confidence >= 0.5").select("user_id", F.col("memory_id").alias("node_id")), ["user_id", "node_id"], "left_anti")
    return Q.top_per(left, ["user_id"], [F.desc("ego"), F.col("node_id")], 50).select("user_id", "node_id", "tier", "rank")


@query("join_floating", f"""
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ego DESC, node_id) AS rank FROM _memories WHERE tier <= 2),
    k AS (SELECT * FROM ({_CONTEXT}) WHERE rank <= 100)
    SELECT user_id, node_id, rank FROM b WHERE rank <= 15 AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = b.user_id AND k.memory_id = b.node_id)""")
def join_floating(spark, d):
    return Q.floating(*t(spark, d, "memories", "raw_relations")).select("user_id", "node_id", "rank")


@query("join_entity_alias", """SELECT user_id, entity_id FROM _entities WHERE lower(name) IN ('item 3', 'thing5', 'it-2') OR lower(alias1) IN ('item 3', 'thing5', 'it-2') OR lower(alias2) IN ('item 3', 'thing5', 'it-2')""")
def join_entity_alias(spark, d):
    names = spark.createDataFrame([("item 3",), ("thing5",), ("it-2",)], "name string")
    e = t(spark, d, "entities").select("user_id", "entity_id", F.explode(F.array("name", "alias1", "alias2")).alias("known"))
    return e.join(F.broadcast(names), F.lower("known") == F.col("name"), "left_semi").select("user_id", "entity_id").distinct()  # three names


@query("join_edge_endpoints", """SELECT e.edge_id, c.c_name AS src_name, n.n_name AS dst_name FROM _edges e LEFT JOIN customer c ON e.src = concat('c:', c.c_custkey) LEFT JOIN nation n ON e.dst = concat('n:', n.n_nationkey)""")
def join_edge_endpoints(spark, d):
    from engrammatic.tables import read

    c = read(spark, d, "customer").selectExpr("concat('c:', c_custkey) AS src", "c_name AS src_name")
    n = read(spark, d, "nation").selectExpr("concat('n:', n_nationkey) AS dst", "n_name AS dst_name")
    return t(spark, d, "edges").join(c, "src", "left").join(n, "dst", "left").select("edge_id", "src_name", "dst_name")


@query("join_message_sources", "SELECT m.node_id, s.message_id, s.role FROM _memories m JOIN _messages s ON s.user_id = m.user_id AND s.session_id = m.node_id % 97")
def join_message_sources(spark, d):
    m, s = t(spark, d, "memories", "messages")
    bridge = m.selectExpr("node_id", "user_id", "node_id % 97 AS session_id")
    return bridge.join(s, ["user_id", "session_id"]).select("node_id", "message_id", "role")


@query("join_edge_memories", """
    WITH s AS (SELECT user_id, object FROM _candidates WHERE evidence >= 4), m AS (SELECT DISTINCT m.user_id, m.memory_id FROM _mentions m JOIN s ON m.user_id = s.user_id AND m.object = s.object)
    SELECT user_id, memory_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY memory_id) AS rank FROM m) WHERE rank <= 10""")
def join_edge_memories(spark, d):
    m, c = t(spark, d, "mentions", "candidates")
    hit = m.join(c.where("evidence >= 4").select("user_id", "object"), ["user_id", "object"], "left_semi").select("user_id", "memory_id").distinct()
    return Q.top_per(hit, ["user_id"], [F.col("memory_id")], 10)


_BOOST = """
    WITH v AS (SELECT user_id, node_id, ego AS relevance FROM _memories WHERE tier <= 2), k AS (SELECT user_id, memory_id AS node_id, max(confidence) AS relevance FROM _raw_relations WHERE mentions >= 2 GROUP BY ALL),
    j AS (SELECT coalesce(v.user_id, k.user_id) AS user_id, coalesce(v.node_id, k.node_id) AS node_id, v.relevance AS a, k.relevance AS b FROM v FULL JOIN k ON v.user_id = k.user_id AND v.node_id = k.node_id),
    f AS (SELECT user_id, node_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(1, a + 0.4 * b) ELSE coalesce(a, b) END AS relevance,
      CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'vector+kg_boost' WHEN a IS NOT NULL THEN 'vector' ELSE 'kg' END AS source FROM j)"""


def boosted(spark, d):
    m, r = t(spark, d, "memories", "raw_relations")
    v = m.where("tier <= 2").select("user_id", "node_id", F.col("ego").alias("relevance"))
    return Q.kg_boost(v, r.where("mentions >= 2").groupBy("user_id", F.col("memory_id").alias("node_id")).agg(F.max("confidence").alias("relevance")))


@query("join_kg_boost", _BOOST + " SELECT user_id, node_id, round(relevance, 6) AS relevance, source FROM f")
def join_kg_boost(spark, d):
    return boosted(spark, d).select("user_id", "node_id", F.round("relevance", 6).alias("relevance"), "source")


@query("win_memory_rank", _BOOST + """, h AS (SELECT f.*, m.ego FROM f JOIN _memories m ON m.node_id = f.node_id)
    SELECT user_id, node_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, ego DESC, node_id) AS rank FROM h) WHERE rank <= 10""")
def win_memory_rank(spark, d):
    return Q.memory_rank(boosted(spark, d).join(t(spark, d, "memories").select("node_id", "ego"), "node_id")).select("user_id", "node_id", "rank")


@query("set_union_dedup", "SELECT user_id, memory_id AS node_id FROM _raw_relations WHERE confidence >= 0.7 UNION SELECT user_id, node_id FROM _memories WHERE tier = 1")
def set_union_dedup(spark, d):
    r, m = t(spark, d, "raw_relations", "memories")
    return r.where("confidence >= 0.7").select("user_id", F.col("memory_id").alias("node_id")).unionByName(m.where("tier = 1").select("user_id", "node_id")).distinct()


@query("win_recent_messages", "SELECT session_id, message_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY created_at DESC, message_id) AS rank FROM _messages) WHERE rank <= 3")
def win_recent_messages(spark, d):
    return Q.top_per(t(spark, d, "messages"), ["user_id", "session_id"], [F.desc("created_at"), F.col("message_id")], 3).select("session_id", "message_id", "rank")


@query("win_messages_range", f"SELECT message_id, session_id, created_at FROM _messages WHERE created_at BETWEEN {AS_OF - 30 * DAY} AND {AS_OF - 10 * DAY} ORDER BY session_id, turn")
def win_messages_range(spark, d):
    return t(spark, d, "messages").where(F.col("created_at").between(AS_OF - 30 * DAY, AS_OF - 10 * DAY)).orderBy("session_id", "turn").select("message_id", "session_id", "created_at")


@query("win_context_budget", """
    WITH m AS (SELECT *, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM _messages), w AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY session_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, message_id DESC) AS from_end FROM m),
    x AS (SELECT *, CASE WHEN total > 0.8 * 400 THEN 'emergency' WHEN total > 0.5 * 400 THEN 'intelligent' ELSE 'none' END AS mode FROM w)
    SELECT message_id, tokens, total, mode, mode = 'none' OR role = 'system' OR from_end <= CASE WHEN mode = 'emergency' THEN 10 ELSE 20 END AS kept FROM x""")
def win_context_budget(spark, d):
    return Q.context_budget(t(spark, d, "messages"), limit=400).select("message_id", "tokens", "total", "mode", "kept")


@query("win_frequency_7d", f"""
    SELECT node_id, count(*) OVER (PARTITION BY user_id ORDER BY observed_at RANGE BETWEEN {7 * DAY} PRECEDING AND CURRENT ROW) AS n7,
           coalesce(observed_at - lag(observed_at) OVER (PARTITION BY user_id ORDER BY observed_at, node_id), -1) AS gap FROM _memories""")
def win_frequency_7d(spark, d):
    u = Window.partitionBy("user_id")
    return t(spark, d, "memories").select("node_id", F.count("*").over(u.orderBy("observed_at").rangeBetween(-7 * DAY, 0)).alias("n7"), F.coalesce(F.col("observed_at") - F.lag("observed_at").over(u.orderBy("observed_at", "node_id")), F.lit(-1)).alias("gap"))


@query("win_relation_dedup", """
    SELECT relation_id, subject, object, predicate FROM (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY CASE WHEN predicate IN ('part_of', 'is_a', 'related_to', 'associated_with', 'visited') THEN 1 ELSE 0 END, confidence DESC, relation_id) AS n FROM _raw_relations) WHERE n = 1""")
def win_relation_dedup(spark, d):
    generic = F.col("predicate").isin("part_of", "is_a", "related_to", "associated_with", "visited").cast("int")
    return Q.top_per(t(spark, d, "raw_relations"), ["subject", "object"], [generic, F.desc("confidence"), F.col("relation_id")], 1).select("relation_id", "subject", "object", "predicate")


@query("win_triple_dedup", "SELECT relation_id, subject, predicate, object FROM (SELECT *, row_number() OVER (PARTITION BY lower(subject), predicate, lower(object) ORDER BY confidence DESC, relation_id) AS n FROM _raw_relations) WHERE n = 1")
def win_triple_dedup(spark, d):
    r = t(spark, d, "raw_relations").withColumns({"_s": F.lower("subject"), "_o": F.lower("object")})
    return Q.top_per(r, ["_s", "predicate", "_o"], [F.desc("confidence"), F.col("relation_id")], 1).select("relation_id", *R.KEY[1:])


@query("benchmark_search", _BOOST + """, h AS (SELECT f.*, m.ego, m.content FROM f JOIN _memories m ON m.node_id = f.node_id WHERE contains(lower(m.content), 'love'))
    SELECT user_id, node_id, round(relevance, 6) AS relevance, content, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, ego DESC, node_id) AS rank FROM h) WHERE rank <= 5""")
def benchmark_search(spark, d):
    m = t(spark, d, "memories").where(F.lower("content").contains("love")).select("node_id", "ego", "content")
    top = Q.top_per(boosted(spark, d).join(m, "node_id"), ["user_id"], [F.desc("relevance"), F.desc("ego"), F.col("node_id")], 5)
    return top.select("user_id", "node_id", F.round("relevance", 6).alias("relevance"), "content", "rank")
