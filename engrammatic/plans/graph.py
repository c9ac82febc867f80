"""Graph queries: located and working nodes around nations, chains of orders, and users with what they mention."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrammatic.operators import graph as G
from engrammatic.operators import retrieval as Q
from engrammatic.registry import query
from engrammatic.tables import AS_OF, table

_VALID = f"is_active AND (effective_from IS NULL OR effective_from <= {AS_OF}) AND (effective_to IS NULL OR effective_to >= {AS_OF})"
#: Two hops over all edges; seeds are all suppliers.
_HOP2 = """
    b AS (SELECT src AS node, dst AS other, edge_id FROM {e} UNION ALL SELECT dst, src, edge_id FROM {e}), s AS (SELECT concat('s:', s_suppkey) AS seed FROM supplier),
    h1 AS (SELECT seed, other AS node, edge_id AS e1 FROM s JOIN b ON b.node = s.seed), h2 AS (SELECT seed, other AS node, 2 AS depth FROM h1 JOIN b USING (node) WHERE b.edge_id <> e1),
    h AS (SELECT seed, node, min(depth) AS depth FROM (SELECT seed, node, 1 AS depth FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL)"""


def edges(spark, d):
    return table(spark, d, "edges")


def suppliers(spark, d):
    return edges(spark, d).where("relation = 'works_at'").select(F.col("src").alias("seed")).distinct()


@query("g_khop", "WITH " + _HOP2.format(e="_edges").strip() + " SELECT seed, node, depth FROM h")
def g_khop(spark, d):
    return G.khop(edges(spark, d), suppliers(spark, d), 2)


def _within(seeds: str, edges: str, hops: int) -> str:
    """SQL of edges_within(): CTE w with (seed, edge_id)."""
    return f"""e0 AS (SELECT * FROM {edges}), b0 AS (SELECT src AS node, dst AS other, edge_id FROM e0 UNION ALL SELECT dst, src, edge_id FROM e0),
    n0 AS (SELECT seed, seed AS node, 0 AS depth FROM ({seeds}) UNION SELECT seed, other, depth + 1 FROM n0 JOIN b0 ON b0.node = n0.node WHERE depth < {hops - 1}),
    w AS (SELECT DISTINCT seed, edge_id FROM n0 JOIN b0 ON b0.node = n0.node)"""


_SUPPLIERS = "SELECT DISTINCT src AS seed FROM _edges WHERE relation = 'works_at'"
_NATIONS = "SELECT DISTINCT src AS seed FROM _edges WHERE relation = 'part_of'"


@query("current_relationships", f"WITH RECURSIVE {_within(_SUPPLIERS, f'_edges WHERE {_VALID}', 2)} SELECT seed, w.edge_id, round(strength, 6) AS strength, row_number() OVER (PARTITION BY seed ORDER BY strength DESC, w.edge_id) AS rank FROM w JOIN e0 ON e0.edge_id = w.edge_id")
def current_relationships(spark, d):
    e = edges(spark, d).where("is_active").where(Q.valid_at(AS_OF))
    of, around = G.edges_around(e, suppliers(spark, d), 2)
    w = Window.partitionBy("grp").orderBy(F.desc("strength"), "edge_id")
    ranked = around.join(e.select("edge_id", "strength"), "edge_id").select("grp", "edge_id", F.round("strength", 6).alias("strength"), F.row_number().over(w).cast("long").alias("rank"))
    return G.spread(of, ranked)


@query("g_entity_context", f"""WITH RECURSIVE {_within(_SUPPLIERS, f"_edges WHERE category = 'professional' AND {_VALID}", 3)},
    r AS (SELECT seed, w.edge_id, src, dst, strength, row_number() OVER (PARTITION BY seed ORDER BY strength DESC, w.edge_id) AS rank FROM w JOIN e0 ON e0.edge_id = w.edge_id) SELECT seed, edge_id, src, dst, round(strength, 6) AS strength, rank FROM r WHERE rank <= 10""")
def g_entity_context(spark, d):
    e = edges(spark, d).where("category = 'professional' AND is_active").where(Q.valid_at(AS_OF))
    of, around = G.edges_around(e, suppliers(spark, d), 3)
    top = Q.top_per(around.join(e, "edge_id"), ["grp"], [F.desc("strength"), F.col("edge_id")], 10)
    return G.spread(of, top.select("grp", "edge_id", "src", "dst", F.round("strength", 6).alias("strength"), "rank"))


@query("g_family_members", f"""WITH RECURSIVE {_within(_NATIONS, f"_edges WHERE category = 'factual' AND {_VALID}", 2)},
    r AS (SELECT seed, src, dst, row_number() OVER (PARTITION BY seed ORDER BY strength DESC, w.edge_id) AS rank FROM w JOIN e0 ON e0.edge_id = w.edge_id), t AS (SELECT * FROM r WHERE rank <= 20)
    SELECT seed AS user, src AS member FROM t WHERE src <> seed UNION SELECT seed, dst FROM t WHERE dst <> seed""")
def g_family_members(spark, d):
    """What the 20 strongest factual edges within two hops of a nation lead to."""
    e = edges(spark, d).where("category = 'factual' AND is_active").where(Q.valid_at(AS_OF))
    seeds = edges(spark, d).where("relation = 'part_of'").select(F.col("src").alias("seed")).distinct()
    of, around = G.edges_around(e, seeds, 2)
    top = Q.top_per(around.join(e, "edge_id"), ["grp"], [F.desc("strength"), F.col("edge_id")], 20).join(of, "grp")
    return top.select(F.col("seed").alias("user"), F.explode(F.array("src", "dst")).alias("member")).where("member <> user").distinct()


@query("professional_history", f"""WITH RECURSIVE {_within(_SUPPLIERS, "_edges WHERE category = 'professional'", 2)}
    SELECT seed, e0.src, e0.dst, coalesce(effective_from, 0) AS effective_from, effective_to IS NULL AS is_current, row_number() OVER (PARTITION BY seed ORDER BY coalesce(effective_from, 0) DESC, w.edge_id) AS rank FROM w JOIN e0 ON e0.edge_id = w.edge_id""")
def professional_history(spark, d):
    e = edges(spark, d).where("category = 'professional'").withColumn("effective_from", F.coalesce("effective_from", F.lit(0)))
    of, around = G.edges_around(e, suppliers(spark, d), 2)
    w = Window.partitionBy("grp").orderBy(F.desc("effective_from"), "edge_id")
    return G.spread(of, around.join(e, "edge_id").select("grp", "src", "dst", "effective_from", F.col("effective_to").isNull().alias("is_current"), F.row_number().over(w).cast("long").alias("rank")))


@query("g_contexts_of_entity", f"""WITH RECURSIVE {_within(f"({_SUPPLIERS}) UNION ALL ({_NATIONS}) UNION ALL SELECT 'nobody'", "_edges", 2)},
    c AS (SELECT seed, category, count(*) AS n FROM w JOIN e0 ON e0.edge_id = w.edge_id GROUP BY ALL), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY seed ORDER BY n DESC, category) = 1)
    SELECT s.seed, coalesce(category, 'personal') AS category, coalesce(n, 0) AS n FROM (({_SUPPLIERS}) UNION ALL ({_NATIONS}) UNION ALL SELECT 'nobody') s LEFT JOIN t ON t.seed = s.seed""")
def g_contexts_of_entity(spark, d):
    nations = edges(spark, d).where("relation = 'part_of'").select(F.col("src").alias("seed")).distinct()
    return G.contexts(edges(spark, d), suppliers(spark, d).union(nations).union(spark.createDataFrame([("nobody",)], "seed string")))


@query("g_evolution_chain", """
    WITH RECURSIVE a AS (SELECT src, dst FROM _chain WHERE is_active), starts AS (SELECT DISTINCT src FROM a WHERE src NOT IN (SELECT dst FROM a)),
    r AS (SELECT src AS seed, src AS node, [src] AS path, 0 AS depth FROM starts UNION ALL SELECT seed, dst, list_append(path, dst), depth + 1 FROM r JOIN a ON a.src = r.node WHERE depth < 10 AND NOT list_contains(path, dst))
    SELECT seed, node, depth, array_to_string(path, '>') AS path FROM r WHERE depth > 0""")
def g_evolution_chain(spark, d):
    a = table(spark, d, "chain").where("is_active").select("src", "dst")
    starts = a.select(F.col("src").alias("seed")).distinct().join(a.select(F.col("dst").alias("seed")), "seed", "left_anti")
    return G.evolution_chains(a, starts).select("seed", "node", "depth", F.array_join("path", ">").alias("path"))


_SUBGRAPH = """
    p AS (SELECT subject AS src, object AS dst, max(confidence) AS w FROM _raw_relations WHERE confidence >= 0.8 GROUP BY ALL), c AS (SELECT subject AS src, object AS dst, avg(avg_confidence) AS w FROM _candidates GROUP BY ALL),
    f AS (SELECT coalesce(p.src, c.src) AS src, coalesce(p.dst, c.dst) AS dst, coalesce(c.w, p.w) AS weight FROM p FULL JOIN c ON p.src = c.src AND p.dst = c.dst), g AS (SELECT * FROM f UNION ALL SELECT dst, src, weight FROM f)"""


def subgraph(spark, d):
    """Promoted and candidate edges; of a pair that is both the candidate's weight counts; both directions."""
    p = table(spark, d, "raw_relations").where("confidence >= 0.8").groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.max("confidence").alias("p"))
    c = table(spark, d, "candidates").groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.avg("avg_confidence").alias("c"))
    f = p.join(c, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("c", "p").alias("weight"))
    return f.unionByName(f.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


@query("g_subgraph", f"WITH {_SUBGRAPH} SELECT src, dst, round(weight, 9) AS weight FROM g")
def g_subgraph(spark, d):
    return subgraph(spark, d).select("src", "dst", F.round("weight", 9).alias("weight"))


_ROUNDS = ", ".join(f"r{i} AS (SELECT n.node, p, 0.15e0 * p + 0.85e0 * coalesce(c, 0) AS rank FROM n LEFT JOIN (SELECT dst, sum(share * rank) AS c FROM sh JOIN r{i - 1} ON r{i - 1}.node = sh.src GROUP BY dst) x ON x.dst = n.node)" for i in range(1, 6))
_PPR = f"""WITH {_SUBGRAPH}, sh AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM g), n AS (SELECT DISTINCT src AS node, CASE WHEN src IN ('user1', 'user7') THEN 0.5e0 ELSE 0 END AS p FROM g), r0 AS (SELECT node, p, p AS rank FROM n), {_ROUNDS}"""


def ranked(spark, d):
    seeds = spark.createDataFrame([("user1",), ("user7",)], "seed string")
    return G.pagerank(subgraph(spark, d), seeds, iterations=5)


@query("g_ppr", _PPR + " SELECT node, round(rank, 6) AS rank FROM r5")
def g_ppr(spark, d):
    return ranked(spark, d).select("node", F.round("rank", 6).alias("rank"))


@query("g_retrieve_context", _PPR + ", t AS (SELECT node, round(rank, 9) AS rank FROM r5 ORDER BY round(rank, 9) DESC, node LIMIT 10) SELECT 'node' AS kind, node AS item, round(rank, 6) AS relevance FROM t UNION ALL SELECT 'edge', src || '>' || dst, round(weight, 9) FROM g WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)")
def g_retrieve_context(spark, d):
    top = ranked(spark, d).withColumn("rank", F.round("rank", 9)).orderBy(F.desc("rank"), "node").limit(10)
    ends = top.select("node")
    e = subgraph(spark, d).join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return top.select(F.lit("node").alias("kind"), F.col("node").alias("item"), F.round("rank", 6).alias("relevance")).unionByName(e.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("item"), F.round("weight", 9).alias("relevance")))


@query("g_hybrid_rank", _PPR + ", m AS (SELECT subject AS node, max(ego) AS ego, max(observed_at) AS t FROM _mentions GROUP BY 1) SELECT node, round(0.4e0 * rank + 0.3e0 * ego + 0.2e0 * exp(-(" + str(AS_OF) + " - t) / 86400000000e0 / 7e0) + 0.1e0 * 0.5e0, 6) AS score FROM r5 JOIN m USING (node)")
def g_hybrid_rank(spark, d):
    m = table(spark, d, "mentions").groupBy(F.col("subject").alias("node")).agg(F.max("ego").alias("ego"), F.max("observed_at").alias("t"))
    return ranked(spark, d).join(m, "node").select("node", F.round(0.4 * F.col("rank") + 0.3 * F.col("ego") + 0.2 * F.exp(-(F.lit(AS_OF) - F.col("t")) / 86400000000.0 / 7.0) + 0.1 * 0.5, 6).alias("score"))


@query("g_shortest_path", """
    WITH RECURSIVE r AS (SELECT DISTINCT src AS source, src AS node, [src] AS path FROM _edges WHERE relation = 'works_at'
      UNION ALL SELECT source, dst, list_append(path, dst) FROM r JOIN _edges ON src = node WHERE len(path) <= 5 AND NOT list_contains(path, dst)),
    t AS (SELECT DISTINCT dst AS target FROM _edges WHERE relation = 'part_of'), f AS (SELECT source, target, len(path) - 1 AS hops, array_to_string(path, '>') AS path FROM r JOIN t ON node = target)
    SELECT source, target, hops, path FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY hops, path) AS n FROM f) WHERE n = 1""")
def g_shortest_path(spark, d):
    e = edges(spark, d)
    regions = e.where("relation = 'part_of'").select(F.col("dst").alias("target")).distinct()
    pairs = suppliers(spark, d).withColumnRenamed("seed", "source").crossJoin(regions)  # every supplier to every region
    return G.shortest_paths(e, pairs).select("source", "target", "hops", F.array_join("path", ">").alias("path"))


@query("g_neighborhood", "SELECT dst AS seed, src AS other, edge_id FROM _edges WHERE dst LIKE 'n:%' UNION ALL SELECT src, dst, edge_id FROM _edges WHERE src LIKE 'n:%'")
def g_neighborhood(spark, d):
    e = edges(spark, d)
    return G.neighbourhood(e, e.where("src LIKE 'n:%'").select(F.col("src").alias("seed")).distinct())


@query("g_kg_stats", "SELECT (SELECT count(*) FROM _entities) AS entities, (SELECT count(*) FROM _edges) AS edges, (SELECT count(*) FROM _candidates) AS candidates")
def g_kg_stats(spark, d):
    one = [table(spark, d, t).agg(F.count("*").alias(t)) for t in ("entities", "edges", "candidates")]
    return one[0].crossJoin(one[1]).crossJoin(one[2])


@query("g_process_message", "SELECT node_id, contains(content, '/') AS has_command, CAST(contains(content, 'item') AS INT) + CAST(contains(content, 'org') AS INT) + CAST(contains(content, 'user') AS INT) >= 2 AS extracts FROM _memories")
def g_process_message(spark, d):
    n = F.size(F.array_distinct(F.regexp_extract_all("content", F.lit("(item|org|user)"), F.lit(1))))
    return table(spark, d, "memories").select("node_id", F.col("content").startswith("/").alias("has_command"), (n >= 2).alias("extracts"))


@query("g_link", "SELECT m.node_id, e.entity_id FROM _memories m JOIN _entities e ON e.user_id = m.user_id AND e.entity_id = concat('item', m.k)")
def g_link(spark, d):
    m, e = table(spark, d, "memories"), table(spark, d, "entities")
    return m.select("node_id", "user_id", F.concat(F.lit("item"), F.col("k")).alias("entity_id")).join(e, ["user_id", "entity_id"]).select("node_id", "entity_id")


@query("g_unlink", "SELECT memory_id, object FROM _mentions m WHERE NOT EXISTS (SELECT 1 FROM _entities e WHERE e.user_id = m.user_id AND e.entity_id = m.object AND e.frequency >= 8)")
def g_unlink(spark, d):
    e = table(spark, d, "entities").where("frequency >= 8").select("user_id", F.col("entity_id").alias("object"))
    return table(spark, d, "mentions").join(e, ["user_id", "object"], "left_anti").select("memory_id", "object")
