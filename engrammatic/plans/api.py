"""The façade and the SQL functions, as queries."""

from pyspark.sql import functions as F

from engrammatic import functions
from engrammatic.engine import MemoryEngine
from engrammatic.registry import query
from engrammatic.tables import AS_OF, table


@query("api_stats", "SELECT status, count(*) AS n, CAST(sum(evidence) AS BIGINT) AS evidence, min(first_seen) AS first_seen, max(last_fired) AS last_fired FROM _candidates GROUP BY 1")
def api_stats(spark, d):
    return MemoryEngine.over(spark, d).stats()


@query("api_search", """
    WITH p AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM _vectors WHERE node_id = 3), t AS (SELECT node_id, user_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM _vectors, p WHERE user_id = 2 ORDER BY score DESC, node_id LIMIT 50)
    SELECT m.node_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, m.node_id) AS rank FROM t JOIN _memories m ON m.node_id = t.node_id AND m.user_id = t.user_id""")
def api_search(spark, d):
    e = MemoryEngine.over(spark, d)
    probe = [float(x) for x in e.table("vectors").where("node_id = 3").first().embedding]  # one vector: the query
    return e.search(probe, 2).select("node_id", F.round("score", 6).alias("score"), "rank")


@query("fn_sql_functions", f"""
    SELECT node_id, round(exp(-ln(2e0) / (CASE tier WHEN 1 THEN 180e0 WHEN 2 THEN 7e0 WHEN 3 THEN 1e0 ELSE 300e0 / 86400e0 END) * (({AS_OF} - observed_at) / 86400000000e0)), 6) AS recency,
      CASE WHEN ego >= 0.8 THEN 1 WHEN ego >= 0.6 THEN 2 WHEN ego >= 0.3 THEN 3 ELSE 4 END AS tier, round(least(1, ego * exp(-1.2e-5 * k) + 0.1), 6) AS strength, CAST(floor(length(content) / 4) AS BIGINT) AS tokens,
      round(1 - levenshtein(content, event_type) / CAST(greatest(length(content), length(event_type)) AS DOUBLE), 6) AS ratio, observed_at <= {AS_OF} AS valid FROM _memories""")
def fn_sql_functions(spark, d):
    functions.register(spark)
    return spark.sql(
        f"""SELECT node_id, round(mem_recency_decay(tier, ({AS_OF} - observed_at) / 86400000000D), 6) AS recency, mem_tier_of(ego) AS tier, round(mem_edge_strength(ego, CAST(k AS DOUBLE)), 6) AS strength,
          mem_token_estimate(content) AS tokens, round(mem_edit_ratio(content, event_type), 6) AS ratio, mem_valid_at({AS_OF}, observed_at, NULL) AS valid FROM {{memories}}""",
        memories=table(spark, d, "memories"),
    )
