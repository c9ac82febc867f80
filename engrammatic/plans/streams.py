"""State of the event pipeline at a point in time, as the batch form of the stateful operators."""

from pyspark.sql import functions as F

from engrammatic.registry import query
from engrammatic.streaming import events as E
from engrammatic.tables import AS_OF, DAY, table

_DECIDED = "CASE k % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' END"


@query("st_shadow_lifecycle", f"WITH a AS (SELECT node_id, {_DECIDED} AS d, ({AS_OF} - observed_at) / {DAY}e0 AS age FROM _memories) SELECT node_id, CASE WHEN d = 'approved' AND age > 30 THEN 'expired' WHEN d IS NOT NULL THEN d WHEN age >= 7 THEN 'auto_promoted' ELSE 'pending' END AS state FROM a")
def st_shadow_lifecycle(spark, d):
    return table(spark, d, "memories").select("node_id", E.shadow_state(F.col("observed_at"), F.expr(_DECIDED), AS_OF).alias("state"))


_END = AS_OF - 3 * DAY


@query("st_tier4_ttl", f"SELECT node_id FROM _memories WHERE ({_END} - observed_at) / 1e6 <= 1200")
def st_tier4_ttl(spark, d):
    return table(spark, d, "memories").where(E.alive(F.col("observed_at"), _END, F.lit(1001))).select("node_id")


@query("st_priority_queues", "SELECT node_id, CASE WHEN ego >= 0.75 THEN 'HIGH' WHEN ego >= 0.45 THEN 'MED' ELSE 'LOW' END AS priority FROM _memories")
def st_priority_queues(spark, d):
    return table(spark, d, "memories").select("node_id", E.priority(F.col("ego")).alias("priority"))


@query("st_processing_state", "SELECT user_id, last(event_type ORDER BY t, event_id) AS state FROM _ev GROUP BY 1")
def st_processing_state(spark, d):
    return table(spark, d, "ev").groupBy("user_id").agg(F.max_by("event_type", F.struct("t", "event_id")).alias("state"))


@query("st_rate_limit", "SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM _ev) WHERE n <= 4")
def st_rate_limit(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-DAY, 0)
    return table(spark, d, "ev").withColumn("n", F.count("*").over(w)).where("n <= 4").select("event_id")
