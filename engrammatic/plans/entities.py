"""Entity resolution over the users' items; the names to resolve are written in four ways."""

from pyspark.sql import functions as F

from engrammatic.operators import entities as E
from engrammatic.registry import query
from engrammatic.tables import AS_OF, DAY, table

_NAME = "CASE tier WHEN 1 THEN concat('Item ', k % 12) WHEN 2 THEN concat('thing', k % 12) WHEN 3 THEN concat('Itm ', k % 12) ELSE CASE WHEN k % 2 = 0 THEN concat(k % 12, ' item') ELSE concat('other', k) END END"
_NAMES = f"SELECT DISTINCT user_id, {_NAME} AS name FROM _memories"
_FUZZY = "n AS (" + _NAMES + """), f AS (SELECT n.user_id, n.name, e.entity_id, levenshtein(lower(n.name), lower(e.name)) AS distance FROM n JOIN _entities e ON e.user_id = n.user_id AND levenshtein(lower(n.name), lower(e.name)) <= greatest(1, floor(0.15 * length(n.name)))),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY distance, entity_id) AS r FROM f) WHERE r = 1)"""


def names(spark, d):
    return table(spark, d, "memories").select("user_id", F.expr(_NAME).alias("name"))


@query("join_fuzzy", f"WITH {_FUZZY} SELECT user_id, name, entity_id, distance FROM b")
def join_fuzzy(spark, d):
    return E.fuzzy(names(spark, d), table(spark, d, "entities"))


_KNOWN = "SELECT * FROM (VALUES ('thing3', 'Item 4'), ('Thing5', 'item 6'), ('nobody', 'Item 1')) AS v(alias, name)"
_VEC = "SELECT {k}, CAST(concat('0x', substr(md5(t), 1, 2)) AS INTEGER) AS place, count(*) AS n FROM (SELECT {k}, unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM {s}) GROUP BY ALL".format


@query("er_resolve", f"""
    WITH {_FUZZY}, x AS (SELECT user_id, lower(name) AS m, min(entity_id) AS e FROM _entities GROUP BY ALL), a AS (SELECT user_id, m, min(entity_id) AS e FROM (SELECT user_id, entity_id, lower(alias1) AS m FROM _entities UNION ALL SELECT user_id, entity_id, lower(alias2) FROM _entities) GROUP BY ALL),
    k AS (SELECT lower(alias) AS m, lower(min(name)) AS to_name FROM ({_KNOWN}) GROUP BY 1),
    qv AS ({_VEC(k="user_id, name", s="n")}), dv AS ({_VEC(k="user_id, entity_id", s="_entities")}), qn AS (SELECT user_id, name, sqrt(sum(n * n)) AS z FROM qv GROUP BY ALL), dn AS (SELECT user_id, entity_id, sqrt(sum(n * n)) AS z FROM dv GROUP BY ALL),
    dots AS (SELECT qv.user_id, qv.name, dv.entity_id, sum(qv.n * dv.n) AS s FROM qv JOIN dv ON dv.user_id = qv.user_id AND dv.place = qv.place GROUP BY ALL),
    l AS (SELECT d.user_id, d.name, d.entity_id, row_number() OVER (PARTITION BY d.user_id, d.name ORDER BY round(s / (qn.z * dn.z), 9) DESC, d.entity_id) AS r FROM dots d JOIN qn ON qn.user_id = d.user_id AND qn.name = d.name JOIN dn ON dn.user_id = d.user_id AND dn.entity_id = d.entity_id WHERE round(s / (qn.z * dn.z), 9) >= 0.9)
    SELECT n.user_id, n.name, coalesce(kx.e, x.e, a.e, b.entity_id, l.entity_id, 'new:' || lower(n.name)) AS entity_id,
      CASE WHEN kx.e IS NOT NULL THEN 'known' WHEN x.e IS NOT NULL THEN 'exact' WHEN a.e IS NOT NULL THEN 'alias' WHEN b.entity_id IS NOT NULL THEN 'fuzzy' WHEN l.entity_id IS NOT NULL THEN 'embedding' ELSE 'new' END AS method
    FROM n LEFT JOIN k ON k.m = lower(n.name) LEFT JOIN x kx ON kx.user_id = n.user_id AND kx.m = k.to_name LEFT JOIN x ON x.user_id = n.user_id AND x.m = lower(n.name) LEFT JOIN a ON a.user_id = n.user_id AND a.m = lower(n.name)
      LEFT JOIN b ON b.user_id = n.user_id AND b.name = n.name LEFT JOIN l ON l.user_id = n.user_id AND l.name = n.name AND l.r = 1""")
def er_resolve(spark, d):
    return E.resolve(names(spark, d), table(spark, d, "entities"), spark.sql(_KNOWN))


@query("er_exact", f"SELECT n.user_id, n.name, e.entity_id FROM ({_NAMES}) n JOIN _entities e ON e.user_id = n.user_id AND lower(e.name) = lower(n.name)")
def er_exact(spark, d):
    e = table(spark, d, "entities").select("user_id", F.lower("name").alias("m"), "entity_id")
    return names(spark, d).distinct().withColumn("m", F.lower("name")).join(e, ["user_id", "m"]).select("user_id", "name", "entity_id")


@query("er_merge", "SELECT alias2 AS into_alias, count(*) AS merged, CAST(sum(frequency) AS BIGINT) AS frequency, string_agg(DISTINCT alias1, ',' ORDER BY alias1) AS aliases FROM _entities GROUP BY 1")
def er_merge(spark, d):
    g = table(spark, d, "entities").groupBy(F.col("alias2").alias("into_alias"))
    return g.agg(F.count("*").alias("merged"), F.sum("frequency").alias("frequency"), F.array_join(F.array_sort(F.collect_set("alias1")), ",").alias("aliases"))


@query("er_link_memory", "SELECT user_id, object AS entity_id, count(DISTINCT memory_id) AS linked FROM _mentions GROUP BY ALL")
def er_link_memory(spark, d):
    return table(spark, d, "mentions").groupBy("user_id", F.col("object").alias("entity_id")).agg(F.countDistinct("memory_id").alias("linked"))


@query("er_sync_incremental", f"SELECT user_id, entity_id, updated_at FROM _entities WHERE updated_at > {AS_OF - 7 * DAY}")
def er_sync_incremental(spark, d):
    return table(spark, d, "entities").where(F.col("updated_at") > AS_OF - 7 * DAY).select("user_id", "entity_id", "updated_at")


@query("entities_top", "SELECT user_id, entity_id, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frequency DESC, entity_id) AS rank FROM _entities) WHERE rank <= 3")
def entities_top(spark, d):
    from engrammatic.operators.retrieval import top_per

    return top_per(table(spark, d, "entities"), ["user_id"], [F.desc("frequency"), F.col("entity_id")], 3).select("user_id", "entity_id", "frequency", "rank")
