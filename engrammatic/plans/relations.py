"""Upkeep of the relation graph over the derived relation tables."""

from pyspark.sql import functions as F

from engrammatic.dims import CATEGORY_OF, HIGH_IMPACT, SYMMETRIC
from engrammatic.operators import relations as R
from engrammatic.registry import query
from engrammatic.tables import AS_OF, AS_OF_STALE, DAY, table

_KEY = "user_id, subject, predicate, object"
_ROW = ["relation_id", "user_id", "predicate", "object", "confidence", "mentions", "last_mentioned", "effective_to"]


def _out(df, *columns):
    """The columns as queries return them: confidence rounded, and 0 as the end of what is current."""
    own = {"confidence": F.round("confidence", 6).alias("confidence"), "effective_to": F.coalesce("effective_to", F.lit(0)).alias("effective_to")}
    return df.select(*(own[c] if c in own and c in df.columns else c for c in columns or _ROW))


_ROW_SQL = "relation_id, user_id, predicate, object, round(confidence, 6) AS confidence, mentions, last_mentioned, coalesce(effective_to, 0) AS effective_to"
_UPSERT = f"""
    SELECT {_KEY}, last(memory_id ORDER BY observed_at, memory_id) AS memory_id, least(1, first(confidence ORDER BY observed_at, memory_id) + 0.05 * (count(*) - 1)) AS confidence,
           count(*) - 1 AS mentions, min(observed_at) AS created_at, max(observed_at) AS last_mentioned FROM _mentions GROUP BY {_KEY}"""
_MERGED = f"""
    SELECT {_KEY}, first(relation_id ORDER BY confidence DESC, relation_id) AS relation_id, first(memory_id ORDER BY confidence DESC, relation_id) AS memory_id, max(confidence) AS confidence,
           CAST(sum(mentions) AS BIGINT) AS mentions, min(created_at) AS created_at, max(last_mentioned) AS last_mentioned, count(*) AS merged
    FROM _raw_relations WHERE effective_to IS NULL GROUP BY {_KEY}"""
_CONFLICT = """
    SELECT a.relation_id, b.c AS new_confidence FROM _raw_relations a
    JOIN (SELECT user_id, object, max(created_at) AS t, max(confidence) AS c FROM _raw_relations WHERE predicate = 'dislikes' GROUP BY user_id, object) b USING (user_id, object)
    WHERE a.predicate = 'likes' AND a.effective_to IS NULL AND b.t > a.created_at"""
_REPEATED = f"SELECT relation_id FROM (SELECT relation_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY relation_id) AS n FROM _raw_relations) WHERE n > 1"


@query("snk_relation_upsert", f"SELECT {_KEY}, memory_id, round(confidence, 6) AS confidence, mentions, created_at, last_mentioned FROM ({_UPSERT})")
def snk_relation_upsert(spark, d):
    return _out(R.upsert_relations(table(spark, d, "mentions")), *R.KEY, "memory_id", "confidence", "mentions", "created_at", "last_mentioned")


@query("kg_merge_duplicates", f"SELECT {_KEY}, relation_id, memory_id, round(confidence, 6) AS confidence, mentions, created_at, last_mentioned, merged FROM ({_MERGED}) WHERE merged > 1")
def kg_merge_duplicates(spark, d):
    return _out(R.merge_duplicates(table(spark, d, "raw_relations")).where("merged > 1"), *R.KEY, "relation_id", "memory_id", "confidence", "mentions", "created_at", "last_mentioned", "merged")


_STALE = f"(effective_to IS NULL AND last_mentioned < {AS_OF_STALE - 90 * DAY} AND mentions < 2)"
_DECAY = "SELECT {c}, CASE WHEN NOT {s} THEN 'keep' WHEN confidence * 0.8 < 0.3 THEN 'remove' ELSE 'decay' END AS action, round(CASE WHEN {s} AND confidence * 0.8 >= 0.3 THEN confidence * 0.8 ELSE confidence END, 6) AS confidence, CASE WHEN {s} AND confidence * 0.8 < 0.3 THEN {t} ELSE coalesce(effective_to, 0) END AS effective_to"


@query("kg_decay_stale", _DECAY.format(c="relation_id, user_id, mentions", s=_STALE, t=AS_OF_STALE) + " FROM _raw_relations")
def kg_decay_stale(spark, d):
    return _out(R.decay_stale(table(spark, d, "raw_relations"), AS_OF_STALE), "relation_id", "user_id", "mentions", "action", "confidence", "effective_to")


@query("kg_full_reconsolidation", f"WITH m AS (SELECT *, CAST(NULL AS BIGINT) AS effective_to FROM ({_MERGED})) " + _DECAY.format(c=f"{_KEY}, relation_id, mentions, merged", s=_STALE, t=AS_OF_STALE) + " FROM m")
def kg_full_reconsolidation(spark, d):
    return _out(R.full_reconsolidation(table(spark, d, "raw_relations"), AS_OF_STALE), *R.KEY, "relation_id", "mentions", "merged", "action", "confidence", "effective_to")


@query("kg_cleanup", f"SELECT {_ROW_SQL} FROM _raw_relations WHERE NOT (confidence < 0.3 AND created_at < {AS_OF_STALE - 30 * DAY} AND mentions = 0)")
def kg_cleanup(spark, d):
    return _out(R.cleanup(table(spark, d, "raw_relations"), AS_OF_STALE))


@query("kg_supersede", f"""
    WITH c AS ({_CONFLICT}) SELECT relation_id, user_id, predicate, object, round(confidence, 6) AS confidence, mentions, last_mentioned,
    CASE WHEN relation_id IN (SELECT relation_id FROM c) THEN coalesce(effective_to, {AS_OF}) ELSE coalesce(effective_to, 0) END AS effective_to FROM _raw_relations""")
def kg_supersede(spark, d):
    r = table(spark, d, "raw_relations")
    return _out(R.supersede(r, R.contradicting(r), AS_OF))


@query("kg_reinforce", f"""
    WITH c AS ({_REPEATED}), j AS (SELECT r.*, c.relation_id IS NOT NULL AS hit FROM _raw_relations r LEFT JOIN c USING (relation_id))
    SELECT relation_id, user_id, predicate, object, round(CASE WHEN hit THEN least(1, confidence + 0.05) ELSE confidence END, 6) AS confidence, mentions + CAST(hit AS BIGINT) AS mentions,
           CASE WHEN hit THEN {AS_OF} ELSE last_mentioned END AS last_mentioned, coalesce(effective_to, 0) AS effective_to FROM j""")
def kg_reinforce(spark, d):
    r = table(spark, d, "raw_relations")
    return _out(R.reinforce(r, R.repeated(r), AS_OF))


@query("kg_merge_confidence", f"""
    WITH c AS ({_CONFLICT}) SELECT r.relation_id, user_id, predicate, object, round(coalesce(c.new_confidence * 0.5, confidence), 6) AS confidence, mentions, last_mentioned, coalesce(effective_to, 0) AS effective_to
    FROM _raw_relations r LEFT JOIN c USING (relation_id)""")
def kg_merge_confidence(spark, d):
    r = table(spark, d, "raw_relations")
    return _out(R.merge_confidence(r, R.contradicting(r)))


@query("kg_remove", f"WITH c AS ({_CONFLICT}) SELECT {_ROW_SQL} FROM _raw_relations WHERE relation_id NOT IN (SELECT relation_id FROM c)")
def kg_remove(spark, d):
    r = table(spark, d, "raw_relations")
    return _out(r.join(R.contradicting(r), "relation_id", "left_anti"))


@query("kg_functional_conflict", """
    WITH c AS (SELECT user_id, subject, predicate, object, max(last_mentioned) AS last_mentioned FROM _raw_relations WHERE effective_to IS NULL AND predicate = 'works_at' GROUP BY ALL),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id, subject, predicate) AS objects, row_number() OVER (PARTITION BY user_id, subject, predicate ORDER BY last_mentioned DESC, object) = 1 AS wins FROM c)
    SELECT user_id, subject, predicate, object, last_mentioned, objects, wins FROM n WHERE objects > 1""")
def kg_functional_conflict(spark, d):
    return R.functional_conflicts(table(spark, d, "raw_relations")).select(*R.KEY, "last_mentioned", "objects", "wins")


@query("kg_reinforcement_candidates", f"""
    WITH m AS ({_UPSERT}), t AS (SELECT memory_id, flatten(list([lower(subject), lower(predicate), lower(object)])) AS terms FROM _mentions GROUP BY 1),
    n AS (SELECT node_id, e.user_id, lower(content) AS c, coalesce(terms, []) AS terms FROM _memories e LEFT JOIN t ON t.memory_id = e.node_id),
    j AS (SELECT n.node_id, m.*, row_number() OVER (PARTITION BY node_id ORDER BY confidence DESC, subject, predicate, object) AS rank
      FROM n JOIN m ON m.user_id = n.user_id AND (contains(c, lower(m.subject)) OR contains(c, lower(m.object)) OR list_contains(terms, lower(m.subject)) OR list_contains(terms, lower(m.object))))
    SELECT node_id, user_id, predicate, object, rank FROM j WHERE rank <= 10""")
def kg_reinforcement_candidates(spark, d):
    """What is newly found in a memory is what it mentions."""
    m = table(spark, d, "mentions")
    return R.reinforcement_candidates(R.upsert_relations(m), table(spark, d, "memories"), m).select("node_id", "user_id", "predicate", "object", F.col("rank").cast("long").alias("rank"))


_NAMES = "SELECT user_id, object AS name FROM _mentions WHERE predicate = 'works_at' GROUP BY ALL"


@query("kg_localize", f"""
    WITH names AS ({_NAMES}), n AS (SELECT user_id, count(*) AS c FROM _raw_relations GROUP BY 1)
    SELECT relation_id, user_id, predicate, object FROM _raw_relations r JOIN n USING (user_id)
    WHERE c < 100 OR EXISTS (SELECT 1 FROM names WHERE names.user_id = r.user_id AND (name = subject OR name = object))""")
def kg_localize(spark, d):
    names = table(spark, d, "mentions").where("predicate = 'works_at'").select("user_id", F.col("object").alias("name"))
    return R.localize(table(spark, d, "raw_relations"), names).select("relation_id", "user_id", "predicate", "object")


#: What a maintenance run finds anew: some known triples, and some that aren't.
_NEW = "SELECT * REPLACE (relation_id + 1000000 AS relation_id, CASE WHEN memory_id % 2 = 0 THEN concat('new', memory_id % 30) ELSE object END AS object, CAST(NULL AS BIGINT) AS effective_to) FROM _raw_relations WHERE memory_id % 5 = 0"


@query("kg_apply_maintenance", f"""
    WITH c AS ({_CONFLICT}), p AS ({_REPEATED}), s AS (SELECT r.* REPLACE (CASE WHEN relation_id IN (SELECT relation_id FROM c) THEN coalesce(effective_to, {AS_OF}) ELSE effective_to END AS effective_to),
      relation_id IN (SELECT relation_id FROM p) AS hit FROM _raw_relations r),
    m AS (SELECT relation_id, user_id, subject, predicate, object, CASE WHEN hit THEN least(1, confidence + 0.05) ELSE confidence END AS confidence, mentions + CAST(hit AS BIGINT) AS mentions, CASE WHEN hit THEN {AS_OF} ELSE last_mentioned END AS last_mentioned, effective_to FROM s),
    n AS (SELECT relation_id, user_id, subject, predicate, object, confidence, mentions, last_mentioned, effective_to FROM ({_NEW}) QUALIFY row_number() OVER (PARTITION BY user_id, subject, predicate, object ORDER BY relation_id) = 1),
    u AS (SELECT * FROM m UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.effective_to IS NULL AND m.user_id = n.user_id AND m.subject = n.subject AND m.predicate = n.predicate AND m.object = n.object))
    SELECT relation_id, user_id, predicate, object, round(confidence, 6) AS confidence, mentions, last_mentioned, coalesce(effective_to, 0) AS effective_to FROM u""")
def kg_apply_maintenance(spark, d):
    r = table(spark, d, "raw_relations")
    new = r.where("memory_id % 5 = 0").withColumns({
        "relation_id": F.col("relation_id") + 1000000, "object": F.when(F.col("memory_id") % 2 == 0, F.concat(F.lit("new"), F.col("memory_id") % 30)).otherwise(F.col("object")), "effective_to": F.lit(None).cast("long"),
    })
    return _out(R.added(R.reinforce(R.supersede(r, R.contradicting(r), AS_OF), R.repeated(r), AS_OF), new))


@query("edge_strength_update", f"SELECT candidate_id, round(least(1, ego_avg * exp(-1.2e-5 * (({AS_OF} - last_fired) / 1e6)) + 0.1), 6) AS strength FROM _candidates")
def edge_strength_update(spark, d):
    return table(spark, d, "candidates").select("candidate_id", F.round(R.edge_strength(F.col("ego_avg"), (F.lit(AS_OF) - F.col("last_fired")) / 1e6), 6).alias("strength"))


@query("edge_decay_batch", f"SELECT candidate_id, round(ego_avg * exp(-1.2e-5 * (({AS_OF} - last_fired) / 1e6)), 6) AS strength FROM _candidates WHERE last_fired < {AS_OF - 7 * DAY}")
def edge_decay_batch(spark, d):
    c = table(spark, d, "candidates").where(F.col("last_fired") < AS_OF - 7 * DAY)
    return c.select("candidate_id", F.round(F.col("ego_avg") * F.exp(-1.2e-5 * ((F.lit(AS_OF) - F.col("last_fired")) / 1e6)), 6).alias("strength"))


_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_CAT = "CASE " + " ".join(f"WHEN relation = '{r}' THEN '{c}'" for r, c in CATEGORY_OF.items()) + " ELSE 'temporal' END"


@query("edge_bidirectional", f"""
    WITH e AS (SELECT candidate_id AS edge_id, subject AS src, object AS dst, CASE predicate WHEN 'likes' THEN 'friend_of' ELSE predicate END AS relation FROM _candidates),
    c AS (SELECT *, {_CAT} AS category, relation IN {_IN(SYMMETRIC)} AS two_way FROM e)
    SELECT edge_id, src, dst, relation, category, CASE WHEN two_way THEN edge_id || '~' END AS pair FROM c
    UNION ALL SELECT edge_id || '~', dst, src, relation, category, edge_id FROM c WHERE two_way""")
def edge_bidirectional(spark, d):
    e = table(spark, d, "candidates").selectExpr("candidate_id AS edge_id", "subject AS src", "object AS dst", "CASE predicate WHEN 'likes' THEN 'friend_of' ELSE predicate END AS relation")
    return R.bidirectional(e)


_PENDING = {
    "HIGH": f"AND (evidence >= 3 OR contradictions / 3e0 > 0.7 OR predicate IN {_IN(HIGH_IMPACT)}) ORDER BY last_fired DESC",
    "MED": "AND evidence >= 2 AND sessions >= 2 ORDER BY last_fired DESC",
    "LOW": "ORDER BY first_seen",
}
for _p, _rest in _PENDING.items():

    @query(f"candidate_pending_{_p}", f"SELECT candidate_id, evidence, sessions, first_seen, last_fired FROM _candidates WHERE status = 'candidate' {_rest}, candidate_id LIMIT 100")
    def candidate_pending(spark, d, p=_p):
        return R.pending(table(spark, d, "candidates"), p).select("candidate_id", "evidence", "sessions", "first_seen", "last_fired")


@query("candidate_expire", f"SELECT candidate_id, first_seen FROM _candidates WHERE NOT (status = 'candidate' AND floor(({AS_OF} - first_seen) / {DAY}e0) > 7)")
def candidate_expire(spark, d):
    return R.without_expired(table(spark, d, "candidates"), AS_OF).select("candidate_id", "first_seen")


@query("snk_candidate_upsert", """
    SELECT user_id, subject, predicate, object, count(DISTINCT memory_id) AS evidence, count(DISTINCT session) AS sessions, min(observed_at) AS first_seen, max(observed_at) AS last_fired
    FROM (SELECT * FROM _mentions UNION ALL SELECT * FROM _mentions) GROUP BY ALL""")
def snk_candidate_upsert(spark, d):
    m = table(spark, d, "mentions")  # delivered twice, as at-least-once transport may
    m = m.unionAll(m).dropDuplicates([*R.KEY, "memory_id"])
    return m.groupBy(*R.KEY).agg(F.count("*").alias("evidence"), F.countDistinct("session").alias("sessions"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_fired"))


@query("tier_pruning_action", f"""
    WITH a AS (SELECT m.node_id, m.tier, ({AS_OF} - m.observed_at) / {DAY}e0 AS age, r.memory_id IS NOT NULL AS ref FROM _memories m
      LEFT JOIN (SELECT DISTINCT u.memory_id FROM ({_UPSERT}) u WHERE u.confidence >= 0.7) r ON r.memory_id = m.node_id)
    SELECT node_id, tier, CASE WHEN tier = 1 AND age > 365 OR tier = 2 AND age > 180 THEN 'archive' WHEN tier = 3 AND age > 30 AND NOT ref OR tier = 4 AND age > 600 / 86400e0 THEN 'delete' ELSE 'keep' END AS action FROM a""")
def tier_pruning_action(spark, d):
    refs = R.upsert_relations(table(spark, d, "mentions")).where("confidence >= 0.7").select(F.col("memory_id").alias("node_id"))
    return R.pruning_action(table(spark, d, "memories"), refs, AS_OF).select("node_id", "tier", "action")


_VALID = f"(effective_from IS NULL OR {AS_OF} >= effective_from) AND (effective_to IS NULL OR {AS_OF} <= effective_to)"
for _name, _where in {
    "flt_user": "user_id = 7",
    "flt_current": "effective_to IS NULL",
    "flt_temporal_valid": _VALID.replace(str(AS_OF), str(AS_OF - 12 * DAY)),
}.items():

    @query(_name, f"SELECT {_ROW_SQL} FROM _raw_relations WHERE {_where}")
    def filtered(spark, d, where=_where):
        return _out(table(spark, d, "raw_relations").where(where))


for _name, _keep in {"snk_delete_user": "user_id <> 7", "snk_delete_entity": "subject <> 'user7' AND object <> 'item3'", "snk_delete_edge": "NOT (subject = 'user7' AND object = 'item3')"}.items():

    @query(_name, f"SELECT {_ROW_SQL} FROM _raw_relations WHERE {_keep}")
    def without(spark, d, keep=_keep):
        r = table(spark, d, "raw_relations")
        return _out(r.join(r.where(f"NOT ({keep})").select("relation_id"), "relation_id", "left_anti"))
