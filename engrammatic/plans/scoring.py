"""Scores over the derived memories, candidates and messages."""

from pyspark.sql import functions as F

from engrammatic.dims import EGO_WEIGHTS, ACTIVATION_WEIGHTS, DEFINITE, HEDGES, IMPORTANCE, LABEL_IMPORTANCE, TIER_POLICIES
from engrammatic.operators import scoring as S
from engrammatic.registry import query
from engrammatic.storage import written
from engrammatic.tables import AS_OF, DAY, read, table

_AGE = f"(({AS_OF} - observed_at) / {DAY}e0)"
_HALF = "(CASE tier WHEN 1 THEN 180e0 WHEN 2 THEN 7e0 WHEN 3 THEN 1e0 WHEN 4 THEN 300e0 / 86400 ELSE 7e0 END)"
_REC = f"greatest(0, least(1, exp(-0.6931471805599453 / {_HALF} * {_AGE})))"
_LABEL = "CASE event_type WHEN 'signup' THEN 'identity:name' WHEN 'purchase' THEN 'preference' WHEN 'error' THEN 'event:bug' WHEN 'view' THEN 'curiosity' ELSE 'goal' END"
_MAP = lambda e, d, other: f"coalesce(CASE {e} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in d.items()) + f" END, {other})"
_EXPL = _MAP(f"({_LABEL})", LABEL_IMPORTANCE, _MAP(f"split_part({_LABEL}, ':', 1)", LABEL_IMPORTANCE, "0.5e0"))
r6 = lambda c, name: F.round(c, 6).alias(name)


def mem(spark, d):
    m = table(spark, d, "memories")
    return m.withColumn("age", (F.lit(AS_OF) - F.col("observed_at")) / float(DAY)).withColumn("explicit", S.explicit_importance(F.expr(_LABEL)))


def comps(m):
    return S.ego_components(F.col("explicit"), S.recency_decay(F.col("tier"), F.col("age")), F.col("frequency_7d"), F.col("ego") - 0.5, F.col("response_length"), F.col("followups"), F.col("refs"), F.col("ego"), None, F.col("novelty"))


_EGO = f"""greatest(0, least(1, 0.2e0 * ({_EXPL}) + 0.2e0 * ({_REC}) + 0.1e0 * least(1, frequency_7d / 10e0) + 0.08e0 * least(1, abs(ego - 0.5)) + 0.12e0 * least(1, response_length / 100e0 + 0.2e0 * followups)
    + 0.1e0 * least(1, refs / 5e0) + 0.1e0 * ego + 0.05e0 * 0.7e0 + 0.05e0 * coalesce(novelty, 0.5)))"""


@query("recency_decay", f"SELECT node_id, tier, round({_REC}, 6) AS recency FROM _memories")
def recency_decay(spark, d):
    return mem(spark, d).select("node_id", "tier", r6(S.recency_decay(F.col("tier"), F.col("age")), "recency"))


@query("explicit_importance", f"SELECT node_id, {_EXPL} AS explicit FROM _memories")
def explicit_importance(spark, d):
    return mem(spark, d).select("node_id", "explicit")


@query("ego_score", f"SELECT node_id, round({_EGO}, 6) AS score FROM _memories")
def ego_score(spark, d):
    return (m := mem(spark, d)).select("node_id", r6(S.ego_score(comps(m)), "score"))


_PARTS = {
    "explicit": f"0.2e0 * ({_EXPL})", "recency": f"0.2e0 * ({_REC})", "frequency": "0.1e0 * least(1, frequency_7d / 10e0)", "sentiment": "0.08e0 * least(1, abs(ego - 0.5))",
    "engagement": "0.12e0 * least(1, response_length / 100e0 + 0.2e0 * followups)", "references": "0.1e0 * least(1, refs / 5e0)", "confidence": "0.1e0 * ego", "source": "0.05e0 * 0.7e0", "novelty": "0.05e0 * coalesce(novelty, 0.5)",
}


@query("ego_explain", "SELECT node_id, " + ", ".join(f"round({e}, 6) AS of_{k}" for k, e in _PARTS.items()) + ", 9 AS n_parts FROM _memories")
def ego_explain(spark, d):
    c = comps(m := mem(spark, d))
    return m.select("node_id", *(r6(EGO_WEIGHTS[k] * v, f"of_{k}") for k, v in c.items()), F.size(F.split(S.ego_explain(c), " ")).alias("n_parts"))


def _tiers(policy):
    cuts, below = TIER_POLICIES[policy]
    return "CASE " + " ".join(f"WHEN s >= {c} THEN {t}" for c, t in cuts) + f" ELSE {below or 'NULL'} END"


@query("tier_assign", f"WITH e AS (SELECT node_id, ego, round({_EGO}, 6) AS s FROM _memories) SELECT node_id, " + ", ".join(f"coalesce({_tiers(p)}, 0) AS {p}" for p in TIER_POLICIES) + ", coalesce(CASE WHEN s >= 0.75 THEN CASE WHEN ego >= 0.85 THEN 1e0 ELSE 0.5e0 END WHEN s >= 0.45 THEN 2e0 WHEN s >= 0.25 THEN 3e0 END, 0) AS shadowed FROM e")
def tier_assign(spark, d):
    m = (m := mem(spark, d)).withColumn("s", F.round(S.ego_score(comps(m)), 6))
    return m.select("node_id", *(F.coalesce(S.tier_of(F.col("s"), p), F.lit(0)).alias(p) for p in TIER_POLICIES), F.coalesce(S.worker_tier(F.col("s"), F.col("ego")), F.lit(0.0)).alias("shadowed"))


_ENG = f"greatest(0, least(1, CASE WHEN {_EXPL} >= 0.7 THEN 0.5 ELSE 0 END + 0.4e0 * least(1, response_length / 200e0) * CASE WHEN {_EXPL} >= 0.7 THEN 0.5 ELSE 1 END + 0.3e0 * least(1, followups / 5e0) + 0.3e0 * ego))"


@query("engagement", f"SELECT node_id, round({_ENG}, 6) AS engagement FROM _memories")
def engagement(spark, d):
    return mem(spark, d).select("node_id", r6(S.engagement(F.col("response_length"), F.col("followups"), F.col("ego"), F.col("explicit")), "engagement"))


_FALL = f"greatest(0, least(1, 0.2e0 * coalesce(novelty, 0.5) + 0.1e0 * frequency_7d / 10e0 + 0.1e0 * abs(ego - 0.5) + 0.4e0 * ({_EXPL}) + 0.2e0 * ({_ENG})))"


@query("ml_ego_fallback", f"SELECT node_id, round({_FALL}, 6) AS score FROM _memories")
def ml_ego_fallback(spark, d):
    return mem(spark, d).select("node_id", r6(_fallback(), "score"))


def _fallback():
    return S.fallback_score(F.coalesce("novelty", F.lit(0.5)), F.col("frequency_7d") / 10.0, F.abs(F.col("ego") - 0.5), F.col("explicit"), S.engagement(F.col("response_length"), F.col("followups"), F.col("ego"), F.col("explicit")))


@query("ml_ego_cap", f"SELECT node_id, round(CASE WHEN {_EXPL} < 0.6 THEN least(ego, 0.74) ELSE ego END, 6) AS score FROM _memories")
def ml_ego_cap(spark, d):
    return mem(spark, d).select("node_id", r6(S.capped(F.col("ego"), F.col("explicit")), "score"))


_CNT = lambda ws, c="text": "(" + " + ".join(f"CAST(contains(lower({c}), '{w}') AS INT)" for w in ws) + ")"
_LLM = lambda c: f"greatest(0.3, least(1, 0.8e0 - 0.05e0 * {_CNT(HEDGES, c)} + 0.03e0 * {_CNT(DEFINITE, c)} + CASE WHEN length({c}) < 50 THEN -0.1e0 WHEN length({c}) > 200 THEN 0.05e0 ELSE 0 END))"


@query("llm_confidence", f"SELECT node_id AS id, round({_LLM('content')}, 6) AS confidence FROM _memories UNION ALL SELECT -message_id - 1, round({_LLM('text')}, 6) FROM _messages WHERE role = 'assistant'")
def llm_confidence(spark, d):
    a = table(spark, d, "memories").select(F.col("node_id").alias("id"), r6(S.llm_confidence(F.col("content")), "confidence"))
    b = table(spark, d, "messages").where("role = 'assistant'").select((-F.col("message_id") - 1).alias("id"), r6(S.llm_confidence(F.col("text")), "confidence"))
    return a.unionByName(b)


_CONF = f"greatest(0, least(1, 0.5e0 * ego + 0.3e0 * ({_LLM('content')}) + 0.2e0 * coalesce(novelty, 1) - CASE WHEN k > 90 THEN 0.3e0 ELSE 0 END - CASE WHEN tier = 3 THEN 0.2e0 ELSE 0 END))"


@query("confidence_combine", f"""WITH c AS (SELECT node_id, round({_CONF}, 6) AS confidence, ego FROM _memories)
    SELECT node_id, confidence, CASE WHEN ego < 0.2 THEN 'discard' WHEN confidence >= 0.85 AND ego >= 0.75 THEN 'auto_store' WHEN confidence >= 0.6 THEN 'active_learning' ELSE 'discard' END AS route,
    CASE WHEN confidence >= 0.85 THEN 'auto_accept' WHEN confidence >= 0.6 THEN 'semantic_check' ELSE 'force_fallback' END AS label_route FROM c""")
def confidence_combine(spark, d):
    c = S.combined_confidence(F.col("ego"), S.llm_confidence(F.col("content")), F.coalesce("novelty", F.lit(1.0)), F.col("k") > 90, F.col("tier") == 3)
    m = mem(spark, d).withColumn("confidence", F.round(c, 6))
    return m.select("node_id", "confidence", S.routing(F.col("confidence"), F.col("ego")).alias("route"), S.label_routing(F.col("confidence")).alias("label_route"))


@query("routing_label_conf", "SELECT id, CASE WHEN score >= 0.85 THEN 'auto_accept' WHEN score >= 0.60 THEN 'semantic_check' ELSE 'force_fallback' END AS route FROM _classified")
def routing_label_conf(spark, d):
    return table(spark, d, "classified").select("id", S.label_routing(F.col("score")).alias("route"))


_FAST = f"greatest(0, least(1, 0.2e0 * ({_EXPL}) + 0.2e0 + 0.12e0 * least(1, length(content) / 100e0) + 0.1e0 * 0.7e0 + 0.05e0 * 0.6e0 + 0.05e0 * 0.5e0))"


@query("fast_score", f"SELECT node_id, round({_FAST}, 6) AS score FROM _memories")
def fast_score(spark, d):
    z = F.lit(0)
    c = S.ego_components(F.col("explicit"), F.lit(1.0), z, z, F.length("content"), z, z, F.lit(0.7), F.lit(0.6))
    return mem(spark, d).select("node_id", r6(S.ego_score(c), "score"))


_ACT = {
    "ego": "0.7e0 * ego_max + 0.3e0 * ego_avg", "evidence": "least(1, evidence / 5e0)", "recency": f"exp(-1.2e-5 * (({AS_OF} - last_fired) / 3.6e9))",
    "rate": f"least(1, evidence / greatest(1, ({AS_OF} - first_seen) / {DAY}e0 / 7e0) / 5e0)", "diversity": "least(1, sessions / 5e0)", "sentiment": "0.3e0 + 1.4e0 * abs(avg_confidence - 0.5)",
    "importance": _MAP("predicate", IMPORTANCE, "0.5e0"), "contradiction": "least(1, contradictions / 3e0)", "proximity": "proximity", "promoted": "least(1, promotes / 3e0)", "demoted": "least(1, demotes / 3e0)", "novelty": "edge_novelty",
}
_SUM = " + ".join(f"({w}e0) * ({_ACT[k]})" for k, w in ACTIVATION_WEIGHTS.items())
_NEAR = """, seen AS (SELECT DISTINCT user_id, x FROM (SELECT user_id, subject AS x FROM _raw_relations WHERE confidence >= 0.9 UNION ALL SELECT user_id, object FROM _raw_relations WHERE confidence >= 0.9)),
    pairs AS (SELECT DISTINCT user_id, subject, object FROM _raw_relations WHERE confidence >= 0.9),
    c AS (SELECT c.*, CASE CAST(a.x IS NOT NULL AS INT) + CAST(b.x IS NOT NULL AS INT) WHEN 2 THEN 1e0 WHEN 1 THEN 0.7e0 ELSE 0.3e0 END AS proximity, CASE WHEN p.subject IS NOT NULL THEN 0.2e0 ELSE 0.8e0 END AS edge_novelty
      FROM _candidates c LEFT JOIN seen a ON a.user_id = c.user_id AND a.x = c.subject LEFT JOIN seen b ON b.user_id = c.user_id AND b.x = c.object LEFT JOIN pairs p ON p.user_id = c.user_id AND p.subject = c.subject AND p.object = c.object)"""
_SCORED = f"WITH one AS (SELECT 1){_NEAR}, s AS (SELECT *, greatest(0, least(1, {_SUM})) AS score FROM c)"


def near(spark, d):
    """Candidates with how close their ends are to the promoted graph, and whether it has the pair."""
    r = table(spark, d, "raw_relations").where("confidence >= 0.9")
    seen = r.select("user_id", F.explode(F.array("subject", "object")).alias("x")).distinct()
    pairs = r.select("user_id", "subject", "object").distinct().withColumn("_p", F.lit(True))
    c = table(spark, d, "candidates").join(seen.select("user_id", F.col("x").alias("subject"), F.lit(1).alias("_s")), ["user_id", "subject"], "left")
    c = c.join(seen.select("user_id", F.col("x").alias("object"), F.lit(1).alias("_o")), ["user_id", "object"], "left").join(pairs, ["user_id", "subject", "object"], "left")
    n = F.coalesce("_s", F.lit(0)) + F.coalesce("_o", F.lit(0))
    return c.withColumns({"proximity": F.when(n == 2, 1.0).when(n == 1, 0.7).otherwise(0.3), "edge_novelty": F.when(F.col("_p"), 0.2).otherwise(0.8)}).drop("_s", "_o", "_p")


def activated(spark, d):
    c = near(spark, d)
    f = S.activation_features({n: F.col(n) for n in c.columns} | {"sentiment": F.col("avg_confidence"), "novelty": F.col("edge_novelty")}, AS_OF)
    return c.withColumns({f"f_{k}": v for k, v in f.items()}).withColumn("score", S.activation({k: F.col(f"f_{k}") for k in f}))


@query("g_graph_proximity", f"WITH one AS (SELECT 1){_NEAR} SELECT candidate_id, proximity FROM c")
def g_graph_proximity(spark, d):
    return near(spark, d).select("candidate_id", "proximity")


@query("g_edge_novelty", f"WITH one AS (SELECT 1){_NEAR} SELECT candidate_id, edge_novelty FROM c")
def g_edge_novelty(spark, d):
    return near(spark, d).select("candidate_id", "edge_novelty")


@query("activation_features", f"WITH one AS (SELECT 1){_NEAR} SELECT candidate_id, " + ", ".join(f"round({e}, 6) AS f_{k}" for k, e in _ACT.items()) + " FROM c")
def activation_features(spark, d):
    return activated(spark, d).select("candidate_id", *(r6(F.col(f"f_{k}"), f"f_{k}") for k in _ACT))


@query("activation_12", _SCORED + " SELECT candidate_id, round(score, 6) AS score, CASE WHEN round(score, 6) >= 0.7 THEN 'promote' WHEN round(score, 6) <= 0.3 THEN 'demote' ELSE 'keep' END AS decision FROM s")
def activation_12(spark, d):
    return activated(spark, d).select("candidate_id", r6(F.col("score"), "score")).withColumn("decision", S.activation_decision(F.col("score")))


_MEAN = "(" + " + ".join(f"({e})" for e in _ACT.values()) + ") / 12e0"
_VAR = "(" + " + ".join(f"pow(({e}) - mean, 2)" for e in _ACT.values()) + ") / 12e0"


@query("activation_confidence", _SCORED + f", m AS (SELECT *, {_MEAN} AS mean FROM s) SELECT candidate_id, round(0.6e0 * least(1, 5 * least(abs(score - 0.7), abs(score - 0.3))) + 0.4e0 * (1 - least(1, 4 * {_VAR})), 6) AS confidence FROM m")
def activation_confidence(spark, d):
    return activated(spark, d).select("candidate_id", r6(S.activation_confidence(F.col("score"), [F.col(f"f_{k}") for k in _ACT]), "confidence"))


@query("candidate_promote", _SCORED + " SELECT user_id, subject AS src, object AS dst, predicate AS relation, round(score, 6) AS strength, first_seen AS effective_from FROM s WHERE round(score, 6) >= 0.6")
def candidate_promote(spark, d):
    a = activated(spark, d).withColumn("strength", F.round("score", 6)).where("strength >= 0.6")
    return a.select("user_id", F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("predicate").alias("relation"), "strength", F.col("first_seen").alias("effective_from"))


@query("relation_importance", f"SELECT candidate_id, {_MAP('predicate', IMPORTANCE, '0.5e0')} AS importance, CASE predicate WHEN 'works_at' THEN 0.75e0 WHEN 'likes' THEN 0.65e0 WHEN 'dislikes' THEN 0.65e0 ELSE 0.5e0 END AS by_word FROM _candidates")
def relation_importance(spark, d):
    return table(spark, d, "candidates").select("candidate_id", S.relation_importance(F.col("predicate")).alias("importance"), S.importance_by_word(F.col("predicate")).alias("by_word"))


@query("relation_confidence", "SELECT candidate_id, round(0.4e0 * avg_confidence + 0.3e0 * ego_avg + 0.2e0 * 0.95e0 + 0.1e0 * 0.9e0, 3) AS confidence FROM _candidates")
def relation_confidence(spark, d):
    return table(spark, d, "candidates").select("candidate_id", S.relation_confidence(F.col("avg_confidence"), F.col("ego_avg"), F.lit(0.95), F.lit(0.9)).alias("confidence"))


@query("triple_confidence", "SELECT node_id, round((ego - CASE WHEN k % 2 = 0 THEN 0.15e0 ELSE 0 END) * 0.9e0 * CASE WHEN tier = 1 THEN 1.05e0 ELSE 1 END * pow(0.96e0, followups), 6) AS confidence FROM _memories")
def triple_confidence(spark, d):
    return table(spark, d, "memories").select("node_id", r6(S.triple_confidence(F.col("ego"), F.col("k") % 2 == 0, F.lit(0.9), F.col("tier") == 1, F.col("followups")), "confidence"))


@query("entity_confidence", "SELECT node_id, round(greatest(0, least(1, 0.4e0 * 0.8e0 + 0.3e0 * ego + 0.2e0 * (refs / 5e0) + 0.1e0 * (1 - followups / 3e0))), 3) AS confidence FROM _memories")
def entity_confidence(spark, d):
    return table(spark, d, "memories").select("node_id", S.entity_confidence(F.lit(0.8), F.col("ego"), F.col("refs") / 5.0, 1 - F.col("followups") / 3.0).alias("confidence"))


@query("confidence_anomaly", """
    WITH s AS (SELECT user_id, CAST(floor(t / 86400000000e0) AS BIGINT) AS day, list(score) AS s FROM _classified GROUP BY ALL),
    m AS (SELECT *, list_filter(s, lambda x: x >= 0.5 AND x <= 0.7) AS mid FROM s)
    SELECT user_id, day, coalesce(CASE WHEN len(list_filter(s, lambda x: x >= 0.5)) > 5 THEN 'too_many_labels' WHEN len(mid) >= 3 AND list_max(mid) - list_min(mid) < 0.15 THEN 'flat_scores'
      WHEN len(s) >= 3 AND list_max(s) > 0.85 AND list_min(s) < 0.6 THEN 'mixed_scores' END, 'none') AS anomaly FROM m""")
def confidence_anomaly(spark, d):
    g = table(spark, d, "classified").groupBy("user_id", F.floor(F.col("t") / float(DAY)).alias("day")).agg(F.collect_list("score").alias("s"))
    return g.select("user_id", "day", F.coalesce(S.confidence_anomaly(F.col("s")), F.lit("none")).alias("anomaly"))


@query("shadow_route", "SELECT node_id, ego >= 0.8 AS shadow, CASE WHEN ego >= 0.8 THEN 2 ELSE tier END AS stored_tier FROM _memories")
def shadow_route(spark, d):
    return table(spark, d, "memories").select("node_id", (F.col("ego") >= 0.8).alias("shadow"), F.when(F.col("ego") >= 0.8, 2).otherwise(F.col("tier")).alias("stored_tier"))


@query("rescore_emit", f"WITH s AS (SELECT node_id, round({_FAST}, 6) AS v1, round({_EGO}, 6) AS v2 FROM _memories), t AS (SELECT *, {_tiers('ml').replace('s >=', 'v1 >=')} AS t1, {_tiers('ml').replace('s >=', 'v2 >=')} AS t2 FROM s) SELECT node_id, v1, v2 FROM t WHERE t1 <> t2 OR abs(v2 - v1) > 0.15")
def rescore_emit(spark, d):
    z, m = F.lit(0), mem(spark, d)
    fast = S.ego_score(S.ego_components(F.col("explicit"), F.lit(1.0), z, z, F.length("content"), z, z, F.lit(0.7), F.lit(0.6)))
    m = m.withColumns({"v1": F.round(fast, 6), "v2": F.round(S.ego_score(comps(m)), 6)})
    return m.where((S.tier_of(F.col("v1")) != S.tier_of(F.col("v2"))) | (F.abs(F.col("v2") - F.col("v1")) > 0.15)).select("node_id", "v1", "v2")


@query("spacing_trigger", f"WITH h AS (SELECT node_id, ({AS_OF} - observed_at) / 3.6e9 AS h FROM _memories) SELECT node_id, coalesce(CASE WHEN abs(h - 24) <= 6 THEN 24 WHEN abs(h - 72) <= 12 THEN 72 WHEN abs(h - 168) <= 24 THEN 168 WHEN abs(h - 720) <= 48 THEN 720 END, 0) AS review FROM h")
def spacing_trigger(spark, d):
    return table(spark, d, "memories").select("node_id", F.coalesce(S.spacing_trigger((F.lit(AS_OF) - F.col("observed_at")) / 3.6e9), F.lit(0)).cast("int").alias("review"))


@query("time_bucket", "SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS bucket FROM events")
def time_bucket(spark, d):
    return table(spark, d, "ev").select("event_id", S.time_bucket(F.col("t")).alias("bucket"))


@query("snk_archive", f"SELECT node_id, tier, CASE WHEN tier = 1 AND {_AGE} > 20 THEN 'archive' WHEN tier = 2 AND {_AGE} > 10 THEN 'archive' WHEN tier >= 3 AND {_AGE} > 5 THEN 'delete' ELSE 'keep' END AS action FROM _memories")
def snk_archive(spark, d):
    a, t = F.col("age"), F.col("tier")
    return mem(spark, d).select("node_id", "tier", F.when((t == 1) & (a > 20) | (t == 2) & (a > 10), "archive").when((t >= 3) & (a > 5), "delete").otherwise("keep").alias("action"))


@query("src_label_eval", "SELECT l.quality, l.toxic, count(*) AS n, round(avg(d.n_chars), 6) AS mean_chars FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL")
def src_label_eval(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), r6(F.avg("n_chars"), "mean_chars"))


def examples(spark, d):
    """The components of each memory, and as its label the score that the fixed weights give."""
    c = comps(m := mem(spark, d))
    return m.select("node_id", *(v.cast("double").alias(k) for k, v in c.items()), S.ego_score(c).alias("label"))


@query("ego_gbt")
def ego_gbt(spark, d):
    """What trees fitted on every memory's components say of it; SQL has no trees, so tests hold it against held-out labels."""
    from engrammatic.operators import learned

    rows = written(examples(spark, d))
    return learned.predict(learned.fit(rows, trees=10), rows).select("node_id", F.round("ego", 6).alias("ego"))
