"""Statistics over the training logs, mentions and labels."""

from pyspark.sql import functions as F

from engrammatic.dims import CATEGORY_OF, COMMANDS
from engrammatic.operators import statistics as T
from engrammatic.operators.scoring import rounded
from engrammatic.registry import query
from engrammatic.tables import AS_OF, DAY, read, table

r6 = lambda c, name: F.round(c, 6).alias(name)


def log(spark, d):
    return table(spark, d, "classified")


def counts(spark, d, key, name="classified"):
    return table(spark, d, name).groupBy(key).agg(F.count("*").alias("n"))


_NOW = AS_OF - 2 * DAY


def tallied(source: str, measures: dict[str, str]) -> str:
    """SQL of tallies()."""
    parts = (f"SELECT '{m}' AS measure, CAST({c} AS VARCHAR) AS key, count(*) AS n FROM l GROUP BY 2 HAVING key IS NOT NULL" for m, c in measures.items())
    return f"WITH l AS ({source}) " + " UNION ALL ".join(parts)


@query("label_distribution", "SELECT predicted AS key, count(*) AS n FROM _classified GROUP BY 1")
def label_distribution(spark, d):
    return counts(spark, d, "predicted").withColumnRenamed("predicted", "key")


_CLASSIFIED = {"total": "'all'", "source": "source", "routing": "routing", "recent_24h": f"CASE WHEN t >= {_NOW - DAY} THEN 'all' END", "corrected": "CASE WHEN predicted <> corrected THEN 'all' END"}


@query("classification_stats", tallied("SELECT * FROM _classified", _CLASSIFIED))
def classification_stats(spark, d):
    return T.tallies(log(spark, d), {m: F.expr(c) for m, c in _CLASSIFIED.items()})


_INVALID = """CASE WHEN predicted = corrected THEN '[]' WHEN routing IS NULL THEN concat('["', predicted, '"]') ELSE concat('["', predicted, '","', routing, '"]') END"""


@query("invalid_labels_top", f"""
    WITH i AS (SELECT {_INVALID} AS labels FROM _classified WHERE source = 'semantic_validator'), u AS (SELECT unnest(from_json(labels, '["VARCHAR"]')) AS label FROM i WHERE labels <> '[]')
    SELECT label, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, label LIMIT 10""")
def invalid_labels_top(spark, d):
    i = log(spark, d).where("source = 'semantic_validator'").select(F.explode(F.from_json(F.expr(_INVALID), "array<string>")).alias("label"))
    return i.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(10)


_EXTRACTED = {"total": "'all'", "source": "source", "category": f"CASE {' '.join(f'WHEN relation = {r!r} THEN {c!r}' for r, c in CATEGORY_OF.items())} END", "validated": "CASE WHEN promoted THEN 'all' END", "recent_24h": f"CASE WHEN t >= {_NOW - DAY} THEN 'all' END", "correction": "CASE WHEN source = 'user' THEN 'all' END"}


@query("relation_extraction_stats", tallied("SELECT * FROM _classified", _EXTRACTED))
def relation_extraction_stats(spark, d):
    return T.tallies(log(spark, d), {m: F.expr(c) for m, c in _EXTRACTED.items()})


@query("relation_extraction_top", "SELECT relation, count(*) AS n FROM _classified GROUP BY 1 ORDER BY n DESC, relation LIMIT 10")
def relation_extraction_top(spark, d):
    return counts(spark, d, "relation").orderBy(F.desc("n"), "relation").limit(10)


_ISSUED = "SELECT node_id, unnest(CASE WHEN content LIKE '/remember /private%' THEN ['remember', 'private'] WHEN content LIKE '/tier1 /p %' THEN ['remember', 'private'] WHEN content LIKE '/t2 /t3%' THEN ['tier2', 'tier3'] WHEN content = '/remember' OR content LIKE '  /Remember %' THEN ['remember'] WHEN content LIKE '/search %' THEN ['search'] END) AS command FROM _sayings"
_COMMANDS = {"total": "'all'", "command": "command", "category": f"CASE {' '.join(f'WHEN command = {c!r} THEN {v[1]!r}' for c, v in COMMANDS.items())} END", "tier": f"CASE {' '.join(f'WHEN command = {c!r} THEN {v[3]}' for c, v in COMMANDS.items() if v[3])} END"}


@query("command_stats", tallied(_ISSUED, _COMMANDS))
def command_stats(spark, d):
    from engrammatic.operators import text as X

    c = table(spark, d, "sayings").select("node_id", F.explode(X.commands(F.col("content"))["names"]).alias("command"))
    return T.tallies(c, {m: F.expr(e) for m, e in _COMMANDS.items()})


_RATES = "SELECT relation, count(*) AS n, CAST(sum(CAST(promoted AS INT)) AS BIGINT) AS promoted, round(avg(CAST(promoted AS INT)), 6) AS rate FROM _classified GROUP BY 1"


def rates(spark, d):
    p = F.col("promoted").cast("int")
    return log(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.sum(p).alias("promoted"), r6(F.avg(p), "rate"))


@query("promotion_rates", f"SELECT * FROM ({_RATES}) WHERE n >= 5 ORDER BY rate DESC, relation")
def promotion_rates(spark, d):
    return rates(spark, d).where("n >= 5").orderBy(F.desc("rate"), "relation")


@query("learned_importance", f"SELECT relation, round(0.3e0 + 0.7e0 * rate, 6) AS importance FROM ({_RATES}) WHERE n >= 10")
def learned_importance(spark, d):
    return rates(spark, d).where("n >= 10").select("relation", r6(0.3 + 0.7 * F.col("rate"), "importance"))


@query("relation_stats_upsert", f"SELECT relation, n, promoted FROM ({_RATES})")
def relation_stats_upsert(spark, d):
    return rates(spark, d).select("relation", "n", "promoted")


@query("importance_stats", f"SELECT relation, n, rate FROM ({_RATES} ORDER BY rate DESC, relation LIMIT 5) UNION ALL SELECT 'all', count(*), round(avg(CAST(promoted AS INT)), 6) FROM _classified")
def importance_stats(spark, d):
    """The five relations promoted most often, and all of them together."""
    top = rates(spark, d).orderBy(F.desc("rate"), "relation").limit(5).select("relation", "n", "rate")
    return top.unionByName(log(spark, d).agg(F.lit("all").alias("relation"), F.count("*").alias("n"), r6(F.avg(F.col("promoted").cast("int")), "rate")))


_METHOD = "CASE WHEN relation IN ('works_at', 'likes') THEN 'lexicon' WHEN source = 'llm' THEN 'embedding' ELSE 'original' END"


@query("normalization_stats", f"SELECT coalesce(source, 'all') AS source, coalesce(method, 'all') AS method, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN source_ = 'llm' THEN 1 ELSE 0 END), 6) AS llm_rate FROM (SELECT *, source AS source_, {_METHOD} AS method FROM _classified) GROUP BY GROUPING SETS ((), (source), (method))")
def normalization_stats(spark, d):
    """In all, by source and by method."""
    pair = lambda s, m: F.struct(s.alias("s"), m.alias("m"))
    every = F.lit("all")
    keys = F.explode(F.array(pair(every, every), pair(F.col("source"), every), pair(every, F.expr(_METHOD))))
    x = log(spark, d).select(keys.alias("k"), "score", (F.col("source") == "llm").cast("int").alias("llm"))
    return x.groupBy(F.col("k.s").alias("source"), F.col("k.m").alias("method")).agg(F.count("*").alias("n"), r6(F.avg("score"), "mean_score"), r6(F.avg("llm"), "llm_rate"))


@query("command_pattern_agg", "SELECT predicted, corrected, count(*) AS frequency, round(avg(tier), 6) AS avg_tier, round(avg(score), 6) AS avg_weight FROM _classified GROUP BY ALL")
def command_pattern_agg(spark, d):
    return log(spark, d).groupBy("predicted", "corrected").agg(F.count("*").alias("frequency"), r6(F.avg("tier"), "avg_tier"), r6(F.avg("score"), "avg_weight"))


@query("score_distribution", "SELECT CASE WHEN score >= 0.75 THEN 1 WHEN score >= 0.5 THEN 2 WHEN score >= 0.2 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM _classified GROUP BY 1")
def score_distribution(spark, d):
    from engrammatic.operators.scoring import tier_of

    return log(spark, d).groupBy(tier_of(F.col("score"), "training").alias("bucket")).agg(F.count("*").alias("n"))


@query("label_candidate_promotion", "SELECT k AS label, count(*) AS n, count(DISTINCT user_id) AS users FROM _ev GROUP BY 1 HAVING count(*) >= 3")
def label_candidate_promotion(spark, d):
    return table(spark, d, "ev").groupBy(F.col("k").alias("label")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).where("n >= 3")


@query("mention_aggregates", "SELECT candidate_id, evidence, sessions, first_seen, last_fired, round(ego_max, 6) AS ego_max, round(ego_avg, 6) AS ego_avg FROM _candidates")
def mention_aggregates(spark, d):
    return table(spark, d, "candidates").select("candidate_id", "evidence", "sessions", "first_seen", "last_fired", r6("ego_max", "ego_max"), r6("ego_avg", "ego_avg"))


@query("sentence_label_agg", "SELECT user_id, predicted AS label, round(max(score), 6) AS score FROM _classified GROUP BY ALL")
def sentence_label_agg(spark, d):
    return log(spark, d).groupBy("user_id", F.col("predicted").alias("label")).agg(r6(F.max("score"), "score"))


@query("queue_stats", "SELECT CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.45 THEN 'MED' ELSE 'LOW' END AS priority, count(*) AS depth FROM _classified GROUP BY 1")
def queue_stats(spark, d):
    return log(spark, d).groupBy(F.when(F.col("score") >= 0.75, "HIGH").when(F.col("score") >= 0.45, "MED").otherwise("LOW").alias("priority")).agg(F.count("*").alias("depth"))


@query("histogram_metrics", "SELECT CAST(floor(ego * 10) AS BIGINT) AS bucket, tier, count(*) AS n FROM _memories GROUP BY ALL")
def histogram_metrics(spark, d):
    return table(spark, d, "memories").groupBy(F.floor(F.col("ego") * 10).alias("bucket"), "tier").agg(F.count("*").alias("n"))


@query("training_metrics", "SELECT round(avg(abs(score - tier / 4e0)), 6) AS mae, round(sqrt(avg(pow(score - tier / 4e0, 2))), 6) AS rmse, round(1 - sum(pow(score - tier / 4e0, 2)) / sum(pow(score - (SELECT avg(score) FROM _classified), 2)), 6) AS r2 FROM _classified")
def training_metrics(spark, d):
    e = F.col("score") - F.col("tier") / 4.0
    return log(spark, d).agg(r6(F.avg(F.abs(e)), "mae"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(1 - F.sum(e * e) / (F.var_pop("score") * F.count("*")), "r2"))


@query("training_f1", "SELECT predicted AS label, round(2e0 * count(*) FILTER (WHERE predicted = corrected) / (count(*) + (SELECT count(*) FROM _classified x WHERE x.corrected = c.predicted)), 6) AS f1 FROM _classified c GROUP BY predicted")
def training_f1(spark, d):
    c = log(spark, d)
    p = c.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("p"), F.count_if(F.col("predicted") == F.col("corrected")).alias("tp"))
    return p.join(counts(spark, d, "corrected").withColumnRenamed("corrected", "label"), "label").select("label", r6(2.0 * F.col("tp") / (F.col("p") + F.col("n")), "f1"))


@query("training_f1_overall", """
    WITH l AS (SELECT DISTINCT predicted AS label FROM _classified UNION SELECT corrected FROM _classified),
    f AS (SELECT label, count(*) FILTER (WHERE predicted = label) AS p, count(*) FILTER (WHERE corrected = label) AS c, count(*) FILTER (WHERE predicted = label AND corrected = label) AS tp FROM l, _classified GROUP BY 1)
    SELECT round(sum(tp) / sum(c), 6) AS micro_f1, round(avg(2e0 * tp / (p + c)), 6) AS macro_f1, round(2e0 * (sum(c) - sum(tp)) / (sum(c) * count(*)), 6) AS hamming_loss FROM f""")
def training_f1_overall(spark, d):
    return T.label_metrics(log(spark, d), "predicted", "corrected").select(*(r6(c, c) for c in ("micro_f1", "macro_f1", "hamming_loss")))


@query("retrieval_eval", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, predicted ORDER BY score DESC, id) AS rank FROM _classified),
    q AS (SELECT user_id, predicted AS category, max(CASE WHEN rank <= 5 AND score >= 0.5 THEN 1 ELSE 0 END) AS hit, count(*) FILTER (WHERE rank <= 5 AND score >= 0.3) / count(*) FILTER (WHERE rank <= 5) AS p,
      CASE WHEN count(*) FILTER (WHERE score >= 0.3) = 0 THEN 1e0 ELSE count(*) FILTER (WHERE rank <= 5 AND score >= 0.3) / count(*) FILTER (WHERE score >= 0.3) END AS rc FROM r GROUP BY ALL),
    b AS (SELECT * FROM q UNION ALL SELECT user_id, 'all', hit, p, rc FROM q)
    SELECT category, count(*) AS queries, round(avg(hit), 6) AS hit_rate, round(avg(p), 6) AS precision, round(avg(rc), 6) AS recall FROM b GROUP BY 1""")
def retrieval_eval(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "predicted").orderBy(F.desc("score"), "id")
    r = log(spark, d).select(F.col("user_id").alias("query"), F.col("predicted").alias("category"), F.row_number().over(w).alias("rank"), "score")
    return T.retrieval_quality(r).select("category", "queries", *(r6(c, c) for c in ("hit_rate", "precision", "recall")))


for _name in ("ds_training", "ds_commands", "ds_relations", "ds_normalization"):

    @query(_name, f"SELECT id, corrected AS ground_truth, t FROM _classified ")
    def export(spark, d):
        return log(spark, d).select("id", F.col("corrected").alias("ground_truth"), "t")


@query("label_store_usage", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def label_store_usage(spark, d):
    return read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("snk_training_export", """
    SELECT id, to_json(struct_pack(text := concat('event ', id), labels := CASE WHEN corrected = predicted THEN [predicted] ELSE [corrected, predicted] END,
      label_scores := CASE WHEN corrected = predicted THEN [round(1 - score, 2)] ELSE [0e0, round(1 - score, 2)] END)) AS line FROM _classified WHERE 1 - score >= 0.7""")
def snk_training_export(spark, d):
    """One JSON line for each example that is sure enough: text, labels, and of each label the score (0 where none is known)."""
    c = log(spark, d).where("1 - score >= 0.7")
    same, score = F.col("corrected") == F.col("predicted"), rounded(1 - F.col("score"), 2)
    labels = F.when(same, F.array("predicted")).otherwise(F.array("corrected", "predicted"))
    scores = F.when(same, F.array(score)).otherwise(F.array(F.lit(0.0), score))
    line = F.to_json(F.struct(F.concat_ws("", F.lit("event "), "id").alias("text"), labels.alias("labels"), scores.alias("label_scores")))
    return c.select("id", line.alias("line"))
