"""Text rules over the derived memories and, for lengths, sentences and personal data, over all documents."""

from pyspark.sql import functions as F

from engrammatic import dims as D
from engrammatic.operators import text as X
from engrammatic.operators.scoring import rounded
from engrammatic.registry import query
from engrammatic.tables import read, table


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(map(quote, words)) + ")"


def mem(spark, d):
    return table(spark, d, "memories")


for _kind in D.PII:

    @query(f"pii_detect_{_kind}", f"SELECT doc_id, CAST(len(regexp_extract_all(text, {quote(D.PII[_kind][0])})) AS BIGINT) AS found FROM documents")
    def pii_detect(spark, d, kind=_kind):
        return read(spark, d, "documents").select("doc_id", X.pii_kinds(F.col("text"))[kind].alias("found"))


_MASK = "text"
for _p, _to in D.PII.values():
    _MASK = f"regexp_replace({_MASK}, {quote(_p)}, '{_to}', 'g')"


@query("pii_mask", f"SELECT doc_id, md5({_MASK}) AS masked_md5, {_MASK} <> text AS changed FROM documents")
def pii_mask(spark, d):
    m = X.pii_masked(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(m).alias("masked_md5"), (m != F.col("text")).alias("changed"))


@query("trigger_detect", "SELECT node_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(content, {quote(p)}) THEN '{n}' END" for n, p in D.TRIGGERS.items()) + ") AS triggers FROM _memories")
def trigger_detect(spark, d):
    return mem(spark, d).select("node_id", F.array_join(X.triggers(F.col("content")), ",").alias("triggers"))


_SENT = f"""
    WITH t AS (SELECT node_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'), 1) AS i FROM _memories),
    p AS (SELECT *, lag(w) OVER (PARTITION BY node_id ORDER BY i) AS p FROM t),
    s AS (SELECT node_id, CASE WHEN w IN {listed(D.POSITIVE)} THEN 1 WHEN w IN {listed(D.NEGATIVE)} THEN -1 ELSE 0 END * CASE WHEN p IN {listed(D.NEGATIONS)} THEN -1e0 WHEN p IN {listed(D.INTENSIFIERS)} THEN 1.5e0 WHEN p IN {listed(D.DIMINISHERS)} THEN 0.5e0 ELSE 1e0 END AS v FROM p)
    SELECT node_id, round(sum(v) / count(*), 6) AS valence, round(abs(sum(v) / count(*)), 6) AS intensity FROM s GROUP BY node_id"""


@query("sentiment", _SENT)
def sentiment(spark, d):
    return mem(spark, d).withColumn("s", X.sentiment(F.col("content"))).select("node_id", (F.round("s", 6) + 0.0).alias("valence"), F.round(F.abs("s"), 6).alias("intensity"))


_RULES = " AND ".join(f"NOT (label = '{n}' AND (regexp_matches(content, {quote(a)}) OR length(content) < {m}" + (f" OR NOT regexp_matches(content, {quote(b)})" if b else "") + "))" for n, (a, b, m) in D.LABEL_RULES.items())
_THR = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.LABEL_THRESHOLDS.items()) + " ELSE 0.5 END"


@query("label_filter", "WITH l AS (SELECT node_id, content, ego, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, {quote(p)}) THEN '{n}' END" for n, p in D.TRIGGERS.items()) + f"], lambda x: x IS NOT NULL)) AS label FROM _memories) SELECT node_id, label FROM l WHERE ego >= {_THR} AND {_RULES}")
def label_filter(spark, d):
    m = mem(spark, d).select("node_id", "content", "ego", F.explode(X.triggers(F.col("content"))).alias("label"))
    return m.where(X.label_kept(F.col("label"), F.col("ego"), F.col("content"))).select("node_id", "label")


@query("intent_classify", "SELECT node_id, CASE " + " ".join(f"WHEN regexp_matches(lower(content), {quote(p)}) THEN '{n}'" for n, p in D.INTENTS.items()) + " ELSE 'fact' END AS intent FROM _memories")
def intent_classify(spark, d):
    return mem(spark, d).select("node_id", X.intent(F.col("content")).alias("intent"))


_HEU = " ".join(f"WHEN regexp_matches(lower(content), {quote(w)}) THEN '{r}|{c}|{x}'" for w, r, c, x in D.HEURISTIC_RELATIONS)


@query("relation_heuristic", f"WITH h AS (SELECT node_id, CASE {_HEU} ELSE 'knows|personal|0.3' END AS h FROM _memories) SELECT node_id, split_part(h, '|', 1) AS relation, split_part(h, '|', 2) AS category, CAST(split_part(h, '|', 3) AS DOUBLE) AS confidence FROM h")
def relation_heuristic(spark, d):
    return mem(spark, d).select("node_id", X.heuristic_relation(F.col("content")).alias("r")).select("node_id", "r.*")


@query("predicate_normalize", "WITH c AS (SELECT candidate_id, predicate, CASE predicate " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.PREDICATES.items()) + " END AS m FROM _candidates) SELECT candidate_id, coalesce(m, predicate) AS predicate, CASE WHEN m IS NOT NULL THEN 0.95e0 ELSE 0.7e0 END AS confidence, CASE WHEN m IS NOT NULL THEN 'lexicon' ELSE 'original' END AS method FROM c")
def predicate_normalize(spark, d):
    return table(spark, d, "candidates").select("candidate_id", X.predicate_normalised(F.col("predicate"), F.lit("PERSON"), F.lit("ORG")).alias("r")).select("candidate_id", "r.*")


_TYPED = "SELECT node_id, CASE k % 4 WHEN 0 THEN 'holds_title' WHEN 1 THEN 'employed_by' WHEN 2 THEN 'located_in' ELSE 'has_age' END AS p, CASE tier WHEN 1 THEN 'ORG' ELSE 'person' END AS st, CASE refs WHEN 0 THEN 'ROLE' WHEN 1 THEN 'ORG' WHEN 2 THEN 'GPE' WHEN 3 THEN 'DATE' ELSE 'value' END AS ot, CASE followups WHEN 0 THEN concat('', k) WHEN 1 THEN concat(k, '%') ELSE concat('item', k) END AS o FROM _memories"


@query("relation_validate", f"""WITH t AS ({_TYPED}) SELECT node_id, CASE WHEN p IN ('holds_title', 'employed_by', 'has_age') AND st <> 'person' OR p = 'holds_title' AND ot <> 'ROLE' OR p = 'employed_by' AND ot <> 'ORG' OR p = 'located_in' AND ot <> 'GPE' OR p = 'has_age' AND ot NOT IN ('DATE', 'value')
    THEN 0.3e0 WHEN regexp_matches(o, '^[0-9]+%?$') THEN 0.1e0 ELSE 1e0 END AS multiplier FROM t""")
def relation_validate(spark, d):
    t = spark.sql(_TYPED.replace("_memories", "{m}"), m=mem(spark, d))
    return t.select("node_id", X.relation_multiplier(F.col("p"), F.col("st"), F.col("o"), F.col("ot")).alias("multiplier"))


@query("category_infer", "SELECT candidate_id, coalesce(CASE predicate " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.CATEGORY_OF.items()) + " END, 'general') AS category FROM _candidates")
def category_infer(spark, d):
    return table(spark, d, "candidates").select("candidate_id", F.coalesce(F.try_element_at(X.text_map(D.CATEGORY_OF), F.col("predicate")), F.lit("general")).alias("category"))


_PARTS = "list_filter(string_split(regexp_replace(trim({t}), '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: len(regexp_split_to_array(trim(s), '\\s+')) >= 3)"
_SENTS = "CASE WHEN len({p}) > 0 THEN {p} ELSE [trim({t})] END".format(p=_PARTS, t="{t}")


@query("sentence_split", f"WITH s AS (SELECT doc_id, unnest({_SENTS.format(t='text')}) AS s FROM documents) SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars FROM s GROUP BY 1")
def sentence_split(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s").cast("long")).alias("chars"))


@query("sentence_metadata", f"WITH s AS (SELECT node_id, unnest({_SENTS.format(t='content')}) AS s, generate_subscripts({_SENTS.format(t='content')}, 1) - 1 AS idx FROM _memories) SELECT node_id, idx, len(regexp_split_to_array(trim(s), '\\s+')) AS word_count, length(s) AS char_count FROM s")
def sentence_metadata(spark, d):
    s = mem(spark, d).select("node_id", F.posexplode(X.sentences(F.col("content"))).alias("idx", "s"))
    return s.select("node_id", F.col("idx").cast("long").alias("idx"), F.size(F.split(F.trim("s"), r"\s+")).cast("long").alias("word_count"), F.length("s").cast("long").alias("char_count"))


_KEPT = f"list_filter({{s}}, lambda x: NOT (rtrim(x) LIKE '%?') AND NOT regexp_matches(lower(x[1:20]), '{X.QUESTION_WORDS}'))"


@query("memory_sentences", f"WITH s AS (SELECT node_id, {_SENTS.format(t='content')} AS s FROM _memories), k AS (SELECT *, {_KEPT.format(s='s')} AS k FROM s) SELECT node_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE s END, '|') AS kept FROM k")
def memory_sentences(spark, d):
    return mem(spark, d).select("node_id", F.array_join(X.memory_sentences(F.col("content")), "|").alias("kept"))


_DIALOGUE = "SELECT node_id, CASE tier WHEN 1 THEN concat('Anna: I love item', k, '\\nBen: I''m happy for you') WHEN 2 THEN concat('DATE: 2023-05-0', 1 + k % 9, '\\nAnna: my dog is here') WHEN 3 THEN concat('Ben said, \"item', k, '\"') ELSE content END AS text FROM _memories"
_DIALOGUE_SQL = _DIALOGUE.replace("\\n", "' || chr(10) || '")


def dialogues(spark, d):
    return spark.sql(_DIALOGUE.replace("_memories", "{m}").replace("I''m", "I\\'m"), m=mem(spark, d))


@query("dialogue_detect", f"""WITH t AS ({_DIALOGUE_SQL} UNION ALL SELECT -1 - node_id, content FROM _sayings) SELECT node_id, CASE WHEN regexp_matches(text, '(?i)\\bDATE:') OR regexp_matches(text, '\\w+ said, ?"') THEN 'locomo'
    WHEN len(regexp_extract_all(text, '(?m)^\\w+:\\s+\\S')) >= 2 OR len(regexp_extract_all(text, '\\b[A-Z][a-z]+:\\s+')) >= 2 THEN 'raw_dialogue' ELSE 'narrative' END AS format FROM t""")
def dialogue_detect(spark, d):
    t = dialogues(spark, d).unionAll(table(spark, d, "sayings").select((-1 - F.col("node_id")).alias("node_id"), "content"))
    return t.select("node_id", X.dialogue_format(F.col("text")).alias("format"))


@query("dialogue_turns", f"WITH t AS ({_DIALOGUE_SQL}), l AS (SELECT node_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t), s AS (SELECT *, regexp_extract(line, '^(\\w+):\\s*(.+)$', 1) AS speaker, trim(regexp_extract(line, '^(\\w+):\\s*(.+)$', 2)) AS said FROM l) SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY i) - 1 AS turn, speaker, said FROM s WHERE speaker <> ''")
def dialogue_turns(spark, d):
    return dialogues(spark, d).select("node_id", F.posexplode(X.dialogue_turns(F.col("text"))).alias("turn", "t")).select("node_id", F.col("turn").cast("long").alias("turn"), "t.*")


def _replaced(text: str, steps) -> str:
    """SQL that replaces patterns by strings one after the other."""
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


_TOLD = _replaced("text", [*((p.replace("'", "''"), quote("Anna" + e)) for p, e in X._THIRD), (rf"\b(Anna)\s+({X._VERBS})\b", r"'\1 \2s'"), (r"\b(Anna)\s+study\b", r"'\1 studies'")])


@query("third_person", f"WITH t AS ({_DIALOGUE_SQL} UNION ALL SELECT -1 - node_id, content FROM _sayings) SELECT node_id, md5({_TOLD}) AS told FROM t")
def third_person(spark, d):
    t = dialogues(spark, d).unionAll(table(spark, d, "sayings").select((-1 - F.col("node_id")).alias("node_id"), "content"))
    return t.select("node_id", F.md5(X.third_person(F.col("text"), F.lit("Anna"))).alias("told"))


@query("alias_extract", "WITH n AS (SELECT DISTINCT c_mktsegment AS s FROM customer UNION SELECT DISTINCT substr(c_mktsegment, 1, 4) FROM customer) SELECT a.s AS alias, b.s AS name FROM n a JOIN n b ON starts_with(b.s, a.s) AND length(a.s) < length(b.s)")
def alias_extract(spark, d):
    c = read(spark, d, "customer")
    n = c.select(F.col("c_mktsegment").alias("s")).union(c.select(F.substring("c_mktsegment", 1, 4))).distinct()
    a, b = n.select(F.col("s").alias("alias")), n.select(F.col("s").alias("name"))
    # The first three letters, which an alias has in common with the name, make it an equi-join.
    return a.join(b, (F.substring("alias", 1, 3) == F.substring("name", 1, 3)) & F.expr("startswith(name, alias) AND length(alias) < length(name)"))


@query("date_parse", "WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d/%m/%Y') WHEN 2 THEN strftime(ts, '%B %-d, %Y') WHEN 3 THEN strftime(ts, '%-d %B %Y') ELSE 'soon' END AS s, ts FROM events) SELECT event_id, s, CASE WHEN s = 'soon' THEN 'none' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM t")
def date_parse(spark, d):
    t = F.col("ts").cast("timestamp")
    n = F.col("event_id") % 5
    s = F.when(n == 0, F.date_format(t, "yyyy-MM-dd")).when(n == 1, F.date_format(t, "dd/MM/yyyy")).when(n == 2, F.date_format(t, "MMMM d, yyyy")).when(n == 3, F.date_format(t, "d MMMM yyyy")).otherwise("soon")
    return read(spark, d, "events").select("event_id", s.alias("s")).withColumn("day", F.coalesce(F.date_format(X.date_parsed(F.col("s")), "yyyy-MM-dd"), F.lit("none")))


_RESOLVED = _replaced("content", ((rf"(?i)\b{w}\b", f"'{w} (' || strftime(DATE '2024-02-01' + {n}, '%B %d, %Y') || ')'") for w, n in X.TEMPORAL.items()))
_SAID = "(SELECT node_id, content FROM _memories UNION ALL SELECT -1 - node_id, content FROM _sayings)"


def said(spark, d):
    return mem(spark, d).select("node_id", "content").unionAll(table(spark, d, "sayings").select((-1 - F.col("node_id")).alias("node_id"), "content"))


@query("temporal_resolve", f"SELECT node_id, {_RESOLVED} AS told FROM {_SAID}")
def temporal_resolve(spark, d):
    return said(spark, d).select("node_id", X.temporal_resolved(F.col("content"), F.lit("2024-02-01").cast("date")).alias("told"))


_KNOWN = "|".join(sorted({*D.COMMANDS, *D.COMMAND_ALIASES}, key=len, reverse=True))
_NAMED = "CASE c " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in D.COMMAND_ALIASES.items()) + " ELSE c END"
_WEIGHT = "CASE c " + " ".join(f"WHEN '{a}' THEN {b[2]}e0" for a, b in D.COMMANDS.items()) + " END"


@query("command_parse", f"""
    WITH r AS (SELECT node_id, content, regexp_extract(content, '(?i)^\\s*((?:/(?:{_KNOWN})(?:\\s+|$))*)', 1) AS run FROM {_SAID}),
    n AS (SELECT *, list_transform(regexp_extract_all(lower(run), '/(\\S+)', 1), lambda c: {_NAMED}) AS names FROM r)
    SELECT node_id, array_to_string(names, ',') AS names, coalesce(list_max(list_transform(names, lambda c: {_WEIGHT})), 0.5e0) AS weight, trim(substr(ltrim(content), length(run) + 1)) AS target FROM n""")
def command_parse(spark, d):
    return said(spark, d).select("node_id", X.commands(F.col("content")).alias("c")).select("node_id", F.array_join("c.names", ",").alias("names"), "c.weight", "c.target")


@query("command_pattern", "SELECT node_id, CASE " + " ".join(f"WHEN regexp_matches(lower(trim(content)), {quote(p)}) THEN {quote(f)}" for p, f in D.COMMAND_PATTERNS) + " ELSE array_to_string(regexp_split_to_array(lower(trim(content)), '\\s+')[1:3], ' ') END AS pattern FROM _memories")
def command_pattern(spark, d):
    return mem(spark, d).select("node_id", X.command_pattern(F.col("content")).alias("pattern"))


@query("type_infer", f"SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '{'|'.join(D.ORG_WORDS)}') THEN 'organization' WHEN regexp_matches(lower(p_name), '{'|'.join(D.PLACE_WORDS)}') THEN 'location' ELSE 'person' END AS kind FROM part")
def type_infer(spark, d):
    return read(spark, d, "part").select("p_partkey", X.entity_type(F.col("p_name")).alias("kind"))


_PREP = "SELECT node_id, CASE k % 5 WHEN 0 THEN 'in' WHEN 1 THEN 'at' WHEN 2 THEN 'for' WHEN 3 THEN 'with' ELSE 'by' END AS prep, CASE refs WHEN 0 THEN 'ROLE' WHEN 1 THEN 'ORG' WHEN 2 THEN 'GPE' WHEN 3 THEN 'DATE' ELSE 'MATERIAL' END AS ot, CASE tier WHEN 1 THEN 'ROLE' ELSE 'person' END AS st, CASE followups WHEN 0 THEN 'manager' WHEN 1 THEN 'owner' ELSE 'fan' END AS head FROM _memories"


@query("prep_predicate", f"WITH t AS ({_PREP}) SELECT node_id, CASE WHEN prep = 'with' THEN 'associated_with' WHEN prep = 'in' AND ot = 'GPE' THEN 'located_in' WHEN prep = 'in' AND ot = 'DATE' THEN 'occurred_in' WHEN prep = 'at' AND ot = 'ORG' THEN 'works_at' WHEN prep = 'at' AND ot = 'DATE' THEN 'occurred_at' WHEN prep = 'for' AND ot = 'ORG' THEN 'works_for' WHEN prep = 'by' AND ot = 'ROLE' THEN 'created_by' ELSE 'base' END AS predicate FROM t")
def prep_predicate(spark, d):
    t = spark.sql(_PREP.replace("_memories", "{m}"), m=mem(spark, d))
    return t.select("node_id", X.preposition_predicate(F.col("prep"), F.col("ot"), F.lit("base")).alias("predicate"))


@query("of_relation", f"WITH t AS ({_PREP}) SELECT node_id, CASE WHEN st = 'person' AND ot = 'GPE' THEN 'located_in' WHEN st = 'person' AND ot = 'ORG' THEN CASE head WHEN 'manager' THEN 'manages' WHEN 'owner' THEN 'owns' ELSE 'works_at' END WHEN st = 'ROLE' AND ot = 'ORG' THEN 'works_at' WHEN ot = 'MATERIAL' THEN 'made_of' ELSE 'part_of' END AS relation FROM t")
def of_relation(spark, d):
    t = spark.sql(_PREP.replace("_memories", "{m}"), m=mem(spark, d))
    return t.select("node_id", X.of_relation(F.col("st"), F.col("ot"), F.col("head")).alias("relation"))


@query("is_a_filter", f"WITH t AS ({_PREP}) SELECT node_id, ot FROM t WHERE NOT (prep = 'in' AND ot IN ('GPE', 'DATE', 'ORG'))")
def is_a_filter(spark, d):
    t = spark.sql(_PREP.replace("_memories", "{m}"), m=mem(spark, d))
    return t.where(~((F.col("prep") == "in") & F.col("ot").isin("GPE", "DATE", "ORG"))).select("node_id", "ot")


@query("relation_context_format", "SELECT user_id, string_agg(printf('  - %s %s %s (confidence: %.2f)', subject, replace(predicate, '_', ' '), object, round(confidence, 2)), chr(10) ORDER BY relation_id) AS context FROM _raw_relations GROUP BY 1")
def relation_context_format(spark, d):
    r = table(spark, d, "raw_relations")
    line = F.format_string("  - %s %s %s (confidence: %.2f)", "subject", F.translate("predicate", "_", " "), "object", rounded(F.col("confidence"), 2))
    g = r.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("relation_id", line.alias("line")))).alias("l"))
    return g.select("user_id", F.array_join(F.col("l.line"), "\n").alias("context"))


@query("token_count", "SELECT message_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM _messages")
def token_count(spark, d):
    return table(spark, d, "messages").select("message_id", F.floor(F.length("text") / 4).cast("long").alias("tokens"))


@query("summary_truncate", "SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END) AS summary_md5 FROM documents")
def summary_truncate(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(X.truncated(F.col("text"))).alias("summary_md5"))


@query("consolidation_normalize", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda x: lower(trim(x))), lambda x: length(x) > 1)[1:20], ' ') AS items FROM documents")
def consolidation_normalize(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(X.consolidated(F.split("text", " ")), " ").alias("items"))


@query("levenshtein_ratio", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance, round(1 - levenshtein(a.n_name, b.n_name) / CAST(greatest(length(a.n_name), length(b.n_name)) AS DOUBLE), 6) AS ratio FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def levenshtein_ratio(spark, d):
    n = read(spark, d, "nation")
    j = n.select("n_regionkey", F.col("n_name").alias("a")).join(n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey").where("a < b")
    dist = F.levenshtein("a", "b")
    return j.select("a", "b", dist.cast("long").alias("distance"), F.round(1 - dist / F.greatest(F.length("a"), F.length("b")), 6).alias("ratio"))


@query("opinion_extract", "WITH o AS (SELECT node_id, unnest([" + ", ".join(f"struct_pack(r := '{r}', c := {c}e0, o := regexp_extract_all(content, {quote(p)}, 1))" for p, r, c in X.OPINIONS) + "]) AS s FROM _memories) SELECT node_id, s.r AS relation, lower(unnest(s.o)) AS object, s.c AS confidence FROM o")
def opinion_extract(spark, d):
    return mem(spark, d).select("node_id", F.explode(X.opinions(F.col("content"))).alias("o")).select("node_id", "o.*")


@query("embed_text", """
    WITH w AS (SELECT node_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+')) AS t FROM (SELECT node_id, content FROM _memories UNION ALL SELECT -1 - node_id, content FROM _sayings)),
    c AS (SELECT node_id, CAST(concat('0x', substr(md5(t), 1, 2)) AS INTEGER) AS place, count(*) AS n FROM w GROUP BY ALL)
    SELECT node_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY node_id)), 6) AS value FROM c""")
def embed_text(spark, d):
    v = said(spark, d).select("node_id", F.explode(X.embedded(F.col("content"))).alias("v"))
    return v.select("node_id", "v.place", F.round("v.value", 6).alias("value"))
