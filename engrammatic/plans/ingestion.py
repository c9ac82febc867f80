"""Sources and versioned sinks over the derived messages and events."""

from pyspark.sql import functions as F

from engrammatic.registry import query
from engrammatic.sources import chat
from engrammatic.sources import jobs as J
from engrammatic.streaming import events as E
from engrammatic.tables import read, table

_PAIRED = """WITH m AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt, lag(role) OVER w AS lr FROM _messages WHERE role IN ('user', 'assistant') AND trim(text) <> '' WINDOW w AS (PARTITION BY session_id ORDER BY turn, message_id))
    SELECT session_id, turn, md5(text) AS content_md5, coalesce(md5(CASE WHEN role = 'user' AND nr = 'assistant' THEN nt END), '') AS context_md5 FROM m WHERE """
for _name in ("src_session_json", "win_turn_pairing"):

    @query(_name, _PAIRED + "role = 'user' OR lr IS DISTINCT FROM 'user'")
    def paired(spark, d):
        return chat.paired_turns(table(spark, d, "messages")).select("session_id", "turn", F.md5("content").alias("content_md5"), F.coalesce(F.md5("context"), F.lit("")).alias("context_md5"))


#: Conversations as share trees: a root without a message, a node for each turn, and after each its first child, which is
#: the next turn, and a regenerated answer that the main thread leaves out.
_TREES = """
    WITH m AS (SELECT session_id, turn, role, text, lead(turn) OVER (PARTITION BY session_id ORDER BY turn) AS next FROM {messages}),
    n AS (SELECT session_id, concat('n', turn) AS id, named_struct('parent', 'root', 'children', CASE WHEN next IS NULL THEN array() ELSE array(concat('n', next), concat('x', turn)) END,
        'message', named_struct('author', named_struct('role', role), 'content', named_struct('parts', array(text, '')), 'create_time', CAST(turn AS DOUBLE))) AS node FROM m
      UNION ALL SELECT session_id, concat('x', turn), named_struct('parent', concat('n', turn), 'children', array(), 'message', named_struct('author', named_struct('role', 'assistant'), 'content', named_struct('parts', array('again', '')), 'create_time', CAST(turn AS DOUBLE))) FROM m
      UNION ALL SELECT session_id, 'root', named_struct('parent', CAST(NULL AS STRING), 'children', array(concat('n', min(turn))), 'message', NULL) FROM m GROUP BY session_id)
    SELECT session_id, to_json(named_struct('title', concat('talk ', session_id), 'create_time', 1e0, 'mapping', map_from_entries(array_sort(collect_list(struct(id, node)))))) AS share FROM n GROUP BY session_id"""


@query("src_chatgpt_export", """
    WITH m AS (SELECT *, row_number() OVER w AS place, lead(role) OVER w AS nr, lead(trim(text)) OVER w AS nt FROM (SELECT * FROM _messages WHERE trim(text) <> '') WINDOW w AS (PARTITION BY session_id ORDER BY turn))
    SELECT session_id, place - 1 AS turn, 'talk ' || session_id AS title, md5(trim(text)) AS content_md5, coalesce(md5(CASE WHEN nr = 'assistant' THEN nt END), '') AS context_md5, CAST(turn AS DOUBLE) AS at FROM m WHERE role = 'user'""")
def src_chatgpt_export(spark, d):
    shares = spark.sql(_TREES, messages=table(spark, d, "messages")).select("session_id", F.from_json("share", chat.SHARE).alias("s")).select("session_id", "s.*")
    return chat.share_chunks(shares).select("session_id", "turn", "title", F.md5("content").alias("content_md5"), F.coalesce(F.md5("context"), F.lit("")).alias("context_md5"), "at")


_FILES = "SELECT concat('f', doc_id, CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.MD' ELSE '.txt' END) AS path, CASE WHEN doc_id % 10 = 0 THEN concat(' ', chr(10)) ELSE concat(' ', text, chr(10)) END AS value FROM documents"


@query("src_text_file", f"WITH f AS ({_FILES}), b AS (SELECT path, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS body FROM f) SELECT path, CASE WHEN lower(path) LIKE '%.md' THEN 'markdown' ELSE 'text' END AS kind, md5(body) AS content_md5, CASE WHEN body = '' THEN 'empty file' ELSE '' END AS error FROM b")
def src_text_file(spark, d):
    files = spark.sql(_FILES.replace("FROM documents", "FROM {documents}"), documents=read(spark, d, "documents"))
    return chat.text_records(files).select("path", "kind", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"), F.coalesce("error", F.lit("")).alias("error"))


@query("src_text_paste", "SELECT node_id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content, 'text' AS kind FROM _sayings")
def src_text_paste(spark, d):
    files = table(spark, d, "sayings").select(F.col("node_id").cast("string").alias("path"), F.col("content").alias("value"))
    return chat.text_records(files).select(F.col("path").cast("long").alias("node_id"), "content", "kind")


_VERSIONED = "SELECT user_id * 100 + k % 10 AS node_id, event_id % 4 AS version, event_id AS arrival, content, event_type FROM (SELECT e.*, m.content FROM _ev e JOIN _memories m ON m.node_id = e.event_id)"


def versioned(spark, d):
    m = table(spark, d, "memories")
    return m.select((F.col("user_id") * 100 + F.col("k") % 10).alias("node_id"), (F.col("node_id") % 4).alias("version"), F.col("node_id").alias("arrival"), "content", "event_type")


@query("snk_memory_upsert", f"WITH v AS ({_VERSIONED}) SELECT node_id, version, arrival, content FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY version DESC, arrival) AS n FROM v) WHERE n = 1")
def snk_memory_upsert(spark, d):
    return E.latest_versions(versioned(spark, d)).select("node_id", "version", "arrival", "content")


_PATCHED = "SELECT user_id * 100 + k % 10 AS node_id, event_id AS arrival, event_type = 'view' AS entities_only, CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('s', k) END AS summary, concat('text ', event_id) AS content, concat('e', event_id % 9) AS entities FROM _ev"


@query("snk_vector_upsert", f"""
    WITH p AS ({_PATCHED}), w AS (SELECT node_id, max(arrival) AS last_at FROM p WHERE NOT entities_only AND coalesce(nullif(summary, ''), content) <> '' GROUP BY 1),
    e AS (SELECT p.node_id, arg_max(entities, arrival) AS entities FROM p JOIN w ON w.node_id = p.node_id WHERE arrival >= last_at GROUP BY 1)
    SELECT w.node_id, coalesce(nullif(p.summary, ''), p.content) AS embedded, e.entities FROM w JOIN p ON p.node_id = w.node_id AND p.arrival = w.last_at JOIN e ON e.node_id = w.node_id""")
def snk_vector_upsert(spark, d):
    p = table(spark, d, "ev").select(
        (F.col("user_id") * 100 + F.col("k") % 10).alias("node_id"), F.col("event_id").alias("arrival"), (F.col("event_type") == "view").alias("entities_only"),
        F.when(F.col("event_id") % 6 == 0, "").otherwise(F.concat(F.lit("s"), "k")).alias("summary"), F.concat(F.lit("text "), "event_id").alias("content"), F.concat(F.lit("e"), F.col("event_id") % 9).alias("entities"),
    )
    return E.vector_upserts(p).select("node_id", "embedded", "entities")


_JOBS = """SELECT event_id AS job_id, CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN NULL ELSE concat('s', event_id) END AS source, CASE event_id % 5 WHEN 0 THEN 'session_json' WHEN 1 THEN 'ftp' WHEN 2 THEN '' END AS source_type,
    CASE WHEN event_id % 2 = 0 THEN 'FILE' ELSE 'llm_chat' END AS category, CASE event_id % 7 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'paste' WHEN 3 THEN 'chatgpt' WHEN 4 THEN 'text_plain' ELSE 'session_json' END AS subtype, k FROM _ev"""
_KIND = "CASE WHEN trim(source_type) <> '' THEN source_type ELSE CASE lower(category) || '/' || lower(subtype) " + " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in J.BY_CATEGORY.items()) + " END END"


@query("src_registry", f"SELECT job_id, coalesce({_KIND}, 'none') AS kind FROM ({_JOBS})")
def src_registry(spark, d):
    j = spark.sql(_JOBS.replace("FROM _ev", "FROM {ev}"), ev=table(spark, d, "ev"))
    return j.select("job_id", F.coalesce(J.resolved(F.col("source_type"), F.col("category"), F.col("subtype")), F.lit("none")).alias("kind"))


@query("src_pipeline_stages", f"""
    WITH j AS (SELECT job_id, coalesce(trim(source) <> '', false) AS valid, {_KIND} AS kind, CASE WHEN k % 4 > 0 THEN k END AS chunks FROM ({_JOBS})),
    r AS (SELECT *, coalesce(kind IN ('chatgpt_share', 'session_json', 'text_file', 'text_paste'), false) AS known FROM j)
    SELECT job_id, 0 AS stage, 'validating' AS name, valid AS ok, CASE WHEN valid THEN 'ok' ELSE 'empty source' END AS detail FROM r
    UNION ALL SELECT job_id, 1, 'extracting', known AND chunks IS NOT NULL, CASE WHEN NOT known THEN 'no reader ' || coalesce(kind, '?') WHEN chunks IS NULL THEN 'unreadable' ELSE chunks || ' chunks' END FROM r WHERE valid
    UNION ALL SELECT job_id, CASE WHEN valid THEN 2 ELSE 1 END, CASE WHEN valid AND known AND chunks IS NOT NULL THEN 'done' ELSE 'failed' END, valid AND known AND chunks IS NOT NULL, '' FROM r""")
def src_pipeline_stages(spark, d):
    j = spark.sql(_JOBS.replace("FROM _ev", "FROM {ev}"), ev=table(spark, d, "ev"))
    return J.stages(j, j.where("k % 4 > 0").select("job_id", F.col("k").alias("chunks")))
