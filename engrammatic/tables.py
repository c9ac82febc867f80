"""The memory engine's tables, derived from the raw tables in Spark and, for the oracles, as SQL.

Times are microseconds since 1970 (bigint): every operator takes ``as_of`` explicitly and no session setting matters.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrammatic.dims import PARSED, SAYINGS

DAY = 86_400_000_000
#: 2024-02-01 and 2024-04-15, 00:00 UTC.
AS_OF, AS_OF_STALE = 1_706_745_600_000_000, 1_713_139_200_000_000

_UTTERANCE = """CASE event_type
    WHEN 'signup' THEN concat('My name is user ', user_id, ' and I work at org', k, '. I was very happy yesterday.')
    WHEN 'purchase' THEN concat('I really love item', k, '! My sister told me about it.')
    WHEN 'error' THEN concat('I hate the terrible item', k, ' error, maybe tomorrow it works.')
    WHEN 'view' THEN concat('What is item', k, '? I think it is definitely not good.')
    ELSE concat('/remember /private I want to visit place', k) END"""
_PREDICATE = "CASE event_type WHEN 'signup' THEN 'works_at' WHEN 'purchase' THEN 'likes' WHEN 'error' THEN 'dislikes' WHEN 'view' THEN 'interested_in' ELSE 'visited' END"



def _parsed_rows() -> str:
    rows = []
    for k, sentences in enumerate(PARSED):
        i = 0
        for sent, words in enumerate(sentences):
            for w in words.split():
                text, lemma, pos, dep, head, ent = w.rsplit("/", 5)
                rows.append(f"({k}, {sent}, {i}, '{text}', '{lemma}', '{pos}', '{dep}', {head}, {'NULL' if ent == '_' else repr(ent)})")
                i += 1
    return ", ".join(rows)


#: name: (what it is made from, columns, rest of the query). Every expression here means the same in both engines.
_SPEC: dict[str, tuple[str, str, str]] = {
    "_mentions": (
        "_ev",
        f"""event_id AS memory_id, user_id, concat('user', user_id) AS subject, {_PREDICATE} AS predicate, concat('item', k % 10) AS object,
            least(1e0, value / 100e0) AS confidence, least(1e0, value / 490e0) AS ego, CAST(floor(t / {DAY}e0) AS BIGINT) AS session, t AS observed_at""",
        "",
    ),
    "_raw_relations": (
        "_mentions",
        f"""memory_id AS relation_id, user_id, subject, predicate, object, memory_id, confidence, CAST(memory_id % 4 AS BIGINT) AS mentions,
            observed_at AS created_at, observed_at AS last_mentioned, observed_at AS effective_from,
            CASE WHEN memory_id % 7 = 0 THEN observed_at + 10 * {DAY} END AS effective_to,
            CASE WHEN memory_id % 11 = 0 THEN true WHEN memory_id % 3 = 0 THEN false END AS deprecated""",
        "",
    ),
    "_memories": (
        "_ev",
        f"""event_id AS node_id, user_id, CAST(1 + event_id % 4 AS INT) AS tier, {_UTTERANCE} AS content, least(1e0, value / 490e0) AS ego, t AS observed_at,
            CAST(event_id % 5 AS BIGINT) AS frequency_7d, CAST(event_id % 90 AS BIGINT) AS response_length, CAST(event_id % 3 AS BIGINT) AS followups,
            CAST(event_id % 6 AS BIGINT) AS refs, CASE WHEN event_id % 13 <> 0 THEN (event_id % 10) / 10e0 END AS novelty, k, event_type""",
        "",
    ),
    "_messages": (
        "conversations",
        f"""conv_id * 1000 + turn AS message_id, conv_id AS session_id, conv_id % 50 AS user_id, turn, role, text,
            {AS_OF - 30 * DAY} + (conv_id * 1000 + turn) * 60000000 AS created_at""",
        "",
    ),
    "_candidates": (
        "_mentions",
        """user_id, subject, predicate, object, CAST(count(*) AS BIGINT) AS evidence, CAST(count(DISTINCT session) AS BIGINT) AS sessions,
            min(observed_at) AS first_seen, max(observed_at) AS last_fired, max(ego) AS ego_max, avg(ego) AS ego_avg, avg(confidence) AS avg_confidence,
            CAST(min(memory_id) % 5 AS BIGINT) AS contradictions, CAST(min(memory_id) % 4 AS BIGINT) AS promotes, CAST(max(memory_id) % 3 AS BIGINT) AS demotes,
            concat(subject, '|', predicate, '|', object) AS candidate_id, CASE min(memory_id) % 7 WHEN 0 THEN 'promoted' WHEN 1 THEN 'expired' ELSE 'candidate' END AS status""",
        "GROUP BY user_id, subject, predicate, object",
    ),
    "_contradicts": (
        "_mentions",
        """memory_id AS src, memory_id * 7 % 13000 AS dst, confidence AS strength, memory_id % 5 <> 0 AS is_active,
            CASE memory_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'user' END AS resolved_by""",
        "WHERE predicate IN ('likes', 'dislikes')",
    ),
    "_vectors": ("embeddings", f"vec_id AS node_id, CAST(label AS BIGINT) AS user_id, embedding, {AS_OF} - (vec_id * 37 % 900) * {DAY} AS observed_at", ""),
    "_located": (
        "",
        """concat('c:', c_custkey) AS src, concat('n:', c_nationkey) AS dst, 'located_at' AS relation, 5e-1 + (c_custkey % 50) / 100e0 AS strength,
            c_custkey % 5 <> 0 AS is_active, CAST(c_custkey % 3 AS BIGINT) AS era FROM customer
        UNION ALL SELECT concat('s:', s_suppkey), concat('n:', s_nationkey), 'works_at', 5e-1 + (s_suppkey % 50) / 100e0, s_suppkey % 5 <> 0, CAST(s_suppkey % 3 AS BIGINT) FROM supplier
        UNION ALL SELECT concat('n:', n_nationkey), concat('r:', n_regionkey), 'part_of', 9e-1, true, CAST(0 AS BIGINT) FROM nation""",
        "",
    ),
    "_edges": (
        "_located",
        f"""concat(src, '>', dst) AS edge_id, src, dst, relation, CASE relation WHEN 'works_at' THEN 'professional' ELSE 'factual' END AS category, strength, is_active,
            CASE WHEN era > 0 THEN {AS_OF} - era * 20 * {DAY} END AS effective_from, CASE WHEN era = 2 THEN {AS_OF} - 5 * {DAY} END AS effective_to""",
        "",
    ),
    "_chain": (
        "",
        """a.o_orderkey AS src, b.o_orderkey AS dst, CASE a.o_orderkey % 4 WHEN 0 THEN 'evolves_to' WHEN 1 THEN 'supersedes' WHEN 2 THEN 'refines' ELSE 'clarifies' END AS relation,
            a.o_orderkey % 9 <> 0 AS is_active
        FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) a
        JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) b
          ON a.o_custkey = b.o_custkey AND b.n = a.n + 1""",
        "",
    ),
    "_entities": (
        "_ent",
        """concat('item', k) AS entity_id, user_id, concat('Item ', k) AS name, concat('thing', k) AS alias1, concat('it-', k % 7) AS alias2,
            CAST(count(*) AS BIGINT) AS frequency, max(t) AS updated_at""",
        "GROUP BY user_id, k",
    ),
    "_ent": ("_ev", "user_id, t, k % 10 AS k", ""),
    "_sayings": ("_ev JOIN _said ON event_id % " + str(len(SAYINGS)) + " = said_id", "event_id AS node_id, content", ""),
    "_said": ("", "said_id, content FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(SAYINGS)) + ") AS v(said_id, content)", ""),
    "_parsed": ("", f"tpl, sent, i, text, lemma, pos, dep, head, ent FROM (VALUES {_parsed_rows()}) AS v(tpl, sent, i, text, lemma, pos, dep, head, ent)", ""),
    "_tokens": (
        "_ev JOIN _parsed ON event_id % 12 = tpl",
        """event_id AS doc_id, sent, i, CASE WHEN ent = 'PERSON' AND k % 2 = 0 THEN concat(text, k) ELSE text END AS text, lemma, pos, dep, head, ent""",
        "",
    ),
    "_classified": (
        "_ev",
        f"""event_id AS id, t, event_type AS predicted, CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END AS corrected,
            CASE event_id % 3 WHEN 0 THEN 'semantic_validator' WHEN 1 THEN 'user' ELSE 'llm' END AS source,
            CASE event_id % 4 WHEN 0 THEN 'auto_accept' WHEN 1 THEN 'semantic_check' WHEN 2 THEN 'force_fallback' END AS routing,
            {_PREDICATE} AS relation, event_id % 5 < 2 AS promoted, least(1e0, value / 490e0) AS score, user_id, CAST(1 + event_id % 4 AS BIGINT) AS tier""",
        "",
    ),
}
RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
_EV_SQL = "SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def _statement(name: str) -> str:
    source, columns, rest = _SPEC[name]
    return f"SELECT {columns}" + (f" FROM {source} {rest}" if source else "")


def sql_of(name: str) -> str:
    """The DuckDB query that makes a derived table."""
    return _EV_SQL if name == "_ev" else _statement(name)


def _needs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\b_[a-z_]+\b", text)) if n == "_ev" or n in _SPEC]


def expand(body: str) -> str:
    """A query with the definitions of the derived tables that it names put before it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _needs(text):
            if n not in order:
                visit(sql_of(n))
                order.append(n)

    visit(body)
    body = body.strip()
    own = re.match(r"(?i)with\s+(?:recursive\s+)?", body)
    parts = [f"{n} AS ({sql_of(n)})" for n in order]
    if not parts:
        return body
    return "WITH RECURSIVE " + ", ".join(parts) + (", " + body[own.end() :] if own else " " + body)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table by its name without the underscore."""
    name = f"_{name}"
    if name == "_ev":
        e = read(spark, sf_dir, "events")
        return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    text = _statement(name)
    used = {n: table(spark, sf_dir, n[1:]) for n in _needs(text)}
    used |= {n: read(spark, sf_dir, n) for n in RAW if re.search(rf"\b(?:FROM|JOIN) {n}\b", text)}
    text = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text)
    return spark.sql(text, **used)


def select_any(df: DataFrame, condition_list) -> DataFrame:
    """Rows for which any of the conditions holds."""
    return df.where(reduce(lambda a, b: a | b, condition_list))
