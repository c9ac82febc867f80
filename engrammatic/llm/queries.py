"""The queries opN_<name>, each over the whole of its tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrammatic.llm import bpe_automaton, chat_format, decontamination, exact_dedup, secret_scan, simhash_golay, substring_dedup, token_counts, toxicity, url_templates


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_paragraphs(read(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(read(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.canonical_turns(chat_format.as_records(read(spark, sf_dir, "conversations")))
    return turns.select(F.col("record_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_documents(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the documents that pages carry the number of; a page is bad where quality is 0 or toxic is 1."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("cast(quality = 0 or toxic = 1 as int)").alias("bad"))
    return url_templates.filter_pages(read(spark, sf_dir, "pages"), labels)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_simhash_near_dedup,
        op3_toxicity,
        op4_secret_scan,
        op5_chat_formatting,
        op6_benchmark_decontamination,
        op7_token_counts,
        op8_bpe_automaton,
        op9_exact_dedup,
        op10_url_templates,
    )
}

def url_template_sql(levels: int = 6, passes: int = 3) -> str:
    """op10 as SQL: every pass merges the families of each level, deepest first. Deeper trees need more levels."""
    url = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
    ctes = [
        rf"""h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '{url}(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^(?:www|m)\.', '') AS host,
            list_transform(list_filter(string_split(lower(trim(regexp_replace(regexp_extract(url, '{url}[^/?#]*([^?#]*)', 1), '\.(?:html?|php|aspx?|jsp)/?$', ''))), '/'), lambda x: x <> ''),
                lambda x: CASE WHEN regexp_matches(x, '^[0-9][0-9._-]*$|^[0-9a-f]{{8,}}$|^[0-9a-f]{{8}}-[0-9a-f-]{{27}}$|[0-9]{{4,}}') THEN '*' ELSE x END) AS s FROM pages)""",
        "p AS (SELECT page_id, CASE WHEN host <> '' THEN host END AS host, CASE WHEN len(s) <= 24 THEN s ELSE list_append(s[1:23], array_to_string(s[24:], '/')) END AS path FROM h)",
        "l AS (SELECT doc_id AS page_id, count(*) AS labelled, sum(CAST(quality = 0 OR toxic = 1 AS BIGINT)) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY ALL)",
        "t0 AS MATERIALIZED (SELECT host, path, path AS t, coalesce(sum(labelled), 0) AS labelled, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN l USING (page_id) WHERE host IS NOT NULL GROUP BY ALL)",
    ]
    k = 0
    for _ in range(passes):
        for n in range(levels, 0, -1):
            ctes += [
                f"a{k} AS (SELECT host, t[1:{n - 1}] AS parent, t[{n}] AS seg, t[{n + 1}:] AS tail, sum(labelled) AS labelled, sum(bad) AS bad FROM t{k} WHERE len(t) >= {n} GROUP BY ALL)",
                f"b{k} AS (SELECT host, parent, seg, sum(labelled) AS labelled, sum(bad) AS bad, list(tail ORDER BY tail) AS below FROM a{k} GROUP BY host, parent, seg)",
                f"c{k} AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY host, parent) <= 20 THEN below END AS family FROM b{k})",
                f"d{k} AS (SELECT *, sum(labelled) OVER (PARTITION BY host, parent, family) AS al, sum(bad) OVER (PARTITION BY host, parent, family) AS ab FROM c{k})",
                f"""e{k} AS (SELECT *, CASE WHEN labelled = 0 THEN '+' WHEN round(bad / labelled - ab / al, 9) > round(1.96 * sqrt(ab / al * (1 - ab / al) / labelled), 9) THEN '+high'
                    WHEN round(bad / labelled - ab / al, 9) < -round(1.96 * sqrt(ab / al * (1 - ab / al) / labelled), 9) THEN '+low' ELSE '+' END AS kind FROM d{k})""",
                f"f{k} AS (SELECT *, count(*) OVER (PARTITION BY host, parent, family, kind) AS members FROM e{k})",
                f"""t{k + 1} AS MATERIALIZED (SELECT x.host, x.path, CASE WHEN members > 1 THEN list_concat(list_append(x.t[1:{n - 1}], kind), x.t[{n + 1}:]) ELSE x.t END AS t, x.labelled, x.bad
                    FROM t{k} x LEFT JOIN f{k} y ON x.host = y.host AND len(x.t) >= {n} AND x.t[1:{n - 1}] = y.parent AND x.t[{n}] = y.seg)""",
            ]
            k += 1
    ctes += [
        f"every AS (SELECT (coalesce(sum(bad), 0) + 0.5e0) / (coalesce(sum(labelled), 0) + 1e0) AS share FROM t{k})",
        f"hosts AS (SELECT host, (sum(bad) + 4e0 * any_value(share)) / (sum(labelled) + 4e0) AS share FROM t{k}, every GROUP BY host)",
        f"j AS (SELECT t.host, t, '/' || array_to_string(t, '/') AS template, round((sum(bad) + 4e0 * any_value(share)) / (sum(labelled) + 4e0), 6) AS purity FROM t{k} t JOIN hosts ON t.host = hosts.host GROUP BY t.host, t)",
    ]
    return f"""WITH {", ".join(ctes)}
        SELECT page_id, p.host, template, purity, coalesce(purity >= 0.5, false) AS rejected
        FROM p LEFT JOIN t{k} x ON p.host = x.host AND p.path = x.path LEFT JOIN j ON j.host = x.host AND j.t = x.t"""


ORACLE_SQL: dict[str, str] = {
    "op5_chat_formatting": """
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn, role, text
        FROM conversations
        WHERE conv_id IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''
    """,
    "op9_exact_dedup": """
        SELECT doc_id, kept_doc_id FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_doc_id,
                   row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
        WHERE n > 1
    """,
    "op10_url_templates": url_template_sql(),
}
