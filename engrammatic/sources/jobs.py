"""Ingestion jobs: which reader a job gets, and how far each came, for any number of jobs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrammatic.operators.relations import text_map

#: Reader by category and kind of source, for jobs that name none.
BY_CATEGORY = {"llm_chat/chatgpt": "chatgpt_share", "llm_chat/session_json": "session_json", "file/markdown": "text_file", "file/text_plain": "text_file", "file/pdf": "pdf_file", "file/paste": "text_paste"}
#: Readers that there are.
KNOWN = ("chatgpt_share", "session_json", "text_file", "text_paste")


def resolved(source_type: Column, category: Column, subtype: Column) -> Column:
    """The reader of a job: the one that it names, else that of its category and kind, else null."""
    named = F.when(F.trim(source_type) != "", source_type)
    return F.coalesce(named, F.try_element_at(text_map(BY_CATEGORY), F.concat_ws("/", F.lower(category), F.lower(subtype))))


def stages(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """(job_id, stage, name, ok, detail) of every stage that a job entered: validating, extracting, then done or failed.

    jobs: (job_id, source, source_type, category, subtype); found: (job_id, chunks) for sources that could be read. A job
    without a source fails in validating; one whose reader isn't known, or whose source couldn't be read, in extracting.
    """
    kind = resolved(F.col("source_type"), F.col("category"), F.col("subtype"))
    j = jobs.select("job_id", F.coalesce(F.trim("source") != "", F.lit(False)).alias("valid"), kind.alias("kind")).join(found, "job_id", "left")
    known = F.coalesce(F.col("kind").isin(*KNOWN), F.lit(False))
    read = known & F.col("chunks").isNotNull()
    why = F.when(~known, F.concat(F.lit("no reader "), F.coalesce("kind", F.lit("?")))).when(F.col("chunks").isNull(), F.lit("unreadable")).otherwise(F.concat(F.col("chunks").cast("string"), F.lit(" chunks")))
    record = lambda name, ok, detail: F.struct(F.lit(name).alias("name"), ok.alias("ok"), detail.alias("detail"))
    first = record("validating", F.col("valid"), F.when(F.col("valid"), "ok").otherwise("empty source"))
    second = record("extracting", read, why)
    end = F.when(F.col("valid") & read, record("done", F.lit(True), F.lit(""))).otherwise(record("failed", F.lit(False), F.lit("")))
    entered = F.when(F.col("valid"), F.array(first, second, end)).otherwise(F.array(first, end))
    return j.select("job_id", F.posexplode(entered).alias("stage", "s")).select("job_id", F.col("stage").cast("long").alias("stage"), "s.name", "s.ok", "s.detail")
