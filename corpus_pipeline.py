"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage takes and (but for the last) returns the columns of documents, whatever they are called; only doc_id and
text are looked at. Rows with a null doc_id or text, and empty texts, pass every stage unless it says otherwise; texts
count whole, however long; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrammatic.llm import bpe_automaton, decontamination, exact_dedup, simhash_golay, toxicity
from engrammatic.llm._shared import drop_ids, written


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, rejects go; repeated rows fare alike. Without
    labels of both classes nothing is toxic and all stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text one stays, that with the least doc_id, and of its repeated rows one; empty texts are
    equal to each other. Rows with a null doc_id or text all stay."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, that with the least doc_id; its repeated rows stay with it.
    Texts without words are no one's duplicates."""
    groups = simhash_golay.near_duplicates(docs)
    return drop_ids(docs, written(groups.where("doc_id <> kept_doc_id").select("doc_id")))


#: Equal words from which an overlap is evidence: an item of fewer words may stand in any text.
EVIDENCE = 5


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item in EVIDENCE words or more go, with all rows of their doc_id."""
    found = decontamination.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.col("n_equal") >= EVIDENCE)
    return drop_ids(docs, written(found.select("doc_id").distinct()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with proof that they decode to its text; of a null text nulls, of an empty one none."""
    return bpe_automaton.encode_documents(docs)


STAGES = [
    ("toxicity", toxic_filter),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: Dictionaries, fingerprints and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; every stage's result is a written table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
