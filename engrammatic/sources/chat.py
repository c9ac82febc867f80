"""Chat sources: sessions as turns paired with their answers, share trees, and plain text files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def paired_turns(messages: DataFrame, keep_alone: bool = True) -> DataFrame:
    """(session_id, turn, content, context): each user turn with the assistant turn right after it, or null.

    An assistant turn that answers none is a row of its own if ``keep_alone``. System turns and blank texts are dropped first.
    """
    m = messages.where("role IN ('user', 'assistant') AND trim(text) <> ''")
    w = Window.partitionBy("session_id").orderBy("turn", "message_id")
    m = m.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w), "last_role": F.lag("role").over(w)})
    rows = m.where("role = 'user' OR coalesce(last_role, '') <> 'user'") if keep_alone else m.where("role = 'user'")
    return rows.select("session_id", "turn", F.col("text").alias("content"), F.when((F.col("role") == "user") & (F.col("next_role") == "assistant"), F.col("next_text")).alias("context"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Messages of session files {sessionId, messages: [{role, content}]}."""
    schema = "sessionId string, messages array<struct<role:string,content:string>>, metadata struct<date:string>"
    s = spark.read.schema(schema).json(path, multiLine=True)
    return s.select(F.col("sessionId").alias("session_id"), F.posexplode("messages").alias("turn", "m")).select("session_id", F.col("turn").cast("long"), F.col("m.role").alias("role"), F.col("m.content").alias("text"), F.col("turn").cast("long").alias("message_id"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: (path, kind, content), trimmed; empty files are left out."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("content"))
    return t.where("content <> ''").withColumn("kind", F.when(F.col("path").endswith(".md"), "markdown").otherwise("text"))


_NODE = "struct<parent:string,children:array<string>,message:struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>>"
SHARE = f"title string, create_time double, mapping map<string,{_NODE}>"


def thread(mapping: Column) -> Column:
    """The messages of a share tree along its main thread, array<struct<role, text, at>>: from the first node that has no
    parent (or itself), always on to the first child, until there is none or one comes again. Nodes without a role or
    text give no message. The tree is one conversation's; it is walked in as many steps as it has nodes."""
    nodes = F.map_entries(mapping)
    root = F.try_element_at(F.filter(nodes, lambda e: e["value"]["parent"].isNull() | (e["value"]["parent"] == e["key"])), F.lit(1))["key"]
    start = F.struct(root.alias("now"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, _: Column) -> Column:
        child = F.try_element_at(F.try_element_at(mapping, acc["now"])["children"], F.lit(1))
        go = acc["now"].isNotNull() & ~F.array_contains(acc["seen"], F.coalesce(acc["now"], F.lit("")))
        return F.when(go, F.struct(child.alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen"))).otherwise(F.struct(F.lit(None).cast("string").alias("now"), acc["seen"].alias("seen")))

    path = F.aggregate(nodes, start, step)["seen"]
    text = lambda m: F.trim(F.array_join(F.filter(m["content"]["parts"], lambda x: x.isNotNull() & (x != "")), " "))
    messages = F.transform(path, lambda k: F.try_element_at(mapping, k)["message"])
    found = F.transform(messages, lambda m: F.struct(m["author"]["role"].alias("role"), text(m).alias("text"), m["create_time"].alias("at")))
    return F.filter(found, lambda m: m["role"].isNotNull() & m["text"].isNotNull() & (m["text"] != ""))


def share_chunks(shares: DataFrame) -> DataFrame:
    """(session_id, turn, title, content, context, at): each user message of a share's main thread with the assistant's
    message right after it, or null. shares has session_id and the columns of SHARE; other messages give no row."""
    m = shares.select("session_id", "title", F.posexplode(thread(F.col("mapping"))).alias("turn", "m"))
    w = Window.partitionBy("session_id").orderBy("turn")
    m = m.withColumn("next", F.lead("m").over(w)).where("m.role = 'user'")
    return m.select("session_id", F.col("turn").cast("long").alias("turn"), "title", F.col("m.text").alias("content"), F.when(F.col("next.role") == "assistant", F.col("next.text")).alias("context"), F.col("m.at").alias("at"))


def read_shares(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of share files; a file's path is its session_id."""
    return share_chunks(spark.read.schema(SHARE).json(path, multiLine=True).withColumn("session_id", F.input_file_name()))


#: Readers by source type, in the order in which they are asked; each with the paths that it takes.
READERS = {"chatgpt_share": (read_shares, r"(?i)share.*\.json$"), "session_json": (read_sessions, r"(?i)\.json$"), "text_file": (read_text, r"(?i)\.(?:txt|md)$")}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Reads a source by its kind, or by the first reader that takes its path; a path that none takes is an error."""
    for name, (reader, pattern) in READERS.items():
        if name == kind or kind is None and re.search(pattern, path):
            return reader(spark, path)
    raise ValueError(f"no reader for {path!r}" if kind is None else f"no source {kind!r}")


def text_records(files: DataFrame) -> DataFrame:
    """(path, kind, content, error) of text files (path, value): trimmed, an empty one with an error instead of content."""
    body = F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"^\s+|\s+$", ""))
    return files.select("path", F.when(F.col("path").rlike(r"(?i)\.md$"), "markdown").otherwise("text").alias("kind"), F.when(body != "", body).alias("content"), F.when(body == "", "empty file").alias("error"))
