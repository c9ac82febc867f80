"""Token counts by a map-side two-tier lookup.

The first tier is a compact table of how many tokens the corpus's frequent pieces have (a piece: a word with the space
before it and what clings to it, see _pieces), broadcast with the tasks. Its pieces are found in a first pass in which
every task counts the pieces of all its texts and hands on one row: a summary of its heaviest few thousand. Summaries
are merged to ever fewer of the same size; the tasks that make them are about as many as run at once (or as shuffles
have), whatever the size of the input. What the table doesn't have is encoded once and kept in the worker's cache, the second tier. No row of a
shuffle is a piece; counts are exact whatever either tier holds.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrammatic.llm._arrow import slices, worker_cache
from engrammatic.llm._pieces import PATTERN, SLICE, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces in the broadcast table, and in each task's list; least count in a slice of 8 MB for a piece to be counted on.
TABLE, TASK_TABLE, LEAST = 32_768, 4_096, 4
#: Pieces of up to LONGEST letters that a worker keeps before it starts afresh, about 35 MB.
CACHED, LONGEST = 150_000, 64
#: Summaries that one task merges, and that the driver does.
MERGED = 32


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to ids, from a file of lines 'base64 id'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_SUMMARY = "pieces array<string>, counts array<long>"


def _summary(seen: Counter, most: int) -> pa.RecordBatch:
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]
    return pa.RecordBatch.from_arrays([pa.array([[p for p, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["pieces", "counts"])


def heavy_rows(batches: Iterator[pa.RecordBatch], most: int, least: int) -> Iterator[pa.RecordBatch]:
    """One task's most frequent pieces. Of its counts the smaller half is forgotten whenever there are too many."""
    seen: Counter = Counter()
    for batch in batches:
        for s in slices(batch, "text", SLICE):
            names, at, _ = pieces(s.column("text"))
            n = np.bincount(at, minlength=len(names))
            for i in np.flatnonzero(n >= least):
                seen[names[i]] += int(n[i])
            if len(seen) > 16 * most:
                seen = Counter(dict(seen.most_common(8 * most)))
    yield _summary(seen, most)


def merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One summary of summaries."""
    seen: Counter = Counter()
    for b in batches:
        for names, counts in zip(b.column("pieces"), b.column("counts")):
            for p, n in zip(names.as_py(), counts.as_py()):
                seen[p] += n
            if len(seen) > 16 * most:
                seen = Counter(dict(seen.most_common(8 * most)))
    yield _summary(seen, most)


def frequent_pieces(docs: DataFrame, table: int = TABLE, task_table: int = TASK_TABLE, least: int = LEAST) -> list[str]:
    """The pieces for the first tier, at most ``table``, from counts over all texts."""
    plain = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    spark = docs.sparkSession
    n = max(MERGED, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = plain.coalesce(n).mapInArrow(lambda it: heavy_rows(it, task_table, least), _SUMMARY)  # no shuffle: a task reads several parts
    most = max(table, task_table)
    while n > MERGED:
        n = -(-n // MERGED)
        rows = rows.repartition(n).mapInArrow(lambda it: merged(it, most), _SUMMARY)
    seen: Counter = Counter()
    for r in rows.collect():  # at most MERGED rows
        for p, c in zip(r.pieces, r.counts):
            seen[p] += c
    return [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table]]


def _encoder(ranks: dict[bytes, int]):
    import tiktoken

    cache = worker_cache("encoder", (len(ranks), hash(tuple(list(ranks.items())[-50:]))))
    if "encode" not in cache:
        cache["encode"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        cache["known"] = {}
    return cache["encode"], cache["known"]


def count_rows(batches: Iterator[pa.RecordBatch], table: dict[str, int], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    encode, known = _encoder(ranks)
    for batch in batches:
        for s in slices(batch, "text", SLICE):
            names, at, off = pieces(s.column("text"))
            size = np.zeros(len(names), np.int64)
            for i, p in enumerate(names):
                n = table.get(p)
                if n is None:
                    n = known.get(p)
                    if n is None:
                        n = len(encode(p))
                        if len(p) <= LONGEST:
                            if len(known) >= CACHED:
                                known.clear()
                            known[p] = n
                size[i] = n
            total = np.concatenate([[0], np.cumsum(size[at])])
            null = np.asarray(pc.is_null(s.column("text")))
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(total[off[1:]] - total[off[:-1]], pa.int64(), mask=null)], names=["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, table: int = TABLE) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs.

    docs needs doc_id (integer) and text; vocabulary is the path of a byte-level BPE vocabulary on the driver.
    A null text has a null count, an empty text 0 tokens; a null doc_id stays null. Texts of any length are counted
    whole. Repeated rows give repeated results; an empty table gives no rows. Other columns are not read.
    """
    ranks = read_ranks(vocabulary)
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    first = {p: len(encode(p)) for p in frequent_pieces(docs, table)}
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lambda it: count_rows(it, first, ranks), "doc_id long, n_tokens long")
