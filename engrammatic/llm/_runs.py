"""Rows that share a key, from partitions sorted by that key: each batch is cut into whole runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_runs(batches: Iterator[pa.RecordBatch | dict[str, np.ndarray]], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns as arrays, in pieces that never cut a run of equal keys. The rows must come sorted by key."""
    held: list[dict[str, np.ndarray]] = []  # parts of a run that has not ended
    for b in batches:
        now = b if isinstance(b, dict) else {n: np.asarray(b.column(n)) for n in b.schema.names}
        k = now[key]
        if not len(k):
            continue
        if held and k[-1] == held[0][key][0]:
            held.append({n: x.copy() for n, x in now.items()})
            continue
        cut = int(np.searchsorted(k, k[-1]))
        first = held + [{n: x[:cut] for n, x in now.items()}]
        out = {n: np.concatenate([x[n] for x in first]) for n in now} if held else first[0]
        if len(out[key]):
            yield out
        held = [{n: x[cut:].copy() for n, x in now.items()}]
    if held:
        yield {n: np.concatenate([x[n] for x in held]) for n in held[0]}


def in_blocks(rows: DataFrame, key: str, row: str, most: int) -> DataFrame:
    """The rows with a column ``block`` to group by: rows of one key meet in some block, and none has over 2 * most.

    A key of up to about ``most`` rows is one block. The rows of a larger one fall into parts by a hash of ``row``, and
    every two parts are a block, so that each row is in as many blocks as there are parts.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where(f"n > {most}").select(key, F.ceil(F.col("n") / (most / 2)).alias("parts"))
    x = rows.join(sizes, key, "left").withColumn("part", F.pmod(F.xxhash64(row), F.coalesce("parts", F.lit(1))))
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    block = F.when(F.col("parts").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(key, F.least("part", "with"), F.greatest("part", "with")))
    return x.withColumn("block", block).drop("parts", "part", "with")


def run_starts(k: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, with the length at the end."""
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else np.zeros(1, np.int64)


def spanning_edges(n: int, near, small: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that connect just what the graph of all near pairs among n items connects.

    near(i, others) gives a mask over the array of indices ``others`` and must be exact. Up to ``small`` items all pairs
    are given; beyond, a search from each item marks what it reaches, so that n mutual copies cost n comparisons.
    """
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    if n <= small:
        for i in range(n - 1):
            others = np.arange(i + 1, n)
            hit = others[near(i, others)]
            a.append(np.full(len(hit), i))
            b.append(hit)
    else:
        left = np.arange(n)
        front: list[int] = []
        while len(left):
            if front:
                i = front.pop()
            else:
                i, left = int(left[0]), left[1:]
            m = near(i, left)
            hit = left[m]
            if len(hit):
                a.append(np.full(len(hit), i))
                b.append(hit)
                front.extend(hit.tolist())
                left = left[~m]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)
