"""Operators that keep state between batches: what waits for a decision, buffers with a time to live, windows of late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 86_400_000


def shadow_lifecycle(events: DataFrame, days: int = 7, late: str = "1 hour") -> DataFrame:
    """A stream of (node_id, kind, at) as one of changes (node_id, state, at), at being timestamps.

    'created' makes a node pending, 'approved' or 'rejected' decide it; a node that nobody has decided ``days`` after its
    creation is auto_promoted when the watermark passes that time. What comes after a decision, or before a creation,
    changes nothing. State is a row a node, and it goes with the decision.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            (created,) = state.get
            out.append((key[0], "auto_promoted", pd.Timestamp(created + days * DAY_MS, unit="ms")))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "kind"], key=lambda c: c if c.name == "at" else c != "created", kind="stable")
            for kind, at in zip(rows["kind"], rows["at"]):
                if kind == "created" and not state.exists:
                    state.update((int(at.timestamp() * 1000),))
                    out.append((key[0], "pending", at))
                elif kind in ("approved", "rejected") and state.exists:
                    state.remove()
                    out.append((key[0], kind, at))
            if state.exists:
                due = state.get[0] + days * DAY_MS
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["node_id", "state", "at"])

    e = events.withWatermark("at", late).groupBy("node_id")
    return e.applyInPandasWithState(step, "node_id long, state string, at timestamp", "created long", "append", GroupStateTimeout.EventTimeTimeout)


def buffered(events: DataFrame, ttl_seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """A stream of (node_id, at, flush) as one of (node_id, n, reason): how many items of a node were held when a flush
    came ('flushed'), or when the last of them had waited ``ttl_seconds`` and they were given up ('expired')."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], n, "expired")], columns=["node_id", "n", "reason"])
            return
        n, last = state.get if state.exists else (0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for at, flush in zip(rows["at"], rows["flush"]):
            if flush:
                if n:
                    out.append((key[0], n, "flushed"))
                n = 0
            else:
                n, last = n + 1, max(last, int(at.timestamp() * 1000))
        if n:
            state.update((n, last))
            state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["node_id", "n", "reason"])

    e = events.withWatermark("at", late).groupBy("node_id")
    return e.applyInPandasWithState(step, "node_id long, n long, reason string", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def counts_in_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, stop, kind, n) of tumbling windows; rows later than the watermark are left out."""
    w = F.window("at", width)
    return events.withWatermark("at", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "kind", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(node_id, start, stop, n): runs of a node's events with less than ``gap`` between neighbours."""
    w = F.session_window("at", gap)
    return events.withWatermark("at", late).groupBy("node_id", w.alias("w")).agg(F.count("*").alias("n")).select("node_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def batches_of(events: DataFrame, size: int = 128) -> DataFrame:
    """Items (user_id, item_id) of one micro-batch in groups of up to ``size`` for one call each: (user_id, part, items).

    Parts follow from a hash of the item, so that no user's items are put in one order in one task; a part holds about
    ``size`` items, and more than that many only by chance."""
    n = events.groupBy("user_id").agg(F.ceil(F.count("*") / size).alias("parts"))
    p = events.join(n, "user_id").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")))
    return p.groupBy("user_id", "part").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
