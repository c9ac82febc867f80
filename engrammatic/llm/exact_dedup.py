"""Exact dedup by a cuckoo-filter index over content digests.

The index is sharded by digest. Each shard keeps its live digests in a cuckoo filter (Fan et al., 2014) with 16-bit
tags in buckets of four. Beside each tag the bucket keeps the stored key: the 64-bit digest and the content identity
(length and SHA-256) with the document that holds it. A filter hit is only a hint and is verified against what its two
buckets hold; an insertion that finds no room after ``KICKS`` moves doubles the table and re-inserts every stored key.
Every task first runs an index over its own rows and hands on each content once, so that a content that a third of all
rows have reaches its shard as one row a task. Only digests and ids are shuffled, never texts.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrammatic.llm._shared import free_name, written

SLOTS, KICKS = 4, 200
#: Contents that a task holds before it hands them on; rows of a shard; holders that are broadcast (about 60 MB).
HELD, SHARD_ROWS, BROADCAST_HOLDERS = 100_000, 250_000, 300_000
_M = (1 << 64) - 1


class CuckooIndex:
    """A cuckoo filter of live digests, with the content that each stands for."""

    def __init__(self, buckets: int = 64) -> None:
        self.resized = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.n = buckets  # a power of two
        self.size = 0
        self.tags = array("H", bytes(2 * SLOTS * buckets))
        self.keys = array("Q", bytes(8 * SLOTS * buckets))
        self.held: list = [None] * (SLOTS * buckets)
        self.stash: dict = {}  # what no size of table has room for: over eight contents whose digests go to the same buckets

    def __len__(self) -> int:
        return self.size

    @staticmethod
    def _tag(digest: int) -> int:
        return (digest >> 48) or 1

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995 >> 3)) & (self.n - 1)

    def _buckets(self, digest: int) -> tuple[int, int, int]:
        tag = self._tag(digest)
        one = (digest * 0x9E3779B97F4A7C15 & _M) >> 20 & (self.n - 1)
        return tag, one, self._other(one, tag)

    def may_hold(self, digest: int) -> bool:
        """The filter's answer, from tags alone: never wrong when it says no."""
        tag, one, two = self._buckets(digest)
        t = self.tags
        return bool(self.stash) or tag in t[one * SLOTS : one * SLOTS + SLOTS] or tag in t[two * SLOTS : two * SLOTS + SLOTS]

    def find(self, digest: int, content) -> int:
        """The slot that holds this very content (-2: the stash), or -1."""
        tag, one, two = self._buckets(digest)
        for b in (one, two):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.tags[s] == tag and self.keys[s] == digest and self.held[s] is not None and self.held[s][0] == content:
                    return s
        return -2 if self.stash and (digest, content) in self.stash else -1

    def get(self, digest: int, content):
        """Who holds the content, or None if it isn't live."""
        if not self.may_hold(digest):
            return None
        s = self.find(digest, content)
        return None if s == -1 else self.held[s][1] if s >= 0 else self.stash[digest, content]

    def items(self):
        """(digest, content, owner) of all live contents."""
        yield from ((k, h[0], h[1]) for k, h, t in zip(self.keys, self.held, self.tags) if t)
        yield from ((d, c, o) for (d, c), o in self.stash.items())

    def insert(self, digest: int, content, owner) -> None:
        """Makes the content live. It must not be live already."""
        self.size += 1
        entry = (digest, (content, owner))
        while (entry := self._place(entry)) is not None:
            if self.n > 16 * self.size:  # doubling hasn't parted them and won't
                self.stash[entry[0], entry[1][0]] = entry[1][1]
                return
            self._grow()

    def _place(self, entry):
        """Puts the entry, moving others; the entry that is left over when all moves are used up, or None."""
        digest, held = entry
        tag, b, two = self._buckets(digest)
        for kick in range(KICKS):
            for c in (b, two) if kick == 0 else (b,):
                for s in range(c * SLOTS, c * SLOTS + SLOTS):
                    if not self.tags[s]:
                        self.tags[s], self.keys[s], self.held[s] = tag, digest, held
                        return None
            s = b * SLOTS + kick % SLOTS
            self.tags[s], tag = tag, self.tags[s]
            self.keys[s], digest = digest, self.keys[s]
            self.held[s], held = held, self.held[s]
            b = self._other(b, tag)
        return digest, held

    def _grow(self) -> None:
        stored = [(k, h) for k, h, t in zip(self.keys, self.held, self.tags) if t] + [(d, (c, o)) for (d, c), o in self.stash.items()]
        size, buckets = self.size, self.n
        while True:
            buckets *= 2
            self._clear(buckets)
            self.resized += 1
            over = [x for e in stored if (x := self._place(e)) is not None]
            if not over or buckets > 16 * size:
                self.stash, self.size = {(d, c): o for d, (c, o) in over}, size
                return

    def delete(self, digest: int, content) -> bool:
        """Takes the content out; says whether it was live."""
        s = self.find(digest, content)
        if s == -1:
            return False
        self.size -= 1
        if s == -2:
            del self.stash[digest, content]
        else:
            self.tags[s], self.keys[s], self.held[s] = 0, 0, None
        return True


def run_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies a shard's events in order: what each addition came to."""
    index = CuckooIndex()
    for b in batches:
        out: list[tuple] = []
        for digest, sha, length, doc, order, action in zip(*(b.column(n).to_pylist() for n in ("digest", "sha", "length", "doc_id", "position", "action"))):
            digest, content = digest & _M, (length, sha)
            holder = index.get(digest, content)
            if action == "delete":
                if holder == doc:
                    index.delete(digest, content)
            elif holder is None:
                index.insert(digest, content, doc)
                out.append((doc, order, doc, False))
            else:
                out.append((doc, order, holder, True))
        docs, orders, kept, dup = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(orders, pa.int64()), pa.array(kept, pa.int64()), pa.array(dup, pa.bool_())], names=["doc_id", "position", "kept_doc_id", "duplicate"])


def _merged(index: CuckooIndex, rows) -> None:
    """Puts (digest, sha, length, doc_id, rows of this doc_id, rows of all) into an index that holds the least doc_id."""
    for digest, sha, length, doc, own, n in rows:
        digest, content = digest & _M, (length, sha)
        holder = index.get(digest, content)
        if holder is None:
            index.insert(digest, content, [doc, own, n])
        else:
            if doc < holder[0]:
                holder[0], holder[1] = doc, own
            elif doc == holder[0]:
                holder[1] += own
            holder[2] += n


def _rows(index: CuckooIndex, least: int) -> Iterator[pa.RecordBatch]:
    """What an index holds, of contents with at least so many rows."""
    found = [(d - (d >> 63 << 64), c[1], c[0], *o) for d, c, o in index.items() if o[2] >= least]
    for i in range(0, len(found), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found[i : i + 50_000]), (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["digest", "sha", "length", "doc_id", "own", "n"])


def contents_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each content of a task's rows once (again after every HELD contents)."""
    index = CuckooIndex(1024)
    for b in batches:
        ones = [1] * b.num_rows
        _merged(index, zip(*(b.column(n).to_pylist() for n in ("digest", "sha", "length", "doc_id")), ones, ones))
        if len(index) > HELD:
            yield from _rows(index, 1)
            index = CuckooIndex(1024)
    yield from _rows(index, 1)


def contents_of_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each content of a shard that has more than one row."""
    index = CuckooIndex(1024)
    for b in batches:
        _merged(index, zip(*(b.column(n).to_pylist() for n in ("digest", "sha", "length", "doc_id", "own", "n"))))
    yield from _rows(index, 2)


def _identity(text) -> list:
    """Digest, SHA-256 and length of a text; the last two are null where it is."""
    t = text.cast("string")
    return [F.xxhash64(t).alias("digest"), F.unhex(F.sha2(t, 256)).alias("sha"), F.length(t).alias("length")]


def _shards(df: DataFrame) -> int:
    """The number of shards for so many rows: that of shuffles, or more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / SHARD_ROWS))


def apply_events(events: DataFrame) -> DataFrame:
    """Runs additions and deletions through the index: (doc_id, position, kept_doc_id, duplicate) for each addition.

    events needs doc_id, text, position (integer, the order in which events happen; ties go by doc_id, additions
    before deletions) and action ('add' or 'delete'). An addition of content that is live is a duplicate of the
    document that holds it; otherwise the document becomes the holder. A deletion frees the content if this document
    holds it and does nothing otherwise. Events with a null doc_id, text or position are ignored; an empty text is
    content like any other, and texts of any length count whole. An empty table gives no rows.
    The events of one content depend on each other and are read one after the other, as a stream in sorted order;
    without deletions exact_duplicates() needs no such order.
    """
    e = events.select(*_identity(F.col("text")), F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position"), "action")
    e = e.where("doc_id is not null and sha is not null and position is not null")
    e = e.repartition(_shards(events), "digest").sortWithinPartitions("position", "doc_id", "action")
    return e.mapInArrow(run_shard, "doc_id long, position long, kept_doc_id long, duplicate boolean")


def holders(docs: DataFrame) -> DataFrame:
    """Contents that more than one row has, as a written table: (digest, sha, length, kept_doc_id, n_kept, n).

    kept_doc_id is the least doc_id, n_kept the number of its rows and n that of all. docs needs doc_id and text;
    rows where either is null don't count.
    """
    plain = docs.select(*_identity(F.col("text")), F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null and sha is not null")
    schema = "digest long, sha binary, length int, doc_id long, own long, n long"
    once = plain.mapInArrow(contents_of_task, schema).repartition(_shards(docs), "digest")
    return written(once.mapInArrow(contents_of_shard, schema).toDF("digest", "sha", "length", "kept_doc_id", "n_kept", "n"))


def _sized(found: DataFrame) -> DataFrame:
    """Holders to join with: broadcast if they are few; else rows of a hot content are split by adaptive execution."""
    return F.broadcast(found) if found.count() <= BROADCAST_HOLDERS else found


#: Rows that one row is repeated to at once.
_STEP = 100_000


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id) for every row whose text an earlier row has: of equal texts the least doc_id is kept.

    docs needs doc_id (integer) and text. Texts are equal when length and SHA-256 are. Rows with a null doc_id or text
    are no one's duplicates; empty texts are duplicates of each other. A repeated row (same doc_id and text) is a
    duplicate with kept_doc_id equal to its doc_id. Texts of any length count whole. An empty table gives no rows.
    Columns other than doc_id and text are neither read nor returned.
    """
    found = holders(docs)
    plain = docs.select(*_identity(F.col("text")), F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null and sha is not null")
    others = plain.join(_sized(found), ["digest", "sha", "length"]).where("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id")
    again = found.where("n_kept > 1").select("kept_doc_id", F.explode(F.expr(f"sequence(0L, (n_kept - 2) div {_STEP})")).alias("step"), "n_kept").repartition("kept_doc_id", "step")
    again = again.select("kept_doc_id", F.explode(F.expr(f"sequence(step * {_STEP}, least(step * {_STEP} + {_STEP - 1}, n_kept - 2))")))
    return others.unionByName(again.select(F.col("kept_doc_id").alias("doc_id"), "kept_doc_id"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without exact duplicates.

    Of rows with equal text those with the least doc_id stay, and one row if that doc_id and text are repeated (which
    one makes no difference to either). A doc_id with several texts loses only those that are duplicates. Rows with
    a null doc_id or text all stay. Empty texts are equal to each other, texts of any length count whole; an empty
    table gives none. Other columns may have any name.
    """
    found = holders(docs)
    names = {n: free_name(docs, f"held_{n}") for n in ("digest", "sha", "length", "kept_doc_id", "n_kept")}
    digest, sha, length, kept, own = (F.col(x) for x in names.values())
    d, h, n = _identity(F.col("text"))
    key = _sized(found.select(*(F.col(n).alias(x) for n, x in names.items())))
    doc_id = F.col("doc_id").cast("long")
    left = docs.join(key, (d == digest) & (h == sha) & (n == length), "left").where(kept.isNull() | doc_id.isNull() | (doc_id == kept))
    if found.where("n_kept > 1").isEmpty():
        return left.select(*(F.col(f"`{c}`") for c in docs.columns))
    again = F.coalesce((doc_id == kept) & (own > 1), F.lit(False))
    thinned = left.where(again).dropDuplicates([names["digest"], names["sha"], names["length"]])
    return left.where(~again).unionByName(thinned).select(*(F.col(f"`{c}`") for c in docs.columns))
