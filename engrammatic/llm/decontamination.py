"""Benchmark decontamination by spaced seeds.

A spaced seed hashes the words under a fixed mask and ignores the others (Ma et al., 2002), so an overlap is found
although some of its words were substituted. The seeds of all benchmark items are a hash table; every place of every
document looks its seeds up, and each hit is verified: around it, along the same alignment, the stretch that scores
best (+1 for equal words, -PENALTY for different ones) must have enough equal words. Items shorter than a mask have a
mask over all of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrammatic.llm._arrow import WordHasher, ids_of, mix64, seeds, slices, worker_cache
from engrammatic.llm._shared import by_key, written

#: Weight 8 in span 12, chosen so that their ignored places differ.
MASKS = ("111010011011", "110110100111", "101101110101")
#: Equal words that an overlap must have; an item with fewer words must be there whole.
LEAST = 12
PENALTY = 2
#: Words of benchmark text up to which every worker gets the whole table (about 100 bytes a word). The seeds of a larger
#: benchmark are joined with those of the documents.
TABLE_WORDS = 500_000


def spread(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The seed of every place of h where the mask fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mult = seeds(len(mask), 11_000 + 100 * salt)
    x = np.zeros(n, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            x += h[k : k + n] * mult[k]
    return mix64(x)


def best_stretch(equal: np.ndarray, at: int, penalty: int = PENALTY) -> tuple[int, int]:
    """Of an alignment: the stretch through place ``at`` with the best score, as first and last place plus one."""
    s = np.where(equal, 1, -penalty)
    right = np.cumsum(s[at:])
    left = np.cumsum(s[: at + 1][::-1])
    return at - int(np.argmax(left)), at + int(np.argmax(right)) + 1


def masks_for(masks: tuple[str, ...], lengths) -> list[tuple[str, int]]:
    """The masks with their salts, and one over whole items for each length that is too short for one of the masks."""
    return [*((m, i) for i, m in enumerate(masks)), *(("1" * n, 50 + n) for n in sorted({*lengths}) if 0 < n < max(map(len, masks)))]


class Benchmark:
    """Seed table and words of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...], least: int) -> None:
        h, rows = WordHasher()(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.words = [h[a:b] for a, b in zip(rows, rows[1:])]
        self.least = least
        self.masks = masks_for(masks, map(len, self.words))
        keys, item, place = [], [], []
        for mask, salt in self.masks:
            for i, w in enumerate(self.words):
                if salt >= 50 and len(w) != len(mask):
                    continue
                k = spread(w, mask, salt)
                keys.append(k)
                item.append(np.full(len(k), i))
                place.append(np.arange(len(k)))
        none = np.zeros(0, np.int64)
        k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(k, kind="stable")
        self.keys = k[order]
        self.item = np.concatenate([*item, none])[order].astype(np.int64)
        self.place = np.concatenate([*place, none])[order].astype(np.int64)
        bits = min(24, max(8, int(len(k)).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.keys >> self.shift).astype(np.int64)] = True

    def need(self, item: int) -> int:
        return min(self.least, len(self.words[item]))

    def overlaps(self, h: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, first word in the text, first word in the item, words, equal words) of what a slice overlaps."""
        hits: set[tuple[int, int, int, int]] = set()
        for mask, salt in self.masks:
            k = spread(h, mask, salt)
            at = np.flatnonzero(self.filter[(k >> self.shift).astype(np.int64)])
            lo = np.searchsorted(self.keys, k[at])
            hi = np.searchsorted(self.keys, k[at], side="right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                row = int(np.searchsorted(rows, p, side="right")) - 1
                if p + len(mask) <= rows[row + 1]:
                    for x in range(a, b):
                        hits.add((row, int(self.item[x]), p - int(self.place[x]), p))
        out, done = [], {}
        for row, item, shift, p in sorted(hits):
            if p < done.get((row, item, shift), -1):
                continue
            w = self.words[item]
            first, last = max(shift, int(rows[row])), min(shift + len(w), int(rows[row + 1]))
            equal = h[first:last] == w[first - shift : last - shift]
            if not equal[p - first]:
                continue  # two seeds that are equal by chance
            a, b = best_stretch(equal, p - first)
            done[row, item, shift] = first + b
            n = int(equal[a:b].sum())
            if n >= self.need(item):
                out.append((row, item, first + a - int(rows[row]), first + a - shift, b - a, n))
        return out


_SCHEMA = "doc_id long, item_id long, doc_word int, item_word int, n_words int, n_equal int"


def _batch(ids: np.ndarray, bench: Benchmark, found: list) -> pa.RecordBatch:
    row, item, a, b, n, equal = map(list, zip(*found))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[row]), pa.array([bench.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int32()) for x in (a, b, n, equal))],
        names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"],
    )


def overlap_rows(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], masks: tuple[str, ...], least: int) -> Iterator[pa.RecordBatch]:
    """With the whole benchmark in the worker, which keeps its table from task to task."""
    cache, hasher = worker_cache("benchmark", (len(items), hash(tuple(items)), masks, least)), WordHasher()
    if "table" not in cache:
        cache["table"] = Benchmark(items, masks, least)
    bench = cache["table"]
    for batch in batches:
        for s in slices(batch, "text"):
            if found := bench.overlaps(*hasher(s.column("text"))):
                yield _batch(ids_of(s), bench, found)


def length_rows(batches: Iterator[pa.RecordBatch], below: int) -> Iterator[pa.RecordBatch]:
    """The numbers of words, under ``below``, that texts have."""
    hasher, found = WordHasher(), set()
    for batch in batches:
        for s in slices(batch, "text"):
            found.update(np.unique(np.diff(hasher(s.column("text"))[1])).tolist())
    yield pa.RecordBatch.from_arrays([pa.array(sorted(n for n in found if 0 < n < below), pa.int32())], names=["n"])


def seed_rows(batches: Iterator[pa.RecordBatch], masks: list[tuple[str, int]], keys: list[str], whole: bool) -> Iterator[pa.RecordBatch]:
    """The different seeds of each text, with its keys; of an item (whole) a short mask only if it has that length."""
    hasher = WordHasher()
    for batch in batches:
        for s in slices(batch, "text"):
            h, rows = hasher(s.column("text"))
            size = np.diff(rows)
            text = np.repeat(np.arange(len(size)), size)
            for mask, salt in masks:
                k = spread(h, mask, salt)
                if not len(k):
                    continue
                fits = text[: len(k)] == text[len(mask) - 1 :]
                if whole and salt >= 50:
                    fits &= size[text[: len(k)]] == len(mask)
                pair = np.unique(np.stack([text[: len(k)][fits].astype(np.uint64), k[fits]], 1), axis=0)
                if len(pair):
                    at = pa.array(pair[:, 0].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([*(s.column(n).take(at) for n in keys), pa.array(pair[:, 1].copy().view(np.int64))], names=[*keys, "seed"])


def verify_rows(batches: Iterator[pa.RecordBatch], masks: tuple[str, ...], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that a document's text (item_id null) comes before the items that may overlap it."""
    hasher, now, words = WordHasher(), None, None
    for b in batches:
        for doc, key, item, text in zip(*(b.column(n).to_pylist() for n in ("doc_id", "key", "item_id", "text"))):
            if item is None:
                now, words = (doc, key), hasher(pa.array([text], pa.large_string()))
            elif (doc, key) == now:
                bench = Benchmark([(item, text)], masks, least)
                if found := bench.overlaps(*words):
                    yield _batch(np.array([doc]), bench, found).append_column("key", pa.array([key] * len(found), pa.int64()))


def _joined(plain: DataFrame, bench: DataFrame, masks: tuple[str, ...], least: int) -> DataFrame:
    """overlaps() by a shuffled join of seeds: no task holds the benchmark, and a document is read by one task at a time."""
    below = max(map(len, masks))
    lengths = bench.mapInArrow(lambda it: length_rows(it, below), "n int").distinct().collect()  # under ``below`` rows
    used = masks_for(masks, (r.n for r in lengths))
    bench = written(bench.withColumn("item_key", F.xxhash64("item_id", "text")))
    docs = plain.withColumn("key", F.xxhash64("text"))
    of_items = bench.mapInArrow(lambda it: seed_rows(it, used, ["item_key"], True), "item_key long, seed long").distinct()
    of_docs = docs.mapInArrow(lambda it: seed_rows(it, used, ["doc_id", "key"], False), "doc_id long, key long, seed long")
    pairs = written(of_docs.join(of_items, "seed").select("doc_id", "key", "item_key").distinct())
    texts = by_key(docs, written(pairs.select("key").distinct()), "key", "left_semi").dropDuplicates(["doc_id", "key"])
    items = pairs.join(bench, "item_key").select("doc_id", "key", "item_id", "text")
    both = texts.select("doc_id", "key", F.lit(None).cast("long").alias("item_id"), "text").unionByName(items)
    order = ["doc_id", "key", F.col("item_id").isNotNull(), "item_id", "text"]
    found = written(both.repartition("doc_id", "key").sortWithinPartitions(*order).mapInArrow(lambda it: verify_rows(it, masks, least), _SCHEMA + ", key long"))
    return docs.select("doc_id", "key").join(found, ["doc_id", "key"]).drop("key")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST, table_words: int = TABLE_WORDS) -> DataFrame:
    """What documents share with benchmark items: (doc_id, item_id, doc_word, item_word, n_words, n_equal).

    docs needs doc_id (integer) and text, benchmark item_id (integer) and text. Places and lengths are in words.
    An overlap needs ``least`` equal words, or all of an item with fewer, be it one word. A benchmark of up to
    ``table_words`` words goes to every worker: one pass over the documents and no shuffle; the seeds of a larger one
    are joined with the documents' and give the same rows.

    Rows with a null id or text, and texts without words, overlap nothing. Texts of any length are searched whole.
    Items with equal texts each have their rows; a repeated document row gives repeated results, a repeated benchmark
    row does not. If either table is empty there are no rows. Other columns may have any name and are neither read nor
    returned.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    words = bench.agg(F.sum(F.size(F.split("text", r"\s+")).cast("long"))).first()[0] or 0
    if words > table_words:
        return _joined(plain, bench, masks, least)
    items = sorted((r.item_id, r.text) for r in bench.collect())  # at most table_words words
    return plain.mapInArrow(lambda it: overlap_rows(it, items, masks, least), _SCHEMA)
