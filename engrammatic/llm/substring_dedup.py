"""Substring dedup by paragraph MinHash banding.

A text's paragraphs are its lines and its blocks of lines between blank ones. Each gets a MinHash signature of its word
pairs in ``bands`` bands of ``rows`` values; paragraphs that share a band collide, exact Jaccard similarity verifies
colliding paragraphs whose words differ, and connected components of what is verified are the clusters of which one
paragraph stays. Passages that repeat within longer lines are found by pieces that the text itself cuts: a word starts
a piece when its hash is the least of some window of ``window`` consecutive words (winnowing; Schleimer et al., 2003).
The cuts inside a repeated passage are therefore the same in every document, whatever stands around it and however
lines are broken, and two neighbouring cuts are never more than ``window`` words apart. One word exchanged in so short a
piece is too much of it for Jaccard's threshold, so pieces count as repeated when they are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrammatic.llm._arrow import WordHasher, ids_of, mix64, seeds, slices, texts
from engrammatic.llm._runs import in_blocks, run_starts, spanning_edges, whole_runs
from engrammatic.llm._shared import by_key, components, drop_written, written

WINDOW, MIN_WORDS, JACCARD, RECALL, ROWS = 14, 5, 0.8, 0.94, 3
#: A passage of over 50 words has at least so many between the cuts next to its ends.
MIN_SPAN = 51 - 2 * (WINDOW - 1)


def tune_bands(jaccard: float, recall: float, rows: int = ROWS) -> int:
    """The least number of bands of which a pair of this similarity shares one with at least this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - jaccard**rows)))


def cut(h: np.ndarray, rows: np.ndarray, window: int) -> np.ndarray:
    """First words of all paragraphs of a slice: the starts of texts and the winnowed words (of equal hashes the first)."""
    n = len(h)
    firsts = rows[:-1][rows[:-1] < rows[1:]]
    if n < window:
        return firsts
    pair = mix64(h ^ (np.concatenate([h[1:], h[:1]]) * np.uint64(3)))
    x = (pair & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    low, width = x, 1
    while width * 2 <= window:
        low, width = np.minimum(low[: len(low) - width], low[width:]), width * 2
    if window > width:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(rows, np.arange(n), side="right")
    at = at[text[: len(at)] == text[window - 1 :]]
    mark = np.zeros(n, bool)
    mark[at] = True
    mark[firsts] = True
    return np.flatnonzero(mark)


class Paragraphs:
    """The lines, blocks and pieces of a slice of texts with digests and the hashes of their word pairs, each kind that has
    any by itself. ok tells those that are long enough and that no kind before has too, near those that are paragraphs."""

    def __init__(self, window: int, min_words: int) -> None:
        self.hasher, self.window, self.min_words = WordHasher(), window, min_words
        self.r, self.powers, self.inverses = np.uint64(0xA0761D6478BD642F), np.ones(0, np.uint64), np.ones(0, np.uint64)

    def __call__(self, column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
        lists = pc.split_pattern(texts(column), "\n")
        of_row = np.asarray(lists.offsets).astype(np.int64)
        h, lines = self.hasher(lists.flatten())
        rows = lines[of_row - of_row[0]]
        n = len(h)
        if not n:
            return
        if len(self.powers) < n:
            for name, m in (("powers", int(self.r)), ("inverses", pow(int(self.r), -1, 1 << 64))):
                p = np.full(max(n, 1 << 18), m, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.powers[:n])])
        pairs = mix64(h * np.uint64(0x9FB21C651E98DF25) + np.concatenate([h[1:], h[:1]]))
        filled = lines[:-1] < lines[1:]
        heads = filled & np.concatenate([[True], ~filled[:-1]])
        first = np.zeros(len(filled), bool)
        first[(of_row - of_row[0])[:-1]] = True
        heads |= filled & first
        known = np.zeros(n, np.int64)  # the end of the last paragraph taken that starts here
        for starts, near in ((lines[:-1][filled], True), (lines[:-1][heads], True), (cut(h, rows, self.window), False)):
            ends = np.concatenate([starts[1:], [n]])
            ok = (ends - starts >= self.min_words) & (known[starts] != ends)
            known[starts] = ends
            digest = mix64((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
            row = np.searchsorted(rows, starts, side="right") - 1
            if ok.any():
                yield {"start": starts, "end": ends, "row": row, "first": rows[row], "digest": digest, "pairs": pairs, "ok": ok, "near": near}


def paragraph_rows(batches: Iterator[pa.RecordBatch], window: int, min_words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """A row for each paragraph and piece: digest, doc_id, and of paragraphs the key of each band."""
    cutter, mult = Paragraphs(window, min_words), seeds(bands * rows, 7_000)
    for batch in batches:
        for s in slices(batch, "text"):
            for p in cutter(s.column("text")):
                ok, last = p["ok"], p["end"] - 1

                def least(m: np.uint64, p=p, ok=ok, last=last) -> np.ndarray:
                    x = p["pairs"] * m
                    x ^= x >> np.uint64(29)
                    x[last] = np.uint64(0xFFFFFFFFFFFFFFFF)  # a pair that reaches into the next paragraph
                    return np.minimum.reduceat(x, p["start"])[ok]

                keys = []
                for band in range(bands):
                    if p["near"]:
                        key = np.full(int(ok.sum()), band, np.uint64)
                        for r in range(rows):
                            key = mix64(key ^ least(mult[band * rows + r]))
                        keys.append(pa.array(key.view(np.int64)))
                    else:
                        keys.append(pa.nulls(int(ok.sum()), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(p["digest"][ok].view(np.int64)), pa.array(ids_of(s)[p["row"][ok]]), *keys], names=["digest", "doc_id", *(f"k{i}" for i in range(bands))])


def place_rows(batches: Iterator[pa.RecordBatch], window: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """Where every paragraph is: digest, doc_id, first word and number of words."""
    cutter = Paragraphs(window, min_words)
    for batch in batches:
        for s in slices(batch, "text"):
            for p in cutter(s.column("text")):
                ok = p["ok"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p["digest"][ok].view(np.int64)), pa.array(ids_of(s)[p["row"][ok]]), pa.array((p["start"] - p["first"])[ok]), pa.array((p["end"] - p["start"])[ok])],
                    names=["digest", "doc_id", "start_word", "n_words"],
                )


#: Paragraphs of one key up to which all pairs are verified by a join, and about as many as one task holds of a key.
SMALL, BLOCK = 24, 20_000


def collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of different paragraphs that share a band: pairs (a, b); of a band of more than SMALL its paragraphs, as (a, key)."""
    for c in whole_runs(batches, "key"):
        key, digest = c["key"], c["digest"]
        size = np.diff(run_starts(key))
        small = np.repeat(size <= SMALL, size)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, min(SMALL, int(size.max()))):
            i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
            a.append(digest[i])
            b.append(digest[i + d])
        x, y = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        n, m = len(pair), int((~small).sum())
        if n + m:
            of_pair, none = np.arange(n + m) < n, np.zeros(m, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([pair[:, 0], digest[~small]])), pa.array(np.concatenate([pair[:, 1], none]), mask=~of_pair), pa.array(np.concatenate([np.zeros(n, np.int64), key[~small]]), mask=of_pair)],
                names=["a", "b", "key"],
            )


def near_in_blocks(batches: Iterator[pa.RecordBatch], jaccard: float) -> Iterator[pa.RecordBatch]:
    """Edges that connect just what all pairs of a block that are similar enough connect, by their exact sets."""

    def edges(digest: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        flat, size = np.concatenate(sets), np.array([len(x) for x in sets])
        first = np.cumsum(size) - size

        def near(i: int, others: np.ndarray) -> np.ndarray:
            if not len(others):
                return np.zeros(0, bool)
            n = size[others]
            at = np.repeat(first[others] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            mine = sets[i]
            place = np.minimum(np.searchsorted(mine, flat[at]), len(mine) - 1)
            shared = np.add.reduceat((mine[place] == flat[at]).astype(np.int64), np.cumsum(n) - n)
            return shared >= jaccard * (n + len(mine) - shared)

        i, j = spanning_edges(len(sets), near)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(digest[i], digest[j])), pa.array(np.maximum(digest[i], digest[j]))], names=["a", "b"])

    now, digests, sets = None, [], []
    for b in batches:
        for block, digest, pairs in zip(b.column("block").to_pylist(), b.column("digest").to_pylist(), b.column("pairs")):
            if block != now:
                if len(sets) > 1:
                    yield edges(np.array(digests), sets)
                now, digests, sets = block, [], []
            digests.append(digest)
            sets.append(np.unique(np.asarray(pairs.values)))
    if len(sets) > 1:
        yield edges(np.array(digests), sets)


def word_pairs(batches: Iterator[pa.RecordBatch], window: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """(digest, the different hashes of its word pairs) of every paragraph; equal digests once a slice."""
    cutter = Paragraphs(window, min_words)
    for batch in batches:
        for s in slices(batch, "text"):
            for p in cutter(s.column("text")):
                digest, first = np.unique(p["digest"][p["ok"]], return_index=True)
                a, b = p["start"][p["ok"]][first], p["end"][p["ok"]][first] - 1
                size = b - a
                flat = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(p["pairs"][flat].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), lists], names=["digest", "pairs"])


def repeated_paragraphs(
    docs: DataFrame, jaccard: float = JACCARD, recall: float = RECALL, window: int = WINDOW, min_words: int = MIN_WORDS, min_span: int = MIN_SPAN
) -> DataFrame:
    """Paragraphs that repeat: (doc_id, start_word, n_words, cluster, kept_doc_id, removed).

    docs needs doc_id (integer) and text. Words count from 0 within the text. A cluster's paragraph in the least
    (doc_id, start_word) stays (removed is false), the others go. Rows may overlap: a word repeats where any of them does.
    Repeated paragraphs that overlap or have under ``min_words`` words between them (too short to be one) form a span
    with those words; spans under ``min_span`` words, such as one short shared line, are left alone. Of a repeated
    passage within longer lines up to ``window`` - 1 words at either end aren't reported. Repeats within one text count
    like any other.

    Rows with a null doc_id or text, empty texts and texts under ``min_words`` words have no paragraphs. Texts of any
    length are cut whole. A repeated row (same doc_id and text) adds nothing, since a paragraph is known by its doc_id
    and place. An empty table gives no rows. Columns other than doc_id and text are neither read nor returned.
    Recall of near (not equal) paragraphs at similarity ``jaccard`` is ``recall`` in expectation; that of equal ones 1.
    """
    bands = tune_bands(jaccard, recall)
    names = [f"k{i}" for i in range(bands)]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    every = plain.mapInArrow(lambda it: paragraph_rows(it, window, min_words, bands, ROWS), f"digest long, doc_id long, {', '.join(f'{k} long' for k in names)}")
    # equal paragraphs are one row from here on, folded in the tasks that read them
    fold = written(every.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("holder"), *(F.min(k).alias(k) for k in names)))
    keys = fold.where("k0 IS NOT NULL").select("digest", F.explode(F.array(*names)).alias("key"))
    hits = written(keys.repartition("key").sortWithinPartitions("key").mapInArrow(collisions, "a long, b long, key long"))
    near = written(hits.where("b is not null").select("a", "b").distinct())
    large = hits.where("key is not null").select("key", F.col("a").alias("digest"))
    wanted = written(near.select(F.col("a").alias("digest")).union(near.select("b")).union(large.select("digest")).distinct())
    holders = written(by_key(fold.select("digest", "holder"), wanted, "digest", "left_semi").select("holder").distinct())
    sets = by_key(plain, holders, "doc_id", "left_semi").mapInArrow(lambda it: word_pairs(it, window, min_words), "digest long, pairs array<long>")
    sets = by_key(sets, wanted, "digest", "left_semi").groupBy("digest").agg(F.first("pairs").alias("pairs"))
    both = near.join(sets.select(F.col("digest").alias("a"), F.col("pairs").alias("p")), "a").join(sets.select(F.col("digest").alias("b"), F.col("pairs").alias("q")), "b")
    shared = F.size(F.array_intersect("p", "q"))
    few = both.where(shared >= jaccard * (F.size(F.array_distinct("p")) + F.size(F.array_distinct("q")) - shared)).select("a", "b")
    blocks = in_blocks(large, "key", "digest", BLOCK).join(sets, "digest").select("block", "digest", "pairs")
    many = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: near_in_blocks(it, jaccard), "a long, b long")
    cluster = written(components(few.union(many)))
    again = written(fold.where("n > 1").select("digest").union(cluster.select("node")).distinct())
    places = plain.mapInArrow(lambda it: place_rows(it, window, min_words), "digest long, doc_id long, start_word long, n_words long")
    places = by_key(places, again, "digest", "left_semi").distinct()
    places = places.join(cluster.withColumnRenamed("node", "digest"), "digest", "left").select(F.coalesce("component", "digest").alias("cluster"), "doc_id", "start_word", "n_words")
    places = written(places)
    drop_written(fold, hits, near, wanted, holders, again, cluster)
    kept = places.groupBy("cluster").agg(F.min(F.struct("doc_id", "start_word")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    found = places.join(kept, "cluster").select("doc_id", "start_word", "n_words", "cluster", F.col("kept.doc_id").alias("kept_doc_id"), (F.struct("doc_id", "start_word") != F.col("kept")).alias("removed"))
    in_doc = Window.partitionBy("doc_id").orderBy("start_word", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start_word") + F.col("n_words")
    before = F.max(end).over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start_word") - before >= min_words, F.lit(True))
    in_span = Window.partitionBy("doc_id", "span")
    spans = found.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(in_doc)).withColumn("span_words", F.max(end).over(in_span) - F.min("start_word").over(in_span))
    return spans.where(F.col("span_words") >= min_span).select("doc_id", "start_word", "n_words", "cluster", "kept_doc_id", "removed")
