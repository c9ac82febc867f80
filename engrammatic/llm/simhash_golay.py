"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's fingerprint has 17 segments of 23 bits, the length of the perfect binary Golay code: every 23-bit word is
within distance 3 of exactly one of 4096 codewords. Each of the first eight segments is decoded to that codeword and,
where it lies at distance 3, to the five codewords at distance 4, the only ones that a word one bit away decodes to
(so two words at distance 2 or less always share one). Two segments' codewords make a join key; of the up to 36 keys
of a pair of segments the eight that flip the least certain bits are used. Pigeonhole: errors spread over eight segments
leave some two with few. Documents that share a key are compared on 64 other bits at once and then verified on the
whole fingerprint; where many share one, the whole fingerprints are fetched and a spanning set of near pairs is found,
in blocks of rows that one task holds, every two parts of a large run being one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrammatic.llm._arrow import WordHasher, ids_of, mix64, slices
from engrammatic.llm._runs import in_blocks, run_starts, spanning_edges, whole_runs
from engrammatic.llm._shared import components, drop_written, written

SEGMENTS, KEYED, BITS = 17, 8, 23
#: Keys for each of the 28 pairs of keyed segments; bits that may differ in the 64 compared at once, and in all.
KEYS, NEAR_CHECK, NEAR = 8, 23, 66
_WORDS = 7  # 64-bit words of a fingerprint: 391 bits


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndrome of each single bit; for each syndrome the error masks to try, and how many these are."""
    poly = 0b101011100011
    columns = []
    for i in range(BITS):
        v = 1 << i
        for j in range(BITS - 1, 10, -1):
            if v >> j & 1:
                v ^= poly << (j - 11)
        columns.append(v)
    masks: dict[int, list[tuple[int, int]]] = {}
    for weight in range(5):
        for c in itertools.combinations(range(BITS), weight):
            s = m = 0
            for i in c:
                s, m = s ^ columns[i], m | 1 << i
            masks.setdefault(s, []).append((weight, m))
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for s, found in masks.items():
        use = [found[0][1]] + [m for w, m in found[1:] if w == 4 and found[0][0] == 3]
        table[s, : len(use)], count[s] = use, len(use)
        table[s, len(use) :] = use[0]
    return np.array(columns, np.int64), table, count


def _spread() -> np.ndarray:
    """For each byte a 64-bit word with bit k of it in lane k of eight lanes."""
    x = np.arange(256, dtype=np.uint64)
    return sum((((x >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k) for k in range(8)), np.zeros(256, np.uint64))


class Fingerprints:
    """Fingerprints of a slice of texts, from the set of each text's different words."""

    def __init__(self) -> None:
        self.hasher, self.spread = WordHasher(), _spread()

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have words, and how far each of their bits is from being undecided: sums over words of +-1."""
        h, rows = self.hasher(column)
        if not len(h):
            return np.zeros(0, np.int64), np.zeros((0, SEGMENTS * BITS), np.int32)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows)).astype(np.uint64)
        k = np.sort((row << np.uint64(43)) | (h >> np.uint64(21)))
        k = k[np.concatenate([[True], k[1:] != k[:-1]])]
        at = run_starts(k >> np.uint64(43))
        which, size = (k[at[:-1]] >> np.uint64(43)).astype(np.int64), np.diff(at)
        word = k & np.uint64((1 << 43) - 1)
        # lanes of eight bits hold sums of up to 255 words
        blocks = np.flatnonzero((np.arange(len(k)) - np.repeat(at[:-1], size)) % 255 == 0)
        of_text = np.searchsorted(blocks, at[:-1])
        sums = []
        for j in range(_WORDS):
            x = mix64(word * np.uint64(2 * j + 1) + np.uint64(0x632BE59BD9B4E019 + j))
            for b in x.view(np.uint8).reshape(-1, 8).T[: 8 if j < _WORDS - 1 else 1]:
                lanes = np.add.reduceat(self.spread[b], blocks).view(np.uint8).reshape(-1, 8)
                sums.append(np.add.reduceat(lanes.astype(np.int32), of_text, axis=0))
        return which, 2 * np.concatenate(sums, axis=1)[:, : SEGMENTS * BITS] - size[:, None].astype(np.int32)


def pack(bits: np.ndarray) -> list[np.ndarray]:
    """Rows of bits as columns of 64-bit integers."""
    p = np.packbits(bits, axis=1, bitorder="little")
    p = np.concatenate([p, np.zeros((len(p), -p.shape[1] % 8), np.uint8)], axis=1)
    return list(np.ascontiguousarray(p).view(np.int64).T)


def join_keys(sums: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and the key of every join key of these fingerprints."""
    columns, masks, count = golay_tables()
    n = len(sums)
    s = sums[:, : KEYED * BITS].reshape(n, KEYED, BITS)
    seg = ((s > 0).astype(np.int64) << np.arange(BITS)).sum(2)
    syndrome = np.zeros_like(seg)
    for i in range(BITS):
        syndrome ^= np.where(seg >> i & 1, columns[i], 0)
    flips = masks[syndrome]
    cost = np.einsum("nskb,nsb->nsk", ((flips[..., None] >> np.arange(BITS)) & 1).astype(np.float32), np.abs(s).astype(np.float32))
    cost[np.arange(6) >= count[syndrome][..., None]] = np.inf
    word = seg[..., None] ^ flips
    rows, out = [], []
    for t, (a, b) in enumerate(itertools.combinations(range(KEYED), 2)):
        total = (cost[:, a, :, None] + cost[:, b, None, :]).reshape(n, 36)
        best = np.argpartition(total, keys - 1, axis=1)[:, :keys] if keys < 36 else np.broadcast_to(np.arange(36), (n, 36))
        ok = np.isfinite(np.take_along_axis(total, best, 1))
        key = (np.take_along_axis(word[:, a], best // 6, 1) << 23) | np.take_along_axis(word[:, b], best % 6, 1) | (t << 46)
        r, _ = np.nonzero(ok)
        rows.append(r)
        out.append(key[ok])
    return np.concatenate(rows), np.concatenate(out)


FP = [f"f{i}" for i in range(_WORDS)]
#: The word of the fingerprint that travels with a key; it has no bits of keyed segments.
CHECK = "f3"


def margins(sums: np.ndarray) -> np.ndarray:
    """What join_keys needs of the sums in a byte each: their signs, and how far from 0 they are for their text."""
    x = sums[:, : KEYED * BITS]
    scaled = np.rint(x * (40 / np.sqrt(np.square(x, dtype=np.float64).mean(1, keepdims=True))))
    return np.where(x > 0, np.clip(scaled, 1, 127), np.clip(scaled, -127, 0)).astype(np.int8)


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prints = Fingerprints()
    for batch in batches:
        for s in slices(batch, "text"):
            which, sums = prints(s.column("text"))
            if not len(which):
                continue
            m = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEYED * BITS), len(which), [None, pa.py_buffer(margins(sums))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(s)[which]), m, *map(pa.array, pack(sums > 0))], names=["doc_id", "margins", *FP])


#: Fingerprints whose keys are made at once.
KEYED_ROWS = 1_000


def key_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """A row for each join key of each fingerprint."""
    for batch in batches:
        for i in range(0, batch.num_rows, KEYED_ROWS):
            b = batch.slice(i, KEYED_ROWS)
            m = np.frombuffer(b"".join(b.column("margins").to_pylist()), np.int8).reshape(b.num_rows, KEYED * BITS)
            row, key = join_keys(m.astype(np.int32), keys)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids_of(b)[row]), pa.array(np.asarray(b.column(CHECK))[row])], names=["key", "doc_id", CHECK])


def distance(a: list[np.ndarray], i, j) -> np.ndarray:
    """Hamming distances of rows i and j of the columns in a."""
    return sum(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int32) for x in a)  # of signed integers it counts the absolute value


#: Rows of one key up to which all pairs are compared on the check word, and about as many as one task holds of a key.
SMALL, BLOCK = 24, 100_000


def near_in_runs(batches: Iterator[pa.RecordBatch], near_check: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) to verify among the rows of each key; of a key of more than SMALL rows these rows, as (a, key)."""
    for c in whole_runs(batches, "key"):
        size = np.diff(run_starts(c["key"]))
        f = [c[CHECK]]
        ids, key = c["doc_id"], c["key"]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.repeat(size <= SMALL, size)
        for d in range(1, min(SMALL, int(size.max()))):
            i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
            i = i[distance(f, i, i + d) <= near_check]
            a.append(ids[i])
            b.append(ids[i + d])
        x, y = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
        n, m = len(pair), int((~small).sum())
        if n + m:
            rest, pairs = np.zeros(m, np.int64), np.zeros(n, np.int64)
            of_pair = np.arange(n + m) < n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([pair[:, 0], ids[~small]])), pa.array(np.concatenate([pair[:, 1], rest]), mask=~of_pair), pa.array(np.concatenate([pairs, key[~small]]), mask=of_pair)],
                names=["a", "b", "key"],
            )


def near_in_large_runs(batches: Iterator[pa.RecordBatch], near: int, key: str = "key") -> Iterator[pa.RecordBatch]:
    """Edges that connect just what all near pairs among the rows of each key connect, by the whole fingerprints."""
    for c in whole_runs(batches, key):
        at = run_starts(c[key])
        for lo, hi in zip(at[:-1], at[1:]):
            part = [c[f][lo:hi] for f in FP]
            i, j = spanning_edges(int(hi - lo), lambda i, others, part=part: distance(part, i, others) <= near)
            x, y = c["doc_id"][lo:hi][i], c["doc_id"][lo:hi][j]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def near_duplicates(docs: DataFrame, near: int = NEAR, near_check: int = NEAR_CHECK, keys: int = KEYS) -> DataFrame:
    """Documents that are near copies of others: (doc_id, kept_doc_id), kept_doc_id being the least of the group.

    docs needs doc_id (integer) and text; doc_id names a document. Documents are near when at most ``near`` of 391
    fingerprint bits differ (about a tenth of the different words exchanged); groups are connected components. The
    search finds a near pair with a probability that grows with nearness and is above 0.9 also for isolated pairs that
    ``near`` just admits; ``keys`` = 36 takes every key of a pair of segments.

    Rows with a null doc_id or text, and texts without words, are in no group. Texts of any length count whole. Equal
    texts have equal fingerprints and so form a group; a repeated row (same doc_id) adds nothing. A group's kept
    document has a row too, with its own doc_id as kept_doc_id. An empty table gives no rows. Columns other than
    doc_id and text are neither read nor returned.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    words = ", ".join(f"{f} long" for f in FP)
    prints = written(plain.mapInArrow(fingerprint_rows, f"doc_id long, margins binary, {words}"))
    # equal fingerprints are near; the least document stands for them
    one = written(prints.groupBy(*FP).agg(F.min(F.struct("doc_id", "margins")).alias("least")).select("least.*", *FP))
    equal = prints.select(F.col("doc_id").alias("b"), *FP).join(one.select(F.col("doc_id").alias("a"), *FP), FP).where("a <> b").select("a", "b")
    rows = one.select("doc_id", "margins", CHECK).mapInArrow(lambda it: key_rows(it, keys), f"key long, doc_id long, {CHECK} long")
    found = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: near_in_runs(it, near_check), "a long, b long, key long"))
    left, right = (one.select(F.col("doc_id").alias(e), *(F.col(f).alias(f"{e}_{f}") for f in FP)) for e in "ab")
    apart = sum((F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in FP), F.lit(0))
    few = found.where("b is not null").select("a", "b").distinct().join(left, "a").join(right, "b").where(apart <= near).select("a", "b")
    large = in_blocks(found.where("key is not null").select("key", F.col("a").alias("doc_id")), "key", "doc_id", BLOCK)
    large = large.select("block", "doc_id").join(one.select("doc_id", *FP), "doc_id")
    many = large.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: near_in_large_runs(it, near, "block"), "a long, b long")
    groups = components(few.union(many).union(equal))
    drop_written(prints, one, found)
    return groups.select(F.col("node").alias("doc_id"), F.col("component").alias("kept_doc_id"))
