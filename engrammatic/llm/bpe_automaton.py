"""BPE encoding and decoding by a tokenization automaton.

The automaton accepts just the token sequences that BPE produces (Berglund, Martens and van der Merwe, 2024). It
starts as one state with an arc for every byte. Each merge u v -> t, in order of rank, adds a gadget: the state p that
u leads to gets a copy p' without the arc v, all arcs u lead to p' from then on, and every state that has an arc u gets
an arc t to where v leads. All arcs of one token lead to one state, so the automaton is three short columns over
states (parent, arc removed, when) and three over tokens (target, left part, rank): whether a state has an arc is
decided by walking these, and transitions that were decided stay in a table.

A pre-token is encoded by following transitions from left to right, longest label first. Each prefix has exactly one
accepted path, so a place that turned out to lead nowhere is never entered again and the path that reaches the end is
BPE's. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import gc
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrammatic.llm._arrow import slices, texts, worker_cache
from engrammatic.llm._pieces import pieces, pre_tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of pieces and of pre-tokens that a worker keeps before it starts afresh; letters of the longest that it keeps.
CACHED_BYTES, LONGEST = 48 << 20, 64
#: Decided transitions that a worker keeps before it starts afresh, about 30 MB.
TRANSITIONS = 250_000
#: Bytes of text that are encoded at once.
CODED = 2 << 20


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabulary files write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str = VOCABULARY) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Token bytes to ids, and the merges in order of rank."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    vocabulary = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return vocabulary, [(raw(a), raw(b)) for a, b in pairs]


class Automaton:
    """The deterministic automaton that a list of merges compiles to."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        size = max(vocabulary.values()) + 1
        self.vocabulary = vocabulary
        self.labels: list[bytes] = [b""] * size
        for t, i in vocabulary.items():
            self.labels[i] = t
        self.longest = max(map(len, vocabulary))
        # of states: copied from, without this arc, when (the rank of the merge that made it)
        self.parent, self.removed, self.made = array("i", [-1]), array("i", [-1]), array("i", [-1])
        # of tokens: the state that its arcs lead to, the left part and the rank of its merge; -2: no such arc anywhere
        self.target, self.left, self.rank = array("i", [0] * size), array("i", [-1] * size), array("i", [-2] * size)
        for i in range(256):
            if bytes([i]) in vocabulary:
                self.rank[vocabulary[bytes([i])]] = -1
        for rank, (a, b) in enumerate(merges):
            self._merge(rank, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self.open()

    def open(self) -> Automaton:
        """Makes what isn't sent to workers: all beginnings of tokens (the token itself, or -1) and the table."""
        self.starts: dict[bytes, int] = {t[:k]: -1 for t in self.vocabulary for k in range(1, len(t))} | self.vocabulary
        self.table: dict[int, bool] = {}
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("starts", "table", "labels")} | {"size": len(self.labels)}

    def __setstate__(self, state: dict) -> None:
        size = state.pop("size")
        self.__dict__.update(state)
        self.labels = [b""] * size
        for t, i in self.vocabulary.items():
            self.labels[i] = t

    def _merge(self, rank: int, u: int, v: int, t: int) -> None:
        """The gadget of one merge. A pair that cannot come about, or whose token came about before, adds none."""
        p, after = self.target[u], self.target[v]
        if self.rank[u] == -2 or self.rank[v] == -2 or self.rank[t] != -2 or not self._has(p, v):
            return
        self.parent.append(p)
        self.removed.append(v)
        self.made.append(rank)
        self.target[u] = len(self.parent) - 1
        self.target[t], self.left[t], self.rank[t] = after, u, rank

    def _has(self, state: int, token: int) -> bool:
        made, rank = self.made, self.rank
        while True:
            if made[state] > rank[token]:  # the state is a copy of one that had all arcs of this age
                if self.removed[state] == token:
                    return False
                state = self.parent[state]
            elif rank[token] < 0:
                return rank[token] == -1
            else:  # the arc was added where there was one of the left part
                token = self.left[token]

    def has(self, state: int, token: int) -> bool:
        """Whether there is an arc of this token from this state; what was decided stays in the table."""
        key = state << 20 | token
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TRANSITIONS:
                self.table.clear()
            known = self.table[key] = self._has(state, token)
        return known

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The tokens of one pre-token."""
        t = self.vocabulary.get(word)
        if t is not None and self.has(0, t):
            return (t,)
        n, labels, starts, table, target = len(word), self.labels, self.starts, self.table, self.target
        place, state, out, waiting, dead = 0, 0, [], [], ()
        k, arcs = 1, []
        while k <= n and (t := starts.get(word[:k])) is not None:
            if t >= 0:
                arcs.append(t)
            k += 1
        while place < n:
            while arcs:
                t = arcs.pop()  # the longest that is left
                end = place + len(labels[t])
                if end in dead:
                    continue
                known = table.get(state << 20 | t)
                if known or (known is None and self.has(state, t)):
                    waiting.append((place, state, arcs))
                    out.append(t)
                    place, state = end, target[t]
                    k, arcs = place + 1, []
                    while k <= n and (t := starts.get(word[place:k])) is not None:
                        if t >= 0:
                            arcs.append(t)
                        k += 1
                    break
            else:
                if not out:
                    raise ValueError(f"no path for {word!r}")
                dead += (place,)
                out.pop()
                place, state, arcs = waiting.pop()
        return tuple(out)

    def decode(self, tokens) -> bytes:
        """The labels of the tokens, put together."""
        labels = self.labels
        return b"".join([labels[t] for t in tokens])


def gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of ranges (first, size), one after the other."""
    total = np.cumsum(size)
    kind = np.int32 if len(total) and max(total[-1], first.max()) < 1 << 31 else np.int64
    out = np.repeat((first - (total - size)).astype(kind), size)
    out += np.arange(len(out), dtype=kind)
    return out


class Kept:
    """A dict of texts' tokens that forgets all when it has grown to so many bytes, and doesn't keep long texts."""

    def __init__(self, most: int) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.most, self.bytes = most, 0

    def add(self, text: str, tokens: tuple[int, ...]) -> None:
        if len(text) <= LONGEST:
            self.bytes += 250 + 2 * len(text) + 8 * len(tokens)
            if self.bytes > self.most:
                self.known.clear()
                self.bytes = 0
            self.known[text] = tokens


class Coder:
    """Encodes and decodes slices of texts."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.known, self.words = Kept(CACHED_BYTES), Kept(CACHED_BYTES // 2)
        label_size = np.array([len(x) for x in automaton.labels], np.int64)
        self.label_size, self.label_first = label_size, np.cumsum(label_size) - label_size
        self.label_bytes = np.frombuffer(b"".join(automaton.labels), np.uint8)

    def piece(self, piece: str) -> tuple[int, ...]:
        words = pre_tokens(piece)
        if len(words) == 1:
            return self.automaton.encode(piece.encode())
        out: list[int] = []
        for w in words:
            t = self.words.known.get(w)
            if t is None:
                t = self.automaton.encode(w.encode())
                self.words.add(w, t)
            out += t
        return tuple(out)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all rows, and each row's first."""
        names, at, off = pieces(column)
        known, flat, size = self.known.known, [], np.zeros(len(names), np.int64)
        for i, p in enumerate(names):
            t = known.get(p)
            if t is None:
                t = self.piece(p)
                self.known.add(p, t)
            flat += t
            size[i] = len(t)
        first = np.cumsum(size) - size
        tokens = np.array(flat, np.int32)[gather(first[at], size[at])]
        total = np.concatenate([[0], np.cumsum(size[at])])
        return tokens, total[off]

    def decode(self, tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows, and each row's first."""
        size = self.label_size[tokens]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.label_bytes[gather(self.label_first[tokens], size)], total[off]


def code_rows(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    cache = worker_cache("bpe", (len(automaton.vocabulary), len(automaton.parent), automaton.removed[-1]))
    if "coder" not in cache:
        cache["coder"] = Coder(automaton.open())
    on = gc.isenabled()
    gc.disable()  # millions of small tuples and no cycles: looking for these would take half the time
    try:
        for batch in batches:
            for s in slices(batch, "text", CODED):
                yield _coded(cache["coder"], s)
    finally:
        if on:
            gc.enable()


def _coded(coder: Coder, s: pa.RecordBatch) -> pa.RecordBatch:
    text = s.column("text")
    tokens, off = coder.encode(text)
    out, byte_off = coder.decode(tokens, off)
    a = texts(text)
    want_off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    want = np.frombuffer(a.buffers()[2] or b"", np.uint8)[want_off[0] : want_off[-1]]
    want_off = want_off - want_off[0]
    if np.array_equal(byte_off, want_off) and np.array_equal(out, want):
        same = np.ones(len(a), bool)
    else:
        same = np.array([np.array_equal(out[byte_off[i] : byte_off[i + 1]], want[want_off[i] : want_off[i + 1]]) for i in range(len(a))], bool)
    null = np.asarray(pc.is_null(text))
    first = pa.array(off.astype(np.int32))
    lists = pa.ListArray.from_arrays(first, pa.array(tokens), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(first, pa.array(tokens))
    return pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(np.diff(off), pa.int64(), mask=null), lists, pa.array(same, mask=null)], names=["doc_id", "n_tokens", "token_ids", "decodes"])


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decodes) for every row of docs, in one pass and without a shuffle.

    docs needs doc_id (integer) and text; vocabulary is the path on the driver of a tokenizer file with merges.
    decodes says whether decoding the ids gave the text's bytes again. Special tokens' strings are ordinary text.
    A null text has nulls in all three, an empty text no tokens; a null doc_id stays null. Texts of any length are
    encoded whole. Repeated rows give repeated results; an empty table gives no rows. Other columns are not read.
    """
    automaton = Automaton(*read_vocabulary(vocabulary))  # compiled once; tasks get its flat arrays
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lambda it: code_rows(it, automaton), "doc_id long, n_tokens long, token_ids array<int>, decodes boolean")
