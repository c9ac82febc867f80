"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled documents: one on windows of ordinary text, one on the parts of
toxic documents that set them apart (documents carry one label each, so the word beginnings that occur in
significantly more toxic than ordinary documents are taken as the toxic text). Both end in the same trained ordinary
content, so that ordinary text costs the same with either. A short mark alone would hardly pay for a match, so texts are
compressed in a spelling in which every mark is a code of 16 letters. A document is cut into windows of ``WINDOW`` words; a window
gains as many bytes as it becomes shorter with the toxic dictionary. A document's score is what its windows gain beyond
a threshold for windows, added up and divided by a power of its number of words. Both thresholds and the power are
calibrated on labelled documents that the training did not see. Copies of one document are one witness: they are
recognised by shared min-hashes of word triples, counted once, and never split between training and calibration.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrammatic.llm._arrow import mix64, seeds, worker_cache

WINDOW, LEVEL, ORDINARY_BYTES, TOXIC_BYTES = 10, 1, 16_384, 32_768
#: Words of up to LONGEST letters that a worker keeps the spelling of, about 25 MB; longer ones are spelled each time.
CACHED = 100_000
#: Letters that a word's beginning has at least, and at most.
SHORTEST, LONGEST = 3, 40
#: Windows of those documents' ordinary text that the dictionary is trained on, drawn at random.
TRAINED_WINDOWS = 40_000
#: At most so many labelled documents of each class are fitted on, taken in the order of a hash of their ids.
MOST_LABELLED = 2_500
#: Texts this short score as if they had so many words: one word in a handful of words proves little.
LEAST_WORDS = 40
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).split()


def _beginnings(words: list[str]) -> set[str]:
    return {w[:k] for w in set(words) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def families(docs: list[list[str]], hashes: int = 6) -> list[int]:
    """A number for each document, equal for copies: documents that share a min-hash of word triples."""
    up = list(range(len(docs)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, w in enumerate(docs):
        triples = np.array([zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))], np.uint64)
        for k, m in enumerate(seeds(hashes, 23_000)):
            j = seen.setdefault((k, int(mix64(triples * m).min())), i)
            up[top(i)] = top(j)
    return [top(i) for i in range(len(docs))]


def toxic_spans(toxic: list[list[str]], ordinary: list[list[str]], least: float = 15.0, documents: int = 5) -> Counter:
    """Beginnings of the toxic documents' words that mark toxic documents, and how often they occur there.

    A mark occurs in at least so many toxic documents that aren't copies of each other.
    """
    in_toxic: Counter = Counter()
    in_ordinary: Counter = Counter()
    for d in toxic:
        in_toxic.update(_beginnings(d))
    for d in ordinary:
        in_ordinary.update(_beginnings(d))
    n, m = max(1, len(toxic)), max(1, len(ordinary))

    def strength(g: str) -> float:
        a, b = in_toxic[g], in_ordinary[g]
        if a < documents or a / n < 8 * (b + 1) / m:
            return 0.0
        p = (a + b) / (n + m)
        return 2 * (a * math.log(a / n / p) + (b * math.log(b / m / p) if b else 0.0))

    strong = {g: s for g in in_toxic if (s := strength(g)) > least}
    spans: Counter = Counter()
    for d in toxic:
        for w in d:
            best = max(((strong.get(w[:k], 0.0), k) for k in range(SHORTEST, min(len(w), LONGEST) + 1)), default=(0.0, 0))
            if best[0]:
                spans[w[: best[1]]] += 1
    return spans


def code(mark: str) -> str:
    """The 16 letters that a mark is spelled with."""
    return base64.b64encode(hashlib.blake2b(mark.encode(), digest_size=12).digest()).decode()


def spell(word: str, marks: frozenset[str]) -> str:
    """The word, its longest mark written as a code."""
    for k in range(min(len(word), LONGEST), SHORTEST - 1, -1):
        if word[:k] in marks:
            return code(word[:k]) + word[k:]
    return word


def _trained(samples: list[str], size: int) -> bytes:
    """The content of a dictionary trained on the samples; where there are too few to train on, the samples."""
    raw = [s.encode() for s in samples]
    try:
        d = zstandard.train_dictionary(size, raw).as_bytes()
        # What follows the entropy tables is content; a dictionary has its content at its end.
        return d[-min(len(d) * 9 // 10, size) :]
    except zstandard.ZstdError:
        return b"".join(raw)[-size:]


@dataclass
class Model:
    """Contents of the two dictionaries and what was calibrated."""

    ordinary: bytes
    toxic: bytes
    #: Word beginnings that are spelled as codes.
    marks: frozenset[str]
    #: From this score a document is toxic; from beyond this gain a window counts; the power of the number of words.
    threshold: float
    window: int = 0
    power: float = 1.0

    def gains(self):
        """A function that gives a text's number of words and what each of its windows gains."""
        compress = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        ordinary, toxic = compress

        spelled, marks = worker_cache("spelled", (self.toxic, self.marks)), self.marks

        def of(text: str | None) -> tuple[int, list[int]]:
            w = words_of(text)
            if len(spelled) > CACHED:
                spelled.clear()
            own = {}
            for x in set(w):
                if x not in spelled:
                    (spelled if len(x) <= LONGEST else own)[x] = spell(x, marks)
            w = [spelled[x] if x in spelled else own[x] for x in w]
            windows = [(" " + " ".join(w[i : i + WINDOW]) + " ").encode() for i in range(0, len(w), WINDOW)]
            return len(w), [len(ordinary(b)) - len(toxic(b)) for b in windows]

        return of

    def score(self, words: int, gains: list[int]) -> float:
        t = self.window
        return sum(g - t for g in gains if g > t) / max(words, LEAST_WORDS) ** self.power

    def scorer(self):
        """A function that scores a text."""
        gains = self.gains()
        return lambda text: self.score(*gains(text))


def calibrate(model: Model, held: list[tuple[str, int, float]]) -> None:
    """Sets the thresholds and the power that give the best F1 over (text, label, weight)."""
    gains = model.gains()
    known = [(*gains(t), y, w) for t, y, w in held]
    positive = sum(w for *_, y, w in known if y)
    best = (0.0, model.threshold, model.window, model.power)
    for model.window in (0, 1, 2, 3, 4, 6, 8):
        for model.power in (0.0, 0.5, 1.0):
            scored = sorted(((model.score(n, g), y, w) for n, g, y, w in known), reverse=True)
            hit = said = 0.0
            for i, (s, y, w) in enumerate(scored):
                hit, said = hit + w * y, said + w
                below = scored[i + 1][0] if i + 1 < len(scored) else 0.0
                if s > below:
                    best = max(best, (2 * hit / (said + positive), (s + below) / 2, model.window, model.power))
    _, model.threshold, model.window, model.power = best


def fit_rows(rows: list[tuple[str, int]], ratio: float | None = None) -> Model:
    """Fits on (text, label) pairs: two thirds train, one third calibrates. Without either class nothing is toxic.

    ratio: ordinary documents for each toxic one in the corpus, if it is another than among the rows.
    """
    docs = [words_of(t) for t, _ in rows]
    family = families(docs)
    seen: set[tuple[int, int]] = set()
    one = [i for i, (_, y) in enumerate(rows) if (family[i], y) not in seen and not seen.add((family[i], y))]
    part = {f: k % 3 for k, f in enumerate(dict.fromkeys(family[i] for i in one))}
    toxic, ordinary = ([docs[i] for i in one if part[family[i]] and bool(rows[i][1]) is y] for y in (True, False))
    if not toxic or not ordinary:
        return Model(b"", b"", frozenset(), math.inf)
    windows = [" ".join(d[i : i + WINDOW]) for d in ordinary for i in range(0, len(d), WINDOW)]
    random.Random(17).shuffle(windows)
    base = _trained(windows[:TRAINED_WINDOWS], ORDINARY_BYTES)
    spans = toxic_spans(toxic, ordinary)
    if not spans:
        return Model(base, base, frozenset(), math.inf)
    codes = [f" {code(m)}" for m, _ in spans.most_common()]  # as many as there is room for, the most frequent
    toxic_text = "".join(reversed(codes[: TOXIC_BYTES // 17])).encode()
    model = Model(base, base + toxic_text, frozenset(spans), math.inf)
    held = [rows[i] for i in one if not part[family[i]]]
    n, m = sum(not y for _, y in held), sum(bool(y) for _, y in held)
    weight = ratio * m / n if ratio and n and m else 1.0
    calibrate(model, [(t, int(bool(y)), 1.0 if y else weight) for t, y in held])
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fits on up to ``most`` labelled documents of each class.

    docs needs doc_id and text, labels doc_id and toxic (0 or 1). Rows with a null doc_id, text or toxic are not used;
    a document that is labelled both ways counts for both. Other columns may have any name.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("y")).where("doc_id is not null and y is not null").distinct()
    parts = [y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = d.join(chosen, "doc_id").select("doc_id", "text", "y").collect()  # at most 2 * most documents
    rows.sort(key=lambda r: ((r.doc_id * 2654435761) % (1 << 32), r.doc_id, r.y, r.text))
    n = {r.y: r.n for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row for each class
    return fit_rows([(r.text, r.y) for r in rows], n[0] / n[1] if n.get(0) and n.get(1) else None)


def score_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    score = model.scorer()
    for b in batches:
        found = [score(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.float64()), pa.array([s >= model.threshold for s in found], pa.bool_())], names=["doc_id", "score", "toxic"])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic) for every row of docs, in one pass and without a shuffle.

    A null or empty text scores 0 and is not toxic; a null doc_id stays null. Texts of any length are scored whole.
    Repeated rows give repeated results, an empty table none. Columns other than doc_id and text are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lambda it: score_rows(it, model), "doc_id long, score double, toxic boolean")


def keep_rows(batches: Iterator[pa.RecordBatch], model: Model, column: str) -> Iterator[pa.RecordBatch]:
    score = model.scorer()
    for b in batches:
        yield b.filter(pa.array([score(t) < model.threshold for t in b.column(column).to_pylist()], pa.bool_()))


def without_toxic(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """The rows of docs, all columns of whatever names, that are not toxic; rows with a null text stay. No shuffle."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = next(f"c{i}" for i, c in enumerate(docs.columns) if c.lower() == column.lower())
    return plain.mapInArrow(lambda it: keep_rows(it, model, text), plain.schema).toDF(*docs.columns)
