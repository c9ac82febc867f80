"""Secret scans with a recursive decoding worklist.

The text of a document is the first layer. Every layer is scanned with all rules; then its percent-encoded stretches,
its Unicode escapes and its base64 runs (which may be wrapped over lines, stand behind '/', '-', '_' or '+' and hold
compressed data) are decoded, and each layer that this gives
goes on the worklist. A layer with the content of one that it was decoded from, or that was seen at the same place, is
not entered again, so the list ends.
Every layer knows for each of its characters which characters of the document it came from.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import gzip
import hashlib
import io
import itertools
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rule, words of which one must occur in the lower-cased layer, pattern; group 1 is the secret if there is one.
RULES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("aws_access_key", ("akia", "asia"), r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])"),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})"),
    ("slack_token", ("xox",), r"(?<![A-Za-z0-9])(xox[abposr]-[A-Za-z0-9-]{10,})"),
    ("google_api_key", ("aiza",), r"(?<![A-Za-z0-9])(AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])"),
    ("payment_key", ("sk_live_", "rk_live_", "sk_test_"), r"(?<![A-Za-z0-9])((?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,})"),
    ("json_web_token", ("eyj",), r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("private_key", ("private key-----",), r"(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]|-(?!----END))*?-----END [A-Z ]*PRIVATE KEY-----)"),
    (
        "assigned_secret",
        ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey"),
        r"(?i)(?:password|passwd|secret|token|api[_-]?key)[\"']?\s{0,4}(?::|=>|=)\s{0,4}[\"']?([A-Za-z0-9_./+~!@#$%^&*-]{8,})",
    ),
)
_RULES = [(name, words, re.compile(p)) for name, words, p in RULES]
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# Runs that may hold escapes: every character is looked at once, whatever follows.
_PERCENT_RUN = re.compile(r"(?:[A-Za-z0-9_.~!*'();:@&=+$,/?#\[\]-]++|%)++")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_ESCAPE_RUN = re.compile(r"(?:[^\s\\]++|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\)++")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-]))*[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Bytes up to which what a compressed layer holds is one layer; a larger one is reported as 'oversized_layer' and
#: scanned in parts of PART bytes, each beginning with the last OVERLAP of the part before.
MOST_UNPACKED, PART, OVERLAP = 64 << 20, 4 << 20, 64 << 10


@dataclass
class Layer:
    text: str
    path: tuple[str, ...]
    #: Place in the document of each character and of the one after the last: (first, after), or one span for all.
    places: list[tuple[int, int]] | None
    span: tuple[int, int]
    #: Digests of the layers that this one was decoded from.
    above: frozenset[bytes] = frozenset()
    #: Of a layer too large to hold: the parts of its text.
    parts: Iterator[str] | None = None

    def where(self, a: int, b: int) -> tuple[int, int]:
        """The span of the document that characters a to b came from."""
        if self.places is not None:
            return self.places[a][0], self.places[b - 1][1]
        return (a, b) if not self.path else self.span


def _kind(raw: bytes) -> str | None:
    """The kind of compression that the bytes begin like."""
    if raw[:2] == b"\x1f\x8b":
        return "gzip"
    if raw[:1] == b"\x78" and len(raw) > 2 and not int.from_bytes(raw[:2], "big") % 31:
        return "zlib"
    return "bz2" if raw[:3] == b"BZh" else "xz" if raw[:6] == b"\xfd7zXZ\x00" else "zstd" if raw[:4] == b"\x28\xb5\x2f\xfd" else None


def _chunks(raw: bytes, kind: str) -> Iterator[bytes]:
    """What all members of the compressed bytes hold, as far as they can be read."""
    try:
        if kind == "zlib":
            d = zlib.decompressobj()
            while out := d.decompress(raw, 1 << 20):
                yield out
                raw = d.unconsumed_tail
            return
        file = io.BytesIO(raw)
        if kind == "gzip":
            reader = gzip.GzipFile(fileobj=file)
        elif kind == "bz2":
            reader = bz2.BZ2File(file)
        elif kind == "xz":
            reader = lzma.LZMAFile(file)
        else:
            reader = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)
        while out := reader.read1(1 << 20):
            yield out
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        return


def _unpack(raw: bytes) -> tuple[str, bytes | None] | None:
    """The kind of compression and what it holds (None: too large), or None if it isn't compressed."""
    kind, out, n = _kind(raw), [], 0
    if kind is None:
        return None
    for c in _chunks(raw, kind):
        out.append(c)
        n += len(c)
        if n > MOST_UNPACKED:
            return kind, None
    return (kind, b"".join(out)) if n else None


def _parts(raw: bytes, kind: str) -> Iterator[str]:
    """The text of a layer too large to hold, in overlapping parts; none of a part that isn't text."""
    held = b""
    for c in itertools.chain(_chunks(raw, kind), [None]):
        held += c or b""
        if c is None or len(held) >= PART:
            if t := _readable(held.decode("utf-8", "ignore").encode()):
                yield t
            held = held[-OVERLAP:]


def _readable(raw: bytes) -> str | None:
    """The bytes as text, if they are UTF-8 without control characters other than white space."""
    try:
        t = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return t if t and not any(ord(c) < 32 and c not in "\t\n\r\x0b\x0c" or ord(c) == 127 for c in t) else None


def _percent(layer: Layer) -> Iterator[Layer]:
    for m in _PERCENT_RUN.finditer(layer.text):
        if not _PERCENT.search(layer.text, m.start(), m.end()):
            continue
        out: list[str] = []
        places: list[tuple[int, int]] = []
        i, run = m.start(), m.group()
        for e in _PERCENT.finditer(run):
            for k in range(i, m.start() + e.start()):
                out.append(layer.text[k])
                places.append(layer.where(k, k + 1))
            at = m.start() + e.start()
            raw = bytes.fromhex(e.group().replace("%", ""))
            for c in raw.decode("utf-8", "replace"):
                n = len(c.encode("utf-8")) if c != "�" else 1
                end = min(at + 3 * n, m.start() + e.end())
                out.append(c)
                places.append(layer.where(min(at, end - 1), end))
                at = end
            i = m.start() + e.end()
        for k in range(i, m.end()):
            out.append(layer.text[k])
            places.append(layer.where(k, k + 1))
        yield Layer("".join(out), (*layer.path, "url"), places, layer.where(m.start(), m.end()))


def _escapes(layer: Layer) -> Iterator[Layer]:
    for m in _ESCAPE_RUN.finditer(layer.text):
        if not _ESCAPE.search(layer.text, m.start(), m.end()):
            continue
        units: list[tuple[int, int, int]] = []
        i = m.start()
        for e in _ESCAPE.finditer(layer.text, m.start(), m.end()):
            units += [(ord(layer.text[k]), k, k + 1) for k in range(i, e.start())]
            units.append((int(next(g for g in e.groups() if g), 16), e.start(), e.end()))
            i = e.end()
        units += [(ord(layer.text[k]), k, k + 1) for k in range(i, m.end())]
        out, places, k = [], [], 0
        while k < len(units):
            c, a, b = units[k]
            if 0xD800 <= c < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
                c, b, k = 0x10000 + ((c - 0xD800) << 10) + units[k + 1][0] - 0xDC00, units[k + 1][2], k + 1
            out.append(chr(c) if c <= 0x10FFFF and not 0xD800 <= c < 0xE000 else "�")
            places.append(layer.where(a, b))
            k += 1
        yield Layer("".join(out), (*layer.path, "unicode"), places, layer.where(m.start(), m.end()))


def _decoded(s: str) -> bytes:
    """The bytes of a base64 run, or none. Under 16 letters there are no 14 bytes, which the shortest secret has."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) < 16 or len(s) % 4 == 1:
        return b""
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _readable_bytes(raw: bytes) -> int:
    """How many bytes from the first on are text."""
    if m := re.search(rb"[\x00-\x08\x0e-\x1f\x7f]", raw):
        raw = raw[: m.start()]
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start
    return len(raw)


def _held(raw: bytes, layer: Layer, span: tuple[int, int]) -> list[Layer]:
    """The layers that decoded bytes hold: their text, unpacked as often as they are compressed."""
    out, path, seen = [], (*layer.path, "base64"), set()
    while (found := _unpack(raw)) is not None and (mark := hashlib.sha256(raw).digest()) not in seen:
        seen.add(mark)
        kind, inner = found
        path = (*path, kind)
        if inner is None:
            return [Layer("", (*path, "oversized"), None, span), Layer("", path, None, span, parts=_parts(raw, kind))]
        raw = inner
    if t := _readable(raw):
        out.append(Layer(t, path, None, span))
    return out


def _readable_from(s: str, a: int) -> bytes:
    """The bytes that a run decodes to from letter a on, up to the first that isn't text."""
    n = 4096
    while True:
        part = s[a : a + n]
        part = part[: len(part) - (len(part) % 4 == 1)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        k = _readable_bytes(raw)
        if k < len(raw) - 4 or a + n >= len(s):
            return raw[:k]
        n *= 4


def _within(s: str, cuts: list[int]) -> Iterator[tuple[int, int, bytes]]:
    """Parts of a run that are base64 of something: (first, after, bytes), the longest from each cut, to a cut if it can be.

    What is unpacked or read from one cut is not looked at again, so that a run costs no more than in proportion.
    """
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    ends, after = sorted({*(c - 1 for c in cuts if c and s[c - 1] in "/+"), *cuts, len(s)}), 0
    for a in cuts:
        if a < after or len(s) - a < 16:
            continue
        head = base64.b64decode(s[a : a + 16])
        if _kind(head):
            b = len(s) if (len(s) - a) % 4 != 1 else len(s) - 1
            part = _decoded(s[a : min(b, a + 65_536)])
            if _kind(head) in ("bz2", "xz", "zstd") or _unpack(part) is not None:
                raw = _decoded(s[a:b])
                if _unpack(raw) is not None:
                    yield a, b, raw
                    after = b
            continue
        if _readable_bytes(head) < 9:
            continue
        raw = _readable_from(s, a)
        n = min(len(s), a + -(-len(raw) * 4 // 3))
        whole = lambda b: (b - a) % 4 != 1 and (b - a) * 3 // 4 <= len(raw) and ((b - a) * 3 // 4 == len(raw) or raw[(b - a) * 3 // 4] & 0xC0 != 0x80)  # noqa: B023, E731
        at = bisect.bisect_right(ends, n)
        b = next((e for e in reversed(ends[max(0, at - 64) : at]) if e - a >= 16 and whole(e)), 0)
        if not b:
            b = next((e for e in range(a + (n - a) // 4 * 4, a + 15, -4) if whole(e)), 0)
        if b:
            yield a, b, raw[: (b - a) * 3 // 4]
            after = b


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        s = m.group()
        if found := _held(_decoded(s), layer, layer.where(m.start(), m.end())):
            yield from found
        elif len(cuts := [0, *(k.end() for k in re.finditer(r"[/_+-]", s))]) > 1:
            for a, b, raw in _within(s, cuts):
                yield from _held(raw, layer, layer.where(m.start() + a, m.start() + b))
    for m in _WRAPPED.finditer(layer.text):
        lines = [(k.group(), m.start() + k.start()) for k in _LINE.finditer(m.group())]
        at = [0, *itertools.accumulate(len(x) for x, _ in lines)]
        for a, b, raw in _within("".join(x for x, _ in lines), at[:-1]):
            first, last = bisect.bisect_left(at, a), bisect.bisect_left(at, b) - 1
            if first < last:  # else it is a run of one line
                yield from _held(raw, layer, layer.where(lines[first][1], lines[last][1] + b - at[last]))


def scan(text: str | None) -> list[tuple[str, int, int, str, str]]:
    """Of a text: (rule, first character, character after the last, path of decodings, SHA-256 of the secret).

    The same secret in the same place is given once for a rule, with the shortest path. Spans are of the text itself.
    """
    if not text:
        return []
    work, seen = deque([Layer(text, (), None, (0, len(text)))]), set()
    found: dict[tuple[str, int, int, str], tuple[str, ...]] = {}
    while work:
        layer = work.popleft()
        if layer.parts is not None:
            if part := next(layer.parts, ""):
                work.appendleft(layer)  # its next part follows when this one is done
                layer = Layer(part, layer.path, None, layer.span, layer.above)
            else:
                continue
        t = layer.text
        low = t.lower()
        if layer.path[-1:] == ("oversized",):
            found.setdefault(("oversized_layer", *layer.span, ""), layer.path)
            continue
        for rule, words, pattern in _RULES:
            if any(w in low for w in words):
                for m in pattern.finditer(t):
                    a, b = m.span(1)
                    found.setdefault((rule, *layer.where(a, b), hashlib.sha256(m.group(1).encode("utf-8", "replace")).hexdigest()), layer.path)
        inner: list[Layer] = []
        if "%" in t:
            inner += _percent(layer)
        if "\\u" in t or "\\U" in t or "\\x" in t:
            inner += _escapes(layer)
        inner += _base64(layer)
        above = layer.above | {hashlib.sha256(t.encode("utf-8", "replace")).digest()}
        for x in inner:
            if x.parts is not None:
                x.above = above
                work.append(x)
                continue
            mark = hashlib.sha256(x.text.encode("utf-8", "replace")).digest()
            # oversized layers have no text; the list ends since a chain of layers never has the same content twice
            if (mark, x.span) not in seen and (mark not in above or x.path[-1] == "oversized"):
                seen.add((mark, x.span))
                x.above = above
                work.append(x)
    return sorted((r, a, b, ">".join(p), s) for (r, a, b, s), p in found.items())


def scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(d, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for x in scan(t)]
        if rows:
            doc, rule, a, z, path, sha = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(rule), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(path), pa.array(sha)],
                names=["doc_id", "rule", "start", "stop", "layers", "secret_sha256"],
            )


def secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every row of docs: (doc_id, rule, start, stop, layers, secret_sha256); the secret itself is not shown.

    docs needs doc_id (integer) and text. Spans count characters of the text; layers is the path of decodings, '' for
    the text itself. A secret in a layer that was base64 or compressed has the span of the whole encoded run; one in a
    single line of wrapped base64 may be given for that line too. What a compressed layer over MOST_UNPACKED bytes holds
    is scanned as text in parts, and not unpacked again.
    Rows with a null or empty text give no rows; a null doc_id stays null. Texts of any length are scanned whole.
    Repeated rows give repeated results, an empty table none. Columns other than doc_id and text are not read.
    One pass without a shuffle.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(scan_rows, "doc_id long, rule string, start int, stop int, layers string, secret_sha256 string")
