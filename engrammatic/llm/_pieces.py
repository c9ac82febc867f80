"""Texts in pieces that byte-level BPE never merges across, at Arrow speed.

A piece ends before every single space that follows the end of a word, so pieces can be pre-tokenised one by one with
the same result as the whole text. Texts in which white space is mixed so that this doesn't hold are pre-tokenised
as a whole and their pre-tokens taken as pieces. The pieces of a text put together are the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from engrammatic.llm._arrow import texts

#: Unicode's White_Space, which \\s stands for in the published pattern.
_W = r"\t-\r \x85\xa0  -     　"
#: The published pre-tokenisation pattern of the byte-level BPE vocabularies.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
_COMPILED = regex.compile(PATTERN)
_RE2_W = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MIXED = rf"\x00|  |[{_RE2_W}] [{_RE2_W}]"

#: Bytes of text whose pieces are looked up together.
SLICE = 8 << 20


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text: these put together are the text."""
    return _COMPILED.findall(text)


def pieces(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different pieces of a slice; for each piece of it the place in that list; and each row's first piece."""
    a = texts(column)
    mixed = np.asarray(pc.match_substring_regex(a, _MIXED))
    lists = pc.split_pattern(pc.replace_substring(a, " ", "\x00 "), "\x00")
    if mixed.any():
        own = lists.to_pylist()
        for i in np.flatnonzero(mixed):
            own[i] = pre_tokens(a[int(i)].as_py())
        lists = pa.array(own, pa.list_(pa.large_string()))
    off = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary.to_pylist(), np.asarray(flat.indices).astype(np.int64), off - off[0]
