"""Words of UTF-8 text as 64-bit hashes, by whole-array arithmetic on Arrow's own buffers.

Both word patterns in use treat every byte from 0x80 on as a word byte, so splitting bytes equals
splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_ALL = np.arange(256)
#: `[^\x20\x09-\x0D]`
NOT_BLANK = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` of lower-cased text: digits, letters, and all that is not ASCII
WORD_CHAR = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL | 0x20) >= 0x61) & ((_ALL | 0x20) <= 0x7A) & (_ALL < 0x80) | (_ALL >= 0x80)
LOWERED = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL | 0x20, _ALL).astype(np.uint8)

_BASE, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, x in (("up", _BASE), ("down", _INVERSE)):
            _powers[name] = np.concatenate([[U(1)], np.cumprod(np.full(max(n, 1 << 21), x, dtype=U))])
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(NamedTuple):
    doc: np.ndarray  # of each word, the number of its text in the chunk
    key: np.ndarray  # of each word, its hash
    start: np.ndarray  # byte positions within data
    end: np.ndarray
    data: np.ndarray  # lower-cased bytes of the chunk
    first: int  # number of the chunk's first text in the array
    n_texts: int

    def per_text(self) -> np.ndarray:
        """How many words each text has."""
        return np.bincount(self.doc, minlength=self.n_texts)


def chunks(texts: pa.Array, word_bytes: np.ndarray, chunk_bytes: int = 1 << 21) -> Iterator[Words]:
    """The words of all texts (null: none), in chunks of whole texts of about ``chunk_bytes``."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + chunk_bytes, "right")) - 1)
        yield _words(raw[at[first] : at[last]], at[first : last + 1] - at[first], word_bytes, first)
        first = last


def _words(raw: np.ndarray, at: np.ndarray, word_bytes: np.ndarray, first: int) -> Words:
    low = LOWERED[raw]
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = word_bytes[raw]
    step = np.diff(inside)
    # a text's end also ends a word: mark both sides of each inner border between two word bytes
    inner = np.unique(at[1:-1])
    inner = inner[(inner > 0) & (inner < len(raw))]
    joined = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]
    start = np.flatnonzero(step == 1)
    end = np.flatnonzero(step == -1)
    if len(joined):
        start, end = np.sort(np.concatenate([start, joined])), np.sort(np.concatenate([end, joined]))
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum((low.astype(U) + U(1)) * up[: len(raw)], out=sums[1:])
    key = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    return Words(np.searchsorted(at, start, "right") - 1, key, start, end, low, first, len(at) - 1)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``width`` words within a text; a shorter text, but not an
    empty one, gives one shingle of all its words."""
    doc, key = words.doc, words.key
    n = len(key)
    value = np.zeros(max(0, n - width + 1), dtype=U)
    factors = mix(np.arange(1, width + 1, dtype=U) * U(0x632BE59BD9B4E019))
    for j in range(width if len(value) else 0):
        value += mix(key[j : n - width + 1 + j] ^ factors[j])
    whole = doc[: len(value)] == doc[width - 1 :] if len(value) else np.zeros(0, bool)
    owner, value = doc[: len(value)][whole], mix(value[whole])
    counts = words.per_text()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(counts)])
        extra = [mix(np.sum(mix(key[begin[d] : begin[d + 1]] ^ factors[: counts[d]]), keepdims=True, dtype=U) + U(counts[d]))[0] for d in short]
        owner, value = np.concatenate([owner, short]), np.concatenate([value, np.array(extra, dtype=U)])
    return owner, value
