"""Words of byte strings as 64-bit hashes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import BLANKS



def _table(blanks: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(blanks)] = True
    return out


#: The six ASCII blanks, and all ASCII characters but letters and digits.
BLANK = _table(BLANKS)
NOT_ALNUM = _table(bytes(c for c in range(128) if not chr(c).isalnum()))
_BYTE = np.random.default_rng(20240).integers(0, 1 << 64, 256, np.uint64)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BASE, _CHUNK = 0x9E3779B97F4A7C15 | 1, 1 << 20
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mixed(a * np.uint64(0xD6E8FEB86659FD93) + mixed(b + np.uint64(0x2545F4914F6CDD1D)))


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 1)
        made = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]) for base in (_BASE, _INVERSE)]
        _powers[:] = [np.multiply.accumulate(x) for x in made]
    return _powers[0], _powers[1]


def _chunk_words(data: bytes, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    blank = blanks[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _up_to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    length = (end - start).astype(np.uint64)
    return mixed((total[end] - total[start]) * down[start] + length * np.uint64(0xA24BAED4963EE407)), start, end


def word_places(data: bytes, blanks: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of data, words being parted by the bytes marked in blanks (the blanks
    among them). Long data is taken in chunks that end at blanks, so working arrays stay small unless one word is long
    itself."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        if end < len(data):
            cut = max(data.rfind(bytes([b]), at, end) for b in BLANKS)
            if cut <= at:
                nexts = [p for b in BLANKS if (p := data.find(bytes([b]), end)) >= 0]
                cut = min(nexts, default=len(data) - 1)
            end = cut + 1
        h, s, e = _chunk_words(data[at:end], blanks)
        found.append((h, s + at, e + at))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Words:
    """Words of several texts in order: hashes, and places in the texts laid end to end; numbers of words by text."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words_of(texts: list[str | None], lower: bool = True, blanks: np.ndarray = BLANK) -> Words:
    """The words of whole texts (null: none); lower: A-Z count as a-z."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(raw)
    data = data.translate(_LOWER) if lower else data
    hashes, starts, ends = word_places(data, blanks)
    stops = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    return Words(data, hashes, starts, ends, np.diff(np.concatenate([[0], np.searchsorted(starts, stops, "left")])))


def texts_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    found = words_of(texts, lower)
    return found.hashes, found.counts
