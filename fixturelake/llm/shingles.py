"""Word and shingle hashes of whole Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is hashed in pieces cut at white space.
SLICE = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE + 2)
        _powers.clear()
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def _slice_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in a slice; a word also ends before each of the breaks."""
    up, down = _tables(len(data) + 1)
    blank = _SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = False
    edge[breaks] = True
    ink = ~blank
    starts = np.flatnonzero(ink & (np.concatenate(([True], blank[:-1])) | edge[:-1]))
    ends = np.flatnonzero(ink & (np.concatenate((blank[1:], [True])) | edge[1:])) + 1
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (one longer than the texts)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at, end = int(offsets[0]), int(offsets[-1])
    hashes, places = [], []
    while at < end:
        to = min(at + SLICE, end)
        if to < end:  # cut before a text's start or else at white space
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:
                gaps = np.flatnonzero(_SPACE[data[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:  # one word longer than a slice
                    stop = int(offsets[k + 1])
                    gaps = np.flatnonzero(_SPACE[data[to:stop]])
                    to = to + int(gaps[0]) + 1 if len(gaps) else stop
        breaks = offsets[(offsets > at) & (offsets < to)] - at
        starts, h = _slice_words(data[at:to], breaks)
        hashes.append(h)
        places.append(starts + at)
        at = to
    hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    places = np.concatenate(places) if places else np.empty(0, np.int64)
    return hashes, np.searchsorted(places, offsets)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; of fewer words than width, of the whole sequence."""
    words, first = word_hashes(texts)
    key = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        key = mix(key + words[k : len(words) - width + 1 + k] * _U(2 * k + 3)) if len(key) else key
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(key[a : b - width + 1]))
        elif n:
            short = np.full(1, n, np.uint64)
            for k in range(n):
                short = mix(short + words[a + k : a + k + 1] * _U(2 * k + 5))
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out
