"""Word shingles of texts as sorted arrays of 64-bit hashes, worked out for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are worked on in runs of about so many bytes; a run needs some hundred times its size.
RUN_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(of: np.uint64, n: int) -> np.ndarray:
    """of ** 0 .. n-1, modulo 2 ** 64."""
    have = _powers.get(str(of))
    if have is None or len(have) < n:
        p = np.full(max(n, 2 * RUN_BYTES), of, dtype=np.uint64)
        p[0] = 1
        _powers[str(of)] = have = np.multiply.accumulate(p)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    blank = _BLANK[data]
    low = np.where(blank, np.uint8(0), _LOWER[data]).astype(np.uint64)
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([blank[1:], [True]])) + 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((low + np.uint64(1)) * _power(_BASE, len(data)), dtype=np.uint64)])
    word = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(starts, bounds)])  # of each text's words
    n = np.diff(first)
    chain = word.copy()
    for k in range(1, words):
        chain[: len(chain) - k] = mix(chain[: len(chain) - k] * np.uint64(0xD6E8FEB86659FD93) + word[k:]) if len(chain) > k else chain[: len(chain) - k]
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if n[i] >= words:
            yield np.unique(chain[a : b - words + 1])
        elif n[i]:
            h = word[a]
            for w in word[a + 1 : b]:
                h = mix(np.array([h]) * np.uint64(0xD6E8FEB86659FD93) + w)[0]
            yield np.array([mix(np.array([h ^ np.uint64(int(n[i]))]))[0]], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `words` words, A to Z in lower case; with fewer words, that of the whole
    sequence; without words, none. Words are runs of characters other than space and U+0009 to U+000D."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode()
        run.append(data)
        size += len(data)
        if size >= RUN_BYTES:
            yield from _run(run, words)
            run, size = [], 0
    if run:
        yield from _run(run, words)
