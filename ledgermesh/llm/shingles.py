"""Sets of 5-word shingles as 64-bit hashes, many texts at a time.

A word's hash is a polynomial modulo 2 ** 64, for all words of a piece of text at
once.  Long words that differ can have the same polynomial whatever the base, so
words beyond LONG bytes are hashed one by one by a hash of another kind.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Bytes up to which a word's polynomial is its hash.
LONG = 32
_SEED = np.random.default_rng(20240501)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)[_FOLD]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WEIGHTS = _SEED.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 18)
        for name, base in (("up", _BASE), ("back", _BACK)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["back"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _some(texts: list[bytes]) -> list[np.ndarray]:
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, back = powers(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_VALUE[a] * up[: len(a)], out=total[1:])
    word = ~_WHITE[a]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    words = mixed((total[ends] - total[starts]) * back[starts])
    long_ones = np.flatnonzero(ends - starts > LONG)
    if len(long_ones):
        folded = memoryview(_FOLD[a].astype(np.uint8))
        words[long_ones] = [xxhash.xxh3_64_intdigest(folded[s:e]) for s, e in zip(starts[long_ones].tolist(), ends[long_ones].tolist())]
    n = len(words)
    grams = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for i, weight in enumerate(_WEIGHTS):
        grams += words[i : i + len(grams)] * weight
    grams = mixed(grams)
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])).tolist()
    out = []
    for first, end in zip(at[:-1], at[1:]):
        if end - first >= WORDS:
            s = np.sort(grams[first : end - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif end > first:
            out.append(mixed((words[first:end] * _WEIGHTS[: end - first]).sum(dtype=np.uint64, keepdims=True) + np.uint64(end - first)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], chunk: int = 1 << 18):
    """Yields for each text its sorted distinct shingle hashes (uint64); the whole sequence is one where words are fewer."""
    held, size = [], 0
    for t in texts:
        held.append((t or "").encode())
        size += len(held[-1])
        if size >= chunk:
            yield from _some(held)
            held, size = [], 0
    if held:
        yield from _some(held)
