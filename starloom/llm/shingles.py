"""Sets of hashed word shingles, computed for many texts at once on their UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Splitmix's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, in order; and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() folds A-Z only
    data = np.frombuffer(b" ".join([*raw, b""]) or b" ", np.uint8)
    word = ~_WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    h = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(starts, borders)
    return h, np.diff(np.concatenate(([0], upto)))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of `words` words; with fewer words, of all of them as one."""
    h, counts = word_hashes(texts)
    n = len(h)
    run = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        run = (run ^ (run >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(run)]
    run = mixed(run)
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(np.unique(run[at : at + c - words + 1]))
        elif c:
            out.append(np.frombuffer(hashlib.blake2b(h[at : at + c].tobytes(), digest_size=8, key=b"short").digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def slices(texts: list[str], chars: int = 1_000_000):
    """(from, to) of runs of texts of about so many characters."""
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) <= chars):
            held += len(texts[b])
            b += 1
        yield a, b
        a = b
