"""Signatures of word shingle sets and the pigeonring check of wide fingerprints, in numpy.

A text's signature is a SimHash of 256 bits over its set of shingles, in eight segments of 32 bits on a ring, and
BANDS keys, each of ROWS minima of the set. Two sets of Jaccard 0.8 differ in some 39 of 256 bits (15 %), too many
for keys made of the bits themselves, so the minima bring candidates together: 0.9998 of the pairs at 0.8 share one
of the keys. A candidate must then have a chain of segments, from some segment on, whose differences stay within 8
bits a segment; only then are all bits compared, and what differs in at most WIDE of them meets the exact check.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import xxhash

LANES, BANDS, ROWS = 4, 16, 4
WIDE = 64  # bits; 0.8 is 4.4 standard deviations below
_CHAIN = 4
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANE = np.arange(8, dtype=np.int64) * 256
_DRAW = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_XOR, _ODD = _DRAW[0], _DRAW[1] * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of each run of words, repeats included; fewer words are one shingle, no words none."""
    w = text.lower().split()  # bytes: only A-Z change, only \\x20 and \\x09-\\x0D split
    if not w:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), runs), np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of h, as a signed long; 0 for none."""
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.bincount((h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048)
    ones = np.einsum("kv,vb->kb", counts.reshape(8, 256), _BIT)[::-1].ravel() * 2 > len(h)
    return int(np.packbits(ones).view(">i8")[0])


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signature(text: bytes, words: int) -> list[int]:
    """LANES fingerprint words and BANDS keys, as signed longs; empty for a text without words."""
    h = np.unique(shingles(text, words))
    if not len(h):
        return []
    lanes = [majority(_mix(h + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) for j in range(LANES)]
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), 1 << 13):
        least = np.minimum(least, ((h[at : at + (1 << 13)] ^ _XOR) * _ODD).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mix(key ^ column)
    return lanes + key.view(np.int64).tolist()


def homes(key: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A number for each pair of signed longs."""
    return _mix(key.view(np.uint64) ^ _mix(block.view(np.uint64))).view(np.int64)


def own_pairs(band: np.ndarray, keys: np.ndarray, node: np.ndarray, own: np.ndarray, other: np.ndarray) -> Callable:
    """For near_pairs: whether a pair is this run's. Of all runs that two nodes share, one is theirs.

    A node has rows under each of its keys (their place is band), and is dealt from its block (own) to pairs with each other block.
    A number made of both nodes chooses one of the keys that they share, so a large group's pairs are spread over its keys.
    """

    def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        there = (own[a] != own[b]) | (own[a] == other[a])
        shared = np.cumsum(keys[a] == keys[b], axis=1)
        turn = _mix(node[a].view(np.uint64) + node[b].view(np.uint64)) % np.maximum(shared[:, -1], 1).astype(np.uint64)
        return there & (shared[np.arange(len(a)), band[a]] - 1 == turn.astype(np.int64))

    return wanted


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Of two sorted arrays without repeats; where their lengths alone keep it under least, that bound."""
    bound = min(len(a), len(b)) / max(len(a), len(b))
    if bound < least:
        return bound
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _chained(bits: np.ndarray) -> np.ndarray:
    """Whether from some segment on the chains of 1 to _CHAIN segments stay within their share of WIDE."""
    share = WIDE // bits.shape[1]
    total, alive = np.zeros(bits.shape, np.int64), np.ones(bits.shape, bool)
    for step in range(_CHAIN):
        total += np.roll(bits, -step, axis=1)
        alive &= total <= share * (step + 1)
    return alive.any(axis=1)


def near_pairs(run: np.ndarray, f: np.ndarray, label: np.ndarray | None = None, wanted: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs within WIDE bits in each run of equal numbers, and of the rows that have more of them.

    run is sorted, f holds a fingerprint a row as eight uint32. Without labels the pairs are a spanning forest of
    fewest differing bits, and the rows are those of all other pairs; with labels all pairs of two labels come, if
    wanted says so of their places.
    """
    at, d = np.arange(len(run)), 0
    found = []
    while True:
        d += 1
        at = at[at + d < len(run)]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        pair = at if label is None else at[label[at] != label[at + d]]
        pair = pair if wanted is None else pair[wanted(pair, pair + d)]
        bits = np.bitwise_count(f[pair] ^ f[pair + d])
        fits = _chained(bits)
        pair, bits = pair[fits], bits[fits].sum(axis=1)
        pair, bits = pair[bits <= WIDE], bits[bits <= WIDE]
        found.append(np.stack([pair, pair + d, bits.astype(np.int64)]).astype(np.int32))
    a, b, bits = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int32)
    if label is not None:
        return a, b, a[:0]
    tree = _forest(len(run), a, b, bits)
    rest = np.ones(len(a), bool)
    rest[tree] = False
    return a[tree], b[tree], np.union1d(a[rest], b[rest])


def _forest(n: int, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the pairs that join what pairs of fewer bits, or earlier ones, do not."""
    root = np.arange(n)
    tree = []
    for level in np.unique(bits):
        open_ = np.flatnonzero((bits == level) & (root[a] != root[b]))
        for i, x, y in zip(open_.tolist(), root[a[open_]].tolist(), root[b[open_]].tolist()):
            while root[x] != x:
                x = int(root[x])
            while root[y] != y:
                y = int(root[y])
            if x != y:
                root[max(x, y)] = min(x, y)
                tree.append(i)
        while (root[root] != root).any():
            root = root[root]
    return np.array(tree, np.int64)
