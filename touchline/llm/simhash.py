"""SimHash fingerprints of whole texts and Golay-code fuzzy hashing of them.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits, each
padded to 23). The binary Golay code is perfect: every 23-bit word lies within
3 errors of exactly one of its 4096 codewords. `near(x)` are the codewords that
x or one of its one-bit neighbours decodes to (one if x is within 2 errors of
its codeword, else up to six).

Two fingerprints at most 4 bits apart have, by pigeonhole, two segments with at
most 2 errors together: (<=1, <=1) or (0, 2). For every pair (i, j) of segments a
fingerprint gets the keys {decode(i)} x near(j) and near(i) x {decode(j)}.
 * (<=1, <=1): (decode(a_i), decode(b_j)) is a key of both, since b_j is a
   neighbour of a_j and a_i one of b_i.
 * (0, 2): decode(a_i) = decode(b_i), and the word between a_j and b_j is a
   neighbour of both, so its codeword is in near(a_j) and near(b_j).
So every linked pair meets under a key; about 29 keys of 24 bits each.
"""

from __future__ import annotations

import numpy as np
import xxhash

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0xC75  # x^11+x^10+x^6+x^5+x^4+x^2+1

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42, chunk: int = 65536) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats counted.

    Lower-cases A-Z only; words are runs of anything but ASCII white space.
    Fewer words than `width`: the whole sequence is the one shingle; none: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    n = len(starts)
    counts = np.zeros((8, 256), np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, chunk):
        hashes = np.array([digest(joined[a:b], seed) for a, b in
                           zip(starts[k:k + chunk].tolist(), ends[k:k + chunk].tolist())], dtype="<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[j] += np.bincount(octets[:, j], minlength=256)
    ones = (counts @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Error pattern of each of the 2048 syndromes, and the syndromes of all 12-bit high parts."""
    def rem(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
        return x

    one = 1 << np.arange(23, dtype=np.int64)
    a, b, c = (m.ravel() for m in np.meshgrid(np.r_[0, one], np.r_[0, one], np.r_[0, one]))
    weight_ok = ((a == 0) | (a != b)) & ((b == 0) | (b != c)) & ((a == 0) | (a != c))
    errors = np.unique((a | b | c)[weight_ok])
    table = np.zeros(2048, np.int64)
    table[rem(errors)] = errors
    return table, rem(np.arange(4096, dtype=np.int64) << 11)


_ERROR_OF, _HIGH = _golay_tables()


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit codeword index of each 23-bit word (its corrected high part)."""
    syndrome = (words & 2047) ^ _HIGH[words >> 11]
    return (words ^ _ERROR_OF[syndrome]) >> 11


_FLIPS = np.r_[0, 1 << np.arange(23, dtype=np.int64)]


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every distinct key of every fingerprint (int64 bit patterns)."""
    u = fingerprints.astype(np.int64).view(np.uint64)
    near, own = [], []
    for start, length in SEGMENTS:
        x = ((u >> np.uint64(start)) & np.uint64((1 << length) - 1)).astype(np.int64)
        c = decode(x[:, None] ^ _FLIPS[None, :])  # column 0: its own codeword
        own.append(c[:, :1].copy())
        near.append(c)
    parts = []
    for p, (i, j) in enumerate(PAIRS):
        k = np.concatenate(((own[i] << 12) | near[j], (near[i] << 12) | own[j]), axis=1) | (p << 24)
        parts.append(k)
    k = np.sort(np.concatenate(parts, axis=1), axis=1)
    first = np.ones(k.shape, bool)
    first[:, 1:] = k[:, 1:] != k[:, :-1]
    rows, cols = np.nonzero(first)
    return rows, k[rows, cols]
