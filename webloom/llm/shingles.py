"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words hashed in one step, so that they stay in the processor's cache, and bytes of text below which single words are faster.
TOGETHER, FEW = 16_384, 2000
#: Fixed values of XXH3: the begin of its secret, then its multipliers.
SECRET = np.frombuffer(bytes.fromhex(
    "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671f"
    "cb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"), "<u8")
#: How words of each length are hashed, the last for all longer ones.
KINDS = np.searchsorted([3, 8, 16, 32], np.arange(34)).astype(np.int8)
PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9FB21C651E98DF25, 0x165667919E3779F9)]


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    return x ^ (x >> np.uint64(by))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit products, one on the other."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    first = a0 * b0
    cross = a1 * b0 + (first >> half)
    other = a0 * b1 + (cross & low)
    return (a1 * b1 + (cross >> half) + (other >> half)) ^ ((other << half) | (first & low))


def _last(x: np.ndarray) -> np.ndarray:
    return _shift(_shift(x, 37) * PRIMES[4], 32)


def hashed(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH3 of the words at ``starts`` (none empty), as the library gives them; words up to 32 bytes all at once."""
    four, eight = (np.ndarray(max(0, len(letters) - width + 1), f"<u{width}", letters, strides=(1,)) for width in (4, 8))
    out = np.empty(len(starts), np.uint64)
    kinds = KINDS[np.minimum(sizes, len(KINDS) - 1)]
    with np.errstate(over="ignore"):
        for kind in range(5):
            own = np.flatnonzero(kinds == kind)
            if not len(own):
                continue
            at, size = starts[own], sizes[own]
            end, length = at + size, size.astype(np.uint64)
            if kind == 0:
                one, two, three = (letters[i].astype(np.uint64) for i in (at, at + (size >> 1), end - 1))
                x = (one << np.uint64(16)) | (two << np.uint64(24)) | three | (length << np.uint64(8))
                x ^= (SECRET[0] & np.uint64(0xFFFFFFFF)) ^ (SECRET[0] >> np.uint64(32))
                out[own] = _shift(_shift(_shift(x, 33) * PRIMES[1], 29) * PRIMES[2], 32)
            elif kind == 1:
                x = four[end - 4].astype(np.uint64) + (four[at].astype(np.uint64) << np.uint64(32))
                x ^= SECRET[1] ^ SECRET[2]
                x = (x ^ _rotated(x, 49) ^ _rotated(x, 24)) * PRIMES[3]
                out[own] = _shift((x ^ ((x >> np.uint64(35)) + length)) * PRIMES[3], 28)
            elif kind == 2:
                low, high = eight[at] ^ SECRET[3] ^ SECRET[4], eight[end - 8] ^ SECRET[5] ^ SECRET[6]
                out[own] = _last(length + low.byteswap() + high + _folded(low, high))
            elif kind == 3:
                x = length * PRIMES[0] + _folded(eight[at] ^ SECRET[0], eight[at + 8] ^ SECRET[1])
                out[own] = _last(x + _folded(eight[end - 16] ^ SECRET[2], eight[end - 8] ^ SECRET[3]))
            else:
                whole = letters.tobytes()
                out[own] = [xxhash.xxh3_64_intdigest(whole[i:j]) for i, j in zip(at.tolist(), end.tolist(), strict=True)]
    return out


def words_at(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words, A-Z lower-cased, split at ASCII white space only; in numpy, whatever words there are."""
    letters = np.frombuffer(text.lower(), np.uint8)
    space = np.ones(len(letters) + 2, bool)
    space[1:-1] = (letters - np.uint8(9) < 5) | (letters == 32)  # below 9 it turns over
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), TOGETHER):
        part = slice(i, i + TOGETHER)
        out[part] = hashed(letters, starts[part], ends[part] - starts[part])
    return starts, out


def word_hashes(text: str | bytes) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased; bytes split at ASCII white space only."""
    text = text if isinstance(text, bytes) else text.encode()
    if len(text) < FEW:
        return np.array([xxhash.xxh3_64_intdigest(word) for word in text.lower().split()], np.uint64)
    return words_at(text)[1]


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    size = len(hashes) - n + 1
    out = np.zeros(max(0, size), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += hashes[k : k + size]
    return out ^ (out >> np.uint64(29))


def shingle_set(text: str, n: int = 5) -> np.ndarray:
    """Distinct hashed ``n``-word shingles, sorted; fewer words are one shingle as a whole, no words none."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        return rolled(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(rolled(hashes, n))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))
