"""NumPy kernels over Arrow batches: rolling polynomial hashes of bytes and words, winnowing, packed blobs."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

U = np.uint64
#: Odd multiplier of mix steps.
BASE = 0x9E3779B97F4A7C15
#: Rolling hashes are polynomials modulo this prime, at a point drawn once.
PRIME = (1 << 61) - 1
POINT = int(np.random.default_rng(20241127).integers(1 << 60, PRIME))
TOP = U(0xFFFFFFFFFFFFFFFF)
#: A random odd value for each byte.
BYTE = np.random.default_rng(20240601).integers(0, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_pow: dict[str, np.ndarray] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, of values below 2**64; in place."""
    high = x >> U(61)
    x &= U(PRIME)
    x += high
    np.subtract(x, U(PRIME), out=x, where=x >= U(PRIME))
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below it, by halves of 31 bits."""
    ah, al, bh, bl = a >> U(31), a & U(0x7FFFFFFF), b >> U(31), b & U(0x7FFFFFFF)
    mid = al * bh
    mid += ah * bl
    ah *= bh
    ah <<= U(1)
    ah += mid >> U(30)
    mid &= U(0x3FFFFFFF)
    mid <<= U(31)
    ah += mid
    al *= bl
    ah += _folded(al)
    return _folded(ah)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """POINT**i and its inverse for i < n, modulo PRIME."""
    if not _pow or len(_pow["up"]) < n:
        for name, base in (("up", POINT), ("down", pow(POINT, -1, PRIME))):
            x = np.ones(1, U)
            while len(x) < max(n, 1 << 16):
                x = np.concatenate([x, times(x, np.full(len(x), pow(base, len(x), PRIME), U))])
            _pow[name] = x
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def prefix(tokens: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo PRIME; hashed() takes the hash of any window from them."""
    up, _ = powers(len(tokens) + 1)
    out = np.zeros(len(tokens) + 1, U)
    terms = times(_folded(tokens.copy()), up[: len(tokens)])
    low = np.cumsum(terms & U(0x7FFFFFFF))  # halves of 31 bits leave room for 2**33 terms
    terms >>= U(31)
    high = _folded(np.cumsum(terms, out=terms))
    turned = (high << U(31)) & U(PRIME)  # high * 2**31 modulo PRIME is a turn of its 61 bits
    turned |= high >> U(30)
    out[1:] = _folded(turned + _folded(low))
    return out


def hashed(p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of tokens[start:stop], the same wherever it lies: two different windows of n tokens are equal for n of 2**61 points at most."""
    _, down = powers(len(p))
    return mix(times(_folded(p[stop] + (U(PRIME) - p[start])), down[start]))


def rolling(p: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` tokens, rows left out of account."""
    _, down = powers(len(p))
    n = len(p) - width
    return mix(times(_folded(p[width:] + (U(PRIME) - p[:n])), down[:n]))


def digests(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row's bytes."""
    data = memoryview(np.ascontiguousarray(raw))
    both = [xxhash.xxh3_128_intdigest(data[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
    return np.array([[x >> 64, x & 0xFFFFFFFFFFFFFFFF] for x in both], U).reshape(-1, 2)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, null as empty, and where each row begins (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each word `[^\\x20\\x09-\\x0D]+` and the first word of each row; words never cross rows."""
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    stops = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, stops, np.searchsorted(starts, off)


def word_tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit token for each word, the words' starts and stops, and the first word of each row."""
    starts, stops, first = words_of(raw, off)
    return hashed(prefix(BYTE[raw]), starts, stops), starts, stops, first


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of x[i:i + width] for each i; x counts as extreme beyond its end."""
    pick, fill = (np.minimum, TOP) if least else (np.maximum, U(0))
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        moved = np.full(len(x), fill)
        if step < len(x):
            moved[:-step] = out[step:]
        out, have = pick(out, moved), have + step
    return out


def spans(first: np.ndarray, size: int) -> np.ndarray:
    """The row of each of `size` tokens."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Mask of the tokens at which a whole window of its row starts."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return left >= width


def chunks(off: np.ndarray, most: int):
    """Ranges of rows with about `most` bytes each; a longer row stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def dump(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def load(blob: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _murmur(key: int) -> int:
    """Spark's hash of one int column."""
    m = 0xFFFFFFFF
    k = key * 0xCC9E2D51 & m
    k = (k << 15 | k >> 17) & m
    h = 42 ^ (k * 0x1B873593 & m)
    h = (h << 13 | h >> 19) & m
    h = (h * 5 + 0xE6546B64 & m) ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def route_keys(n: int) -> list[int]:
    """An int for each of n partitions that Spark's hash partitioning sends there."""
    keys: dict[int, int] = {}
    i = 0
    while len(keys) < n:
        keys.setdefault(_murmur(i) % n, i)
        i += 1
    return [keys[p] for p in range(n)]


def by_part(part: np.ndarray, n: int):
    """(partition, rows of it) in row order."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    for p in range(n):
        if cut[p] < cut[p + 1]:
            yield p, order[cut[p] : cut[p + 1]]
