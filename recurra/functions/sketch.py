"""Hashes and MinHash sketches (H1 to H6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

# Stored sketches are comparable only with these.
POSITIONS, BANDS, ROWS = 128, 32, 4
FNV_BASE, FNV_PRIME = 2166136261, 16777619
MIX_FACTOR = 73244475
SEED_START, SEED_FACTOR, SEED_STEP = 2654435769, 1664525, 1013904223
# End of fixed values.
#: Shingles that are mixed at once; their 128 mixes each stay in a core's cache.
CHUNK = 256
#: Texts of so many units are hashed at once.
TOGETHER = 1 << 18
MASK = 4294967295


def seeds(n: int = POSITIONS) -> list[int]:
    """A linear congruential series modulo 2^32."""
    out, state = [], SEED_START
    for _ in range(n):
        state = (state * SEED_FACTOR + SEED_STEP) & MASK
        out.append(state)
    return out


def fnv1a(s: Column) -> Column:
    """FNV-1a of the code points of ``s``, 32 bits in a bigint."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(FNV_BASE).cast("bigint"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * FNV_PRIME).bitwiseAND(F.lit(MASK)))


def mix32(x: Column) -> Column:
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * MIX_FACTOR).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))


def signature_expr(shingles: Column) -> Column:
    """The sketch by its definition, as one expression; null for no shingles. Slow: the yardstick of ``signature``."""
    h = F.transform(shingles, fnv1a)
    minima = [F.array_min(F.transform(h, lambda x: mix32(x.bitwiseXOR(F.lit(s).cast("bigint"))))) for s in seeds()]
    return F.when(F.size(shingles) > 0, F.array(*minima))


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX_FACTOR)
    return x ^ (x >> np.uint32(16))


def _shingles(norm: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-16 units of normalized text, and where each shingle starts and ends in them."""
    words = norm.split(" ")
    if "" in words:
        words = [w for w in words if w]
        norm = " ".join(words)
    if not words:
        return (np.zeros(0, np.uint32),) * 3
    units = np.frombuffer(norm.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32)
    space = np.flatnonzero(units == 32)
    start = np.concatenate(([0], space + 1))
    end = np.concatenate((space, [len(units)]))
    k = min(k, len(words))
    return units, start[: len(words) - k + 1], end[k - 1 :]


def _fnv(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """FNV-1a of each stretch. The longest come first, so that those with a unit left are a stretch themselves."""
    if not len(start):
        return np.zeros(0, np.uint32)
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, longest = start[order], length[order[0]]
    live = np.cumsum(np.bincount(length, minlength=longest + 1)[::-1])[::-1]
    h = np.full(len(start), FNV_BASE, np.uint32)
    for j in range(longest):
        n = live[j + 1]
        h[:n] = (h[:n] ^ units[at[:n] + j]) * np.uint32(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def shingle_hashes(norm: str, k: int = 3) -> np.ndarray:
    """FNV-1a of each shingle of normalized text. A shingle is a stretch of it, so no string is built."""
    return _fnv(*_shingles(norm, k))


def batch_hashes(norms: list[str | None], k: int = 3):
    """The ``shingle_hashes`` of each text, hashed together up to ``TOGETHER`` units: a step for many costs what it does for one."""
    group, size = [], 0
    for t in norms:
        group.append(_shingles(t or "", k))
        size += len(group[-1][0])
        if size >= TOGETHER:
            yield from _hashed(group)
            group, size = [], 0
    yield from _hashed(group)


def _hashed(group: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    if not group:
        return []
    at = np.cumsum([0] + [len(units) for units, _, _ in group[:-1]])
    start = np.concatenate([s + i for (_, s, _), i in zip(group, at)]).astype(np.int64)
    end = np.concatenate([e + i for (_, _, e), i in zip(group, at)]).astype(np.int64)
    h = _fnv(np.concatenate([units for units, _, _ in group]), start, end)
    return np.split(h, np.cumsum([len(s) for _, s, _ in group[:-1]]))


def distinct_hashes(norm: str, k: int = 3) -> np.ndarray:
    """FNV-1a of each distinct shingle: shingles of one hash are compared by their units."""
    units, start, end = _shingles(norm, k)
    h = _fnv(units, start, end)
    _, where, n = np.unique(h, return_inverse=True, return_counts=True)
    again = n[where] > 1
    met = {units[start[i] : end[i]].tobytes(): h[i] for i in np.flatnonzero(again)}
    return np.concatenate((h[~again], np.fromiter(met.values(), np.uint32, len(met))))


_SHIFT, _FACTOR = np.uint32(16), np.uint32(MIX_FACTOR)
_SEEDS = np.array(seeds(), np.uint32)[:, None]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least mix of all hashes for each seed; chunks are mixed in place, as new arrays cost more than the mixing."""
    low = np.full(POSITIONS, MASK, np.uint32)
    x, y = np.empty((2, POSITIONS, min(CHUNK, len(hashes))), np.uint32)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[None, i : i + CHUNK]
        if part.shape[1] < x.shape[1]:
            x, y = np.empty((2, POSITIONS, part.shape[1]), np.uint32)
        np.bitwise_xor(part, _SEEDS, out=x)
        for _ in range(2):
            np.right_shift(x, _SHIFT, out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _FACTOR, out=x)
        np.right_shift(x, _SHIFT, out=y)
        np.bitwise_xor(x, y, out=x)
        np.minimum(low, x.min(axis=1), out=low)
    return low


def _once(f):
    """A filter on what a function of this kind gives is not pushed below it: the optimizer would compute it for both."""
    return f.asNondeterministic()


@_once
@F.arrow_udf(ArrayType(LongType()))
def signature(norm: pa.Array) -> pa.Array:
    """The sketch of normalized text, Arrow-batched; null for text without words."""
    out = []
    for h in batch_hashes(norm.to_pylist()):
        out.append(minima(h).astype(np.int64) if len(h) else None)
    return pa.array(out, pa.list_(pa.int64()))


@_once
@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "lo", "hi", "mixed")]))
def shingle_facts(norm: pa.Array) -> pa.Array:
    """Of the hashes of distinct shingles: how many, the least, the greatest, the sum of their mixes; null for text without words."""
    out = []
    for t in norm.to_pylist():
        h = distinct_hashes(t) if t else ()
        out.append({"n": len(h), "lo": int(h.min()), "hi": int(h.max()), "mixed": int(_mix(h).sum(dtype=np.int64))} if len(h) else None)
    return pa.array(out, pa.struct([(c, pa.int64()) for c in ("n", "lo", "hi", "mixed")]))


def est_jaccard(a: Column, b: Column) -> Column:
    """The share of equal positions; 0 if either is null or the lengths differ."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when(a.isNull() | b.isNull(), 0.0).when(F.size(a) != F.size(b), 0.0).otherwise(same / F.size(a).cast("double"))


def band_hashes(sig: Column) -> Column:
    """FNV-1a of each band's four values as little-endian bytes: array of 32 bigints."""
    out = []
    for b in range(BANDS):
        h = F.lit(FNV_BASE).cast("bigint")
        for r in range(ROWS):
            v = F.get(sig, F.lit(b * ROWS + r))
            for shift in (0, 8, 16, 24):
                h = (h.bitwiseXOR(F.shiftright(v, shift).bitwiseAND(F.lit(255))) * FNV_PRIME).bitwiseAND(F.lit(MASK))
        out.append(h)
    return F.array(*out)


@_once
@F.arrow_udf(ArrayType(LongType()))
def bands(sig: pa.Array) -> pa.Array:
    """The same as ``band_hashes``, Arrow-batched."""
    raw = sig.flatten().to_numpy(zero_copy_only=False).astype(np.uint32).view(np.uint8).reshape(-1, BANDS, 4 * ROWS).astype(np.uint32)
    h = np.full(raw.shape[:2], FNV_BASE, np.uint32)
    for j in range(4 * ROWS):
        h = (h ^ raw[:, :, j]) * np.uint32(FNV_PRIME)
    known = sig.is_valid().to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate(([0], np.cumsum(known) * BANDS)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(h.astype(np.int64).ravel()), mask=sig.is_null())


def band_keys(hashes: Column) -> Column:
    """Keys as text: band, colon, hash in base 36."""
    return F.transform(hashes, lambda h, i: F.concat(i.cast("string"), F.lit(":"), F.lower(F.conv(h.cast("string"), 10, 36))))
