"""Rolling fingerprints of byte windows, and positions chosen by content; numpy only."""

from __future__ import annotations

import numpy as np

#: Two primes below 2^31, each with a base: together a fingerprint has almost 62 bits.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in PRIMES]


def _power_table(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, up to n."""
    up, down = _powers[which]
    if len(up) <= n:
        p, b = PRIMES[which], BASES[which]
        inverse = pow(b, p - 2, p)
        size = 1 << int(n).bit_length()
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        k = 1
        while k < size:
            up[k : 2 * k] = up[:k] * np.uint64(pow(b, k, p)) % np.uint64(p)
            down[k : 2 * k] = down[:k] * np.uint64(pow(inverse, k, p)) % np.uint64(p)
            k *= 2
        _powers[which] = up, down
    return up, down


class Prefixes:
    """Fingerprints of any windows of a byte string, from prefix sums."""

    def __init__(self, data: bytes):
        c = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        self.sums, self.down = [], []
        for w, p in enumerate(PRIMES):
            up, down = _power_table(w, self.n + 1)
            # a term is under 2^39 before it is reduced and under 2^31 after, so sums of 2^33 bytes fit 64 bits
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * up[: self.n] % np.uint64(p), out=s[1:])
            self.sums.append(s)
            self.down.append(down)

    def windows(self, start: np.ndarray, length) -> np.ndarray:
        """Fingerprints of the windows that begin at ``start``."""
        out = np.zeros(len(start), np.uint64)
        for w, p in enumerate(PRIMES):
            s = self.sums[w]
            h = (s[start + length] - s[start]) % np.uint64(p) * self.down[w][start] % np.uint64(p)
            out = (out << np.uint64(31)) | h
        return out

    def all_windows(self, length: int) -> np.ndarray:
        n = max(0, self.n - length + 1)
        out = np.zeros(n, np.uint64)
        for w, p in enumerate(PRIMES):
            s = self.sums[w]
            h = (s[length : length + n] - s[:n]) % np.uint64(p) * self.down[w][:n] % np.uint64(p)
            out = (out << np.uint64(31)) | h
        return out


def scramble(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix, so that the order of fingerprints says nothing about texts."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values: the place of its smallest one, the first among equals."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    pad = -len(h) % width
    top = np.iinfo(np.uint64).max
    blocks = np.concatenate((h, np.full(pad, top, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    flat = blocks.ravel()
    at = np.arange(len(flat))
    # first place of each block's running minimum, and nearest place to the right that is the minimum of its block's rest
    new = ahead != np.concatenate((ahead[:1], ahead[:-1]))
    new[::width] = True
    first = np.maximum.accumulate(np.where(new, at, 0))
    nearest = np.minimum.accumulate(np.where(flat == behind, at, len(flat))[::-1])[::-1]
    return np.where(behind[:n] <= ahead[width - 1 : width - 1 + n], nearest[:n], first[width - 1 : width - 1 + n])
