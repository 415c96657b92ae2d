"""Words and word windows of a slice of texts as numpy arrays over their bytes.

Every separator is ASCII, so words can be found on the UTF-8 bytes of all texts
of a slice at once. Words and windows are compared by 64-bit hashes: two
different ones meet with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import functools

import numpy as np

SEGMENT = 2 << 20
_PERIOD_BITS = 16
_PERIOD = 1 << _PERIOD_BITS
_GRAM = np.uint64(0x9E3779B97F4A7C15)


def not_blank() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    found = np.ones(256, bool)
    found[[0x20, *range(0x09, 0x0E)]] = False
    return found


def alphanumeric() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are lower case."""
    found = np.zeros(256, bool)
    found[0x80:] = True
    for first, last in ("09", "az", "AZ"):
        found[ord(first) : ord(last) + 1] = True
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240607)
    exact = random.integers(1, 1 << 63, 256, "u8") * np.uint64(2) + np.uint64(1)
    lowered = exact.copy()
    lowered[ord("A") : ord("Z") + 1] = exact[ord("a") : ord("z") + 1]
    powers = random.integers(1, 1 << 63, _PERIOD, "u8") * np.uint64(2) + np.uint64(1)
    return exact, lowered, powers


class Texts:
    """The bytes of several texts, each followed by a line break."""

    def __init__(self, texts: list[str] | list[bytes]):
        raw = [t if isinstance(t, bytes) else t.encode() for t in texts]
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", "u1") if raw else np.empty(0, "u1")
        # Bytes of text i: begins[i] up to begins[i + 1] - 1.
        self.begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw], dtype="i8")])
        self.n = len(raw)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype="i8")])
        return total[self.begins[1:]] - total[self.begins[:-1]]


class Words:
    """Starts, ends and hashes of the words of all texts, in order."""

    def __init__(self, texts: Texts, table: np.ndarray, lower: bool):
        self.texts = texts
        self.inside = table[texts.data]
        edges = np.flatnonzero(np.diff(self.inside.view("i1"), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        # Words of text i: first[i] up to first[i + 1].
        self.first = np.searchsorted(self.starts, texts.begins)
        self.counts = np.diff(self.first)
        self.hashes = self._hash(lower)

    def _hash(self, lower: bool) -> np.ndarray:
        exact, lowered, powers = _tables()
        values, out = lowered if lower else exact, np.empty(len(self.starts), "u8")
        a, n = 0, len(self.starts)
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + SEGMENT, "right")))
            low, sizes = self.starts[a:b], self.ends[a:b] - self.starts[a:b]
            begins = np.cumsum(sizes) - sizes
            at = np.repeat(low - begins, sizes) + np.arange(int(sizes.sum()))
            place = at - np.repeat(low, sizes)
            factor = powers[place & (_PERIOD - 1)]
            if int(sizes.max()) > _PERIOD:
                # The factors begin anew after each block, so the block's number goes into them.
                far = place >= _PERIOD
                factor[far] = mix(factor[far] + (place[far] >> _PERIOD_BITS).astype("u8") * _GRAM) | np.uint64(1)
            out[a:b] = np.add.reduceat(values[self.texts.data[at]] * factor, begins)
            a = b
        return mix(out + (self.ends - self.starts).astype("u8"))

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of `size` words inside one text."""
        m = len(self.hashes) - size + 1
        if m <= 0:
            return np.empty(0, "i8"), np.empty(0, "u8")
        last = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(m) + size <= last[:m])
        held = self.hashes[:m].copy()
        for j in range(1, size):
            held = held * _GRAM + self.hashes[j : m + j]
        return at, mix(held[at])

    def words(self, a: int, b: int) -> str:
        """Words a up to b, in lower case A-Z, joined by blanks."""
        data = self.texts.data
        parts = [data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b])]
        return b" ".join(parts).lower().decode("utf-8", "replace")


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: key occurs more than once; key occurred earlier in the array."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    before[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, before
