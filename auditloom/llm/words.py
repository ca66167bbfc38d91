"""Words of texts as numpy arrays over UTF-8 bytes, for use inside Arrow tasks.

Both word rules used here end words at ASCII bytes only, so UTF-8 bytes can be cut and
hashed without decoding. Hashes are 64-bit: a polynomial over the bytes of a word (or
over the hashes of consecutive words), taken from running sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=np.int8)
SPACED[[9, 10, 11, 12, 13, 32]] = 0

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and everything beyond ASCII.
LETTERED = np.zeros(256, dtype=np.int8)
LETTERED[48:58] = LETTERED[97:123] = LETTERED[128:] = 1

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, _U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))


_BYTES, _WORDS = _Powers(_BASE), _Powers(0xD1342543DE82EF95)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def slices(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive rows of about ``size`` bytes together (a longer text alone); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = texts.cast(pa.binary()) if texts.type in (pa.string(), pa.binary()) else texts.cast(pa.large_binary())
    lengths = np.asarray(pc.fill_null(pc.binary_length(raw), 0)).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < len(raw):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, [t or b"" for t in raw.slice(at, to - at).to_pylist()]
        at = to
    pa.default_memory_pool().release_unused()  # a worker lives on after its task


class Words:
    """The words of some texts: byte starts and ends in ``data``, hashes, first word of each text."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, fold: bool):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.data = LOWER[data] if fold else data
        inside = is_word[self.data]
        step = np.diff(inside, prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(lengths)))
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.bounds)
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), _U)
        at = 0
        while at < len(out):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + BLOCK, side="right")))
            n = int(self.ends[to - 1] - low)
            _BYTES.reach(n + 1)
            sums = np.zeros(n + 1, _U)
            values = self.data[low : low + n].astype(_U)
            values += _U(1)
            values *= _BYTES.up[:n]
            np.cumsum(values, out=sums[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mixed((sums[e] - sums[s]) * _BYTES.down[s] + (e - s).astype(_U) * _U(_BASE))
            at = to
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def phrase(self, i: int, n: int) -> bytes:
        """``n`` words from word ``i`` on, one space between."""
        return b" ".join(self.word(k) for k in range(i, i + n))

    def text_of_words(self) -> np.ndarray:
        """The number of the text each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of ``n`` consecutive entries, for every start (texts' ends are not minded)."""
    size = len(hashes)
    if size < n:
        return np.empty(0, _U)
    _WORDS.reach(size + 1)
    sums = np.zeros(size + 1, _U)
    np.cumsum(hashes * _WORDS.up[:size], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * _WORDS.down[: size - n + 1] + _U(n))


def window_starts(words: Words, n: int) -> np.ndarray:
    """The first words of the windows of ``n`` words that stay within one text."""
    texts = words.text_of_words()
    return np.flatnonzero(texts[: len(texts) - n + 1] == texts[n - 1 :]) if len(texts) >= n else np.empty(0, np.int64)


class HashSet:
    """Membership of 64-bit hashes: a bitmap first, then a search in the sorted values."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.shift = _U(64 - max(10, min(24, int(np.ceil(np.log2(len(self.values) + 1))) + 5)))
        self.bits = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.bits[self.values >> self.shift] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The positions in ``hashes`` of members."""
        at = np.flatnonzero(self.bits[hashes >> self.shift])
        if not len(at) or not len(self.values):
            return at[:0]
        found = hashes[at]
        place = np.minimum(np.searchsorted(self.values, found), len(self.values) - 1)
        return at[self.values[place] == found]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key from a partition sorted by it, however they are cut into batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(s, e - s)
            if held and held[-1].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
