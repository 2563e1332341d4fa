"""Words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

# White space of the word pattern [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

# Odd multipliers of the two Rabin-Karp hashes over bytes and of the two over words.
BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        have = pair[0], pair[1]
        if size <= 1 << 23:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rolling(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for every pair, modulo 2**64."""
    up, down = powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


@dataclass
class Words:
    """The words of some texts. ``first[d]`` is the first word of text d, ``first[-1]`` their number."""

    data: np.ndarray  # bytes of all texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, which: int = 0) -> np.ndarray:
        values = self.data.astype(np.uint64) + np.uint64(1)
        return mix(rolling(values, BYTE_BASES[which], self.starts, self.ends))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every text; null has none."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    base = int(bounds[0])
    raw = texts.buffers()[2]
    size = int(bounds[-1]) - base
    data = np.frombuffer(raw, np.uint8, size, base) if size else np.zeros(0, np.uint8)
    bounds = bounds - base
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    final = inside.copy()
    final[:-1] &= ~inside[1:]
    edges = bounds[:-1]
    edges = edges[edges < size]
    begin[edges] = inside[edges]
    last = bounds[1:] - 1
    last = last[last >= 0]
    final[last] = inside[last]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(final) + 1, np.searchsorted(starts, bounds))


def give_back() -> None:
    """Return what this process has freed to the system, as workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)  # the C library keeps tens of megabytes of freed arrays


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``size`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(
            pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), np.int64
        )
        at, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)
    give_back()
