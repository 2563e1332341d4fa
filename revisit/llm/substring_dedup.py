"""Removal of word sequences that occur more than once in a corpus."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revisit.llm.key_counts import Keys, batches_of, bucket_bits, key_totals, sorted_keys, with_totals
from revisit.llm.words import WORD_BASES, Words, mix, rolling, words_of


def _windows(words: Words, length: int) -> np.ndarray:
    """First word of every window of ``length`` words inside one text."""
    n = len(words.starts)
    room = np.repeat(words.first[1:], words.counts()) - np.arange(n)
    return np.flatnonzero(room >= length)


def _window_keys(words: Words, length: int) -> tuple[np.ndarray, Keys, np.ndarray]:
    """Windows, their distinct keys and each window's place among them.

    A key is a Rabin-Karp hash of 64 bits and 16 bits of a second one with other bases.
    """
    begin = _windows(words, length)
    first, second = (
        mix(rolling(words.hashes(i), WORD_BASES[i], begin, begin + length)) for i in (0, 1)
    )
    keys, place = sorted_keys(first, (second >> np.uint64(48)).astype(np.uint16))
    keys.adds = np.minimum(keys.adds, 2)
    return begin, keys, place


def _cut(batch: pa.RecordBatch, totals: np.ndarray, length: int) -> pa.RecordBatch:
    words = words_of(batch.column(1))
    begin, _, place = _window_keys(words, length)
    again = begin[totals[place] > 1] if len(begin) else begin
    step = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + length, -1)
    gone = np.cumsum(step)[:-1] > 0
    doc = words.doc_of_word()
    removed = np.bincount(doc[gone], minlength=batch.num_rows)
    # Maximal intervals of removed words, within their text.
    edge = np.zeros(len(gone) + 1, bool)
    edge[words.first] = True
    opens = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
    closes = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    start = words.first[:-1]
    offset = np.searchsorted(opens, words.first).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array(opens - start[doc[opens]]), pa.array(closes - start[doc[opens]])], ["start", "end"]
    )
    kept = []
    for d, n in enumerate(removed.tolist()):
        i, j = int(words.first[d]), int(words.first[d + 1])
        body = words.data[words.starts[i] : words.ends[j - 1]].tobytes().split() if j > i else []
        kept.append(b" ".join(compress(body, (~gone[i:j]).tolist()) if n else body))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(words.counts().astype(np.int64)),
            pa.array(removed.astype(np.int64)),
            pa.ListArray.from_arrays(offset, spans),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ],
        ["key", "n_words", "n_removed", "spans", "kept"],
    )


def remove_repeats(
    docs: DataFrame, length: int = 35, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_words, n_removed, spans, kept): each text without its repeated word sequences.

    Every window of ``length`` words is hashed and counted over all texts; a word goes if a window
    over it starts anywhere else too, in the same text or another. ``spans`` are the maximal
    intervals of removed words (start, end), ``kept`` the other words joined by one space.

    One row per row of ``docs``. Null, empty and shorter texts lose nothing; repeated rows are
    repeats of each other; null keys are allowed; extra columns are not read. Two different windows
    are taken for equal with probability 2**-80 per pair.
    """
    batches = batches_of(docs, key, text)
    bits = bucket_bits(batches)
    totals = key_totals(
        batches, lambda b: [_window_keys(words_of(b.column(1)), length)[1]], bits, wide=True, most=2
    )

    def finish(batch: pa.RecordBatch, sections: list[np.ndarray]) -> pa.RecordBatch:
        return _cut(batch, sections[0] if sections else np.zeros(0, np.int64), length)

    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"key {kind}, n_words bigint, n_removed bigint,"
        " spans array<struct<start: bigint, end: bigint>>, kept string"
    )
    return with_totals(batches, totals, bits, finish, schema).withColumnRenamed("key", key)
