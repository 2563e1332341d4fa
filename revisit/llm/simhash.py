"""SimHash near-duplicates through an inverted index over byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisit.llm.bounded import small
from revisit.llm.components import components
from revisit.llm.words import text_slices, words_of
from revisit.plans.durable import durable

SEED = 42
_SHINGLE_BATCH = 1 << 17


def fingerprint(texts: pa.Array, width: int = 3) -> np.ndarray:
    """64-bit SimHash of every text over its shingles of ``width`` lower-cased words.

    A bit is set if it is set in over half of the shingles' XXH64 hashes. A text with fewer words
    is one shingle; null or a text without words has fingerprint zero.
    """
    words = words_of(texts, lower=True)
    counts = words.counts()
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    for d in np.flatnonzero(counts).tolist():
        i, j = int(words.first[d]), int(words.first[d + 1])
        body = words.data[words.starts[i] : words.ends[j - 1]].tobytes().split()
        joined = b" ".join(body)
        ends = np.cumsum(np.fromiter(map(len, body), np.int64, len(body)) + 1) - 1
        if len(body) <= width:
            hashes.append(digest(joined, SEED))
            continue
        first = [0, *(ends[:-width] + 1).tolist()]
        hashes += [digest(joined[s:e], SEED) for s, e in zip(first, ends[width - 1 :].tolist())]
    h = np.array(hashes, np.uint64)
    set_in = np.zeros((len(counts), 64), np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    doc_of = np.repeat(np.arange(len(counts)), sizes)
    for at in range(0, len(h), _SHINGLE_BATCH):
        part = h[at : at + _SHINGLE_BATCH]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        docs, begin = np.unique(doc_of[at : at + len(part)], return_index=True)
        set_in[docs] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    ones = set_in * 2 > np.diff(bounds)[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3
) -> DataFrame:
    """(key, fp bigint): the fingerprint's bits as a signed number. One row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, size=1 << 19):
            fp = pa.array(fingerprint(part.column(1), width).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), fp], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def _same_bytes(x: np.ndarray) -> np.ndarray:
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


class _Forest:
    """Union of row numbers, a whole array of pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: np.ndarray) -> np.ndarray:
        up = self.parent[i]
        while True:
            higher = self.parent[up]
            if np.array_equal(higher, up):
                return up
            up = higher

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root(i), self.root(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _patterns(bits: int, most: int) -> np.ndarray:
    sets = (c for k in range(1, most + 1) for c in combinations(range(bits), k))
    return np.array([sum(1 << i for i in c) for c in sets], np.uint64)


def _link_group(values: np.ndarray, bits: int, shared: int, forest: _Forest, at: int) -> None:
    """Link all rows of one posting list that are within ``bits`` of each other.

    Up to 2,048 rows every pair is compared. A longer list holds sorted distinct values that
    agree on ``shared`` bytes, so the rest is few bits: every row looks its neighbours up.
    """
    n = len(values)
    if n <= 2048:
        for d in range(1, n):
            x = values[d:] ^ values[:-d]
            close = np.flatnonzero(np.bitwise_count(x) <= bits)
            close = close[_same_bytes(x[close]) >= shared]
            forest.join(at + close, at + close + d)
        return
    varied = np.flatnonzero(
        np.unpackbits(np.bitwise_or.reduce(values ^ values[0]).reshape(1).view(np.uint8), bitorder="little")
    )
    for pattern in _patterns(len(varied), bits):
        spread = np.uint64(sum(1 << int(p) for k, p in enumerate(varied) if int(pattern) >> k & 1))
        wanted = values ^ spread
        place = np.minimum(np.searchsorted(values, wanted), n - 1)
        found = np.flatnonzero((values[place] == wanted) & (values < wanted))
        forest.join(at + found, at + place[found])


def _links(batches: Iterator[pa.RecordBatch], bits: int, shared: int) -> Iterator[pa.RecordBatch]:
    """Rows (list, fp) sorted by list, then fp: links that connect what is close in a list."""
    keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in _and_end(batches):
        if batch is None:
            full = len(keys)
        elif batch.num_rows:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy().view(np.uint64)])
            full = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
        else:
            continue
        k, v = keys[:full], values[:full]
        keys, values = keys[full:], values[full:]
        a, b = _linked(k, v, bits, shared)
        if len(a):
            arrays = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _linked(k: np.ndarray, v: np.ndarray, bits: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([begin, [len(k)]]))
    forest = _Forest(len(k))
    small = np.repeat((size > 1) & (size <= 64), size)
    group = np.repeat(np.arange(len(size)), size)
    for d in range(1, int(size[(size > 1) & (size <= 64)].max(initial=1))):
        i = np.flatnonzero(small[d:] & (group[d:] == group[:-d]))
        x = v[i] ^ v[i + d]
        close = np.bitwise_count(x) <= bits
        i, x = i[close], x[close]
        i = i[_same_bytes(x) >= shared]
        forest.join(i, i + d)
    for g in np.flatnonzero(size > 64).tolist():
        s = int(begin[g])
        _link_group(v[s : s + int(size[g])], bits, shared, forest, s)
    root = forest.root(np.arange(len(k)))
    moved = np.flatnonzero(root != np.arange(len(k)))
    return v[moved], v[root[moved]]


def close_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all pairs within ``bits`` bits.

    Two fingerprints that differ in at most ``bits`` bits share at least 8 - bits positional
    bytes. So every fingerprint is posted once under each set of that many byte positions and the
    bytes there; whoever meets in a list is tallied and verified. A posting of fewer bytes would
    hold a growing share of all fingerprints; this one holds 2**(8 * bits) values at most, however
    many documents there are. A list passes on a spanning forest of its links, not all pairs.
    """
    shared = 8 - bits
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(8), shared)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.array(*[F.lit(m).cast("bigint") for m in signed])
    posted = prints.select("fp", F.explode(table).alias("mask")).select(
        F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("list"), "fp"
    )
    run = lambda batches: _links(batches, bits, shared)
    return (
        posted.repartition("list")
        .sortWithinPartitions("list", F.expr("fp < 0"), "fp")
        .mapInArrow(run, "a bigint, b bigint")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 3, width: int = 3
) -> DataFrame:
    """(key, fp, component): documents linked through fingerprints within ``bits`` bits.

    ``component`` is the smallest key reachable, the row's own included. Copies share a
    fingerprint and are never paired. Texts without words (null ones too) have fingerprint zero
    and link like any other. Rows with a null key take part; where a component has no other
    key it is null. Extra columns are not read.
    """
    prints = durable(fingerprints(docs, key, text, width), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(close_links(distinct, bits)).withColumnsRenamed({"node": "fp"})
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(named, "root").select("fp", "component")
    return prints.join(named, "fp").select(key, "fp", "component")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest key of each component, with all columns of ``docs``.

    Of several rows with that key one stays. A row without a key cannot be named and stays.
    """
    found = durable(near_duplicates(docs.select(key, text), key, text).where(F.col(key).isNotNull()), "components")
    gone = durable(found.where(F.col(key) != F.col("component")).select(F.col(key).alias("gone key")).distinct(), "gone")
    kept = docs.join(small(gone), docs[key] == gone["gone key"], "left_anti")
    twice = found.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("twice"))
    twice = durable(twice, "repeated-keys")
    if twice.isEmpty():
        return kept
    repeated = kept.join(twice, kept[key] == twice["twice"], "left_semi").dropDuplicates([key])
    return kept.join(twice, kept[key] == twice["twice"], "left_anti").union(repeated)


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
