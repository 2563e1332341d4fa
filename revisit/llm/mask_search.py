"""Ranked lexical search: documents are grouped by the mask of an item's terms that they hold.

Documents are read in blocks. A block keeps a bitmap of documents per term; an item's bitmaps,
turned by documents, are the documents' masks. A mask's highest possible score is the sum of its
terms' highest scores in the block. Masks are evaluated by descending highest score until the next
one cannot reach the item's last place, so most documents are never scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.llm.words import BYTE_BASES, mix, powers
from revisit.plans.durable import durable

TOP = 50
ITEM_TERMS = 100_000  # (item, term) pairs that are asked for at once; they are sent to all tasks
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 8192
PIECE = 1 << 20

# Fixed values of the score: term frequencies and lengths weigh like this.
SCALE, FLOOR, SLOPE, LENGTH = 1_000_000_000, 50, 50, 20

# Bytes of terms: digits, letters and everything outside ASCII. Only A-Z are lower-cased.
_IN_TERM = np.ones(256, bool)
for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _IN_TERM[low : high + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms(text: str) -> Column:
    """The distinct terms of a text; null has none."""
    lower = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.split(F.coalesce(lower, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.array_distinct(F.array_remove(found, ""))


@dataclass
class Asked:
    """Some items, as numbers, and their terms, as numbers in the order of the terms' hashes."""

    first: np.ndarray  # hashes of the terms, ascending
    second: np.ndarray
    longest: int  # bytes of the longest term
    bounds: np.ndarray  # item i has terms of[bounds[i]:bounds[i + 1]], ascending
    of: np.ndarray
    weight: np.ndarray | None = None  # by term
    total_docs: int = 0
    total_terms: int = 0


@dataclass
class Block:
    """Some documents: their lengths, and the asked terms they hold, sorted by (term, document)."""

    lengths: np.ndarray
    term: np.ndarray
    doc: np.ndarray
    times: np.ndarray


# ----------------------------------------------------------------------- reading


def _spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all terms in texts that lie at ``bounds`` of ``data``, and their texts."""
    inside = _IN_TERM[data]
    begin, final = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    final[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    final[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(final) + 1, np.searchsorted(bounds, starts, side="right") - 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit Rabin-Karp hashes of every term in lower case."""
    values = _LOWER[data].astype(np.uint64) + np.uint64(1)
    made = []
    for base in BYTE_BASES:
        up, down = powers(base, len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * up[: len(data)], out=prefix[1:])
        made.append(mix((prefix[ends] - prefix[starts]) * down[starts]))
    return made[0], made[1]


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts in pieces of about ``PIECE`` bytes, cut between terms: (bytes, bounds, first text)."""
    text, at = 0, 0
    n = len(bounds) - 1
    while text < n:
        last = max(int(np.searchsorted(bounds, at + PIECE, side="right")) - 1, text)
        if last > text:  # whole texts
            yield data[at : bounds[last]], np.append(at, bounds[text + 1 : last + 1]) - at, text
            text, at = last, int(bounds[last])
            continue
        end, stop = int(bounds[text + 1]), at + PIECE  # the start or middle of a long text
        while stop < end:
            gaps = np.flatnonzero(~_IN_TERM[data[stop : min(stop + PIECE, end)]])
            if len(gaps):
                stop += int(gaps[0])
                break
            stop += PIECE
        stop = min(stop, end)
        yield data[at:stop], np.array([0, stop - at]), text
        at = stop
        if at == end:
            text += 1


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    size = int(bounds[-1] - bounds[0])
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8, size, int(bounds[0])) if size else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def read_block(texts: pa.Array, asked: Asked) -> Block:
    """Lengths and asked terms of some texts."""
    data, bounds = _bytes(texts)
    n, n_terms = len(bounds) - 1, max(len(asked.first), 1)
    lengths, keys, times = np.zeros(n, np.int64), [], []
    for part, inner, first in _pieces(data, bounds):
        starts, ends, text = _spans(part, inner)
        lengths[first : first + len(inner) - 1] += np.bincount(text, minlength=len(inner) - 1)
        short = ends - starts <= asked.longest
        starts, ends, text = starts[short], ends[short], text[short]
        if not len(starts) or not len(asked.first):
            continue
        one, two = _hashes(part, starts, ends)
        at = np.minimum(np.searchsorted(asked.first, one), len(asked.first) - 1)
        known = (asked.first[at] == one) & (asked.second[at] == two)
        key, count = np.unique((text[known] + first) * n_terms + at[known], return_counts=True)
        keys.append(key)
        times.append(count)
    if not keys:
        nothing = np.zeros(0, np.int64)
        return Block(lengths, nothing, nothing, nothing)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, place, np.concatenate(times))
    doc, term = key // n_terms, key % n_terms
    order = np.argsort(term, kind="stable")
    return Block(lengths, term[order], doc[order], count[order])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of bounded bytes of text and number; a longer text is a block of its own."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = int(total[at - 1]) if at else 0
            end = int(np.searchsorted(total, done + BLOCK_BYTES, side="right"))
            end = min(max(end, at + 1), at + BLOCK_DOCS, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


# ----------------------------------------------------------------------- scoring


@dataclass
class Best:
    """The best documents met so far of one item, highest score first."""

    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def reach(self, top: int) -> int:
        """The score that a document must have to change anything."""
        return int(self.score[top - 1]) if len(self.score) >= top else 1

    def add(self, score: np.ndarray, known: np.ndarray, doc: np.ndarray, top: int) -> None:
        score, known, doc = (np.concatenate(p) for p in ((self.score, score), (self.known, known), (self.doc, doc)))
        order = np.lexsort((doc, ~known, -score))[:top]
        order = order[score[order] > 0]
        self.score, self.known, self.doc = score[order], known[order], doc[order]


class Masks:
    """Presence bitmaps and scores of the asked terms in one block."""

    def __init__(self, block: Block, asked: Asked) -> None:
        self.n = len(block.lengths)
        mean = FLOOR + (SLOPE * block.lengths * asked.total_docs) // max(asked.total_terms, 1)
        gain = (SCALE * block.times) // (1000 * block.times + LENGTH * mean[block.doc])
        self.gain = asked.weight[block.term] * gain
        self.key = block.term * self.n + block.doc
        found, begin = np.unique(block.term, return_index=True)
        self.row = np.full(len(asked.first), -1)
        self.row[found] = np.arange(len(found))
        self.most = np.maximum.reduceat(self.gain, begin) if len(begin) else np.zeros(0, np.int64)
        # A bitmap of documents per term that occurs in the block.
        self.bits = np.zeros((len(found), (self.n + 7) // 8), np.uint8)
        bit = np.uint8(128) >> (block.doc & 7).astype(np.uint8)
        np.bitwise_or.at(self.bits, (self.row[block.term], block.doc >> 3), bit)

    def improve(self, best: Best, own: np.ndarray, known: np.ndarray, ids: np.ndarray, top: int) -> None:
        """Put the block's documents into an item's best ones; ``own`` are the item's terms."""
        rows = self.row[own]
        own, rows = own[rows >= 0], rows[rows >= 0]
        most = self.most[rows]
        if not len(rows) or most.sum() < best.reach(top):
            return
        held = np.unpackbits(self.bits[rows], axis=1, count=self.n)  # terms by documents
        some = np.flatnonzero(np.bitwise_or.reduce(self.bits[rows], axis=0))
        some = (some[:, None] * 8 + np.arange(8)).ravel()
        some = some[some < self.n]
        masks = np.ascontiguousarray(np.packbits(held[:, some], axis=0).T)
        whole = masks.view(np.dtype((np.void, masks.shape[1]))).ravel()
        _, first, group = np.unique(whole, return_index=True, return_inverse=True)
        highest = most @ held[:, some[first]].astype(np.int64)  # of every distinct mask
        order = np.argsort(-highest, kind="stable")
        by_mask = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[by_mask], np.arange(len(first) + 1))
        at, step = 0, 2 * top
        while at < len(order) and highest[order[at]] >= best.reach(top):
            # The next masks that may still matter, some documents at a time.
            size = np.cumsum(edge[order[at:] + 1] - edge[order[at:]])
            end = at + max(int(np.searchsorted(size, step, side="right")), 1)
            live = order[at:end]
            live = live[highest[live] >= best.reach(top)]
            docs = some[np.concatenate([by_mask[edge[m] : edge[m + 1]] for m in live])]
            i, d = np.nonzero(held[:, docs])
            gain = self.gain[np.searchsorted(self.key, own[i] * self.n + docs[d])]
            score = np.zeros(len(docs), np.int64)
            np.add.at(score, d, gain)
            best.add(score, known[docs], ids[docs], top)
            at, step = end, 2 * step


# --------------------------------------------------------------------------- jobs

_COUNTS = "term int, n long"
_FOUND = "item int, part int, doc long, score long"
_DOCS, _ALL = -1, -2  # numbers of documents and of all terms, among the counts


def _counted(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[pa.RecordBatch]:
    """How many documents hold each asked term, and all documents and terms, of one task."""
    holds, docs, total = np.zeros(len(asked.first), np.int64), 0, 0
    for batch in _blocks(batches):
        block = read_block(batch.column(1), asked)
        holds += np.bincount(block.term, minlength=len(holds))
        docs += int(np.count_nonzero(block.lengths))
        total += int(block.lengths.sum())
    some = np.flatnonzero(holds)
    yield pa.record_batch(
        [pa.array(np.append(some, [_DOCS, _ALL]), pa.int32()), pa.array(np.append(holds[some], [docs, total]), pa.int64())],
        names=["term", "n"],
    )


def _searched(batches: Iterator[pa.RecordBatch], asked: Asked, part: int, top: int) -> Iterator[pa.RecordBatch]:
    """The best documents of one task for every item."""
    best = [Best() for _ in range(len(asked.bounds) - 1)]
    for batch in _blocks(batches):
        ids = batch.column(0)
        known = np.asarray(ids.is_valid())
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        masks = Masks(read_block(batch.column(1), asked), asked)
        for i, own in enumerate(best):
            masks.improve(own, asked.of[asked.bounds[i] : asked.bounds[i + 1]], known, ids, top)
    for i, own in enumerate(best):
        if len(own.score):
            yield pa.record_batch(
                [pa.array(np.full(len(own.score), i), pa.int32()), pa.array(np.full(len(own.score), part), pa.int32()),
                 pa.array(own.doc, pa.int64(), mask=~own.known), pa.array(own.score)],
                names=["item", "part", "doc", "score"],
            )


def _asked(rows: list) -> tuple[Asked, list]:
    """Items and terms of (item, term) rows as numbers, and the items' keys."""
    items = sorted({r["item"] for r in rows}, key=lambda k: (k is not None, k))
    number = {k: i for i, k in enumerate(items)}
    words = sorted({r["term"] for r in rows})
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(b) for b in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    one, two = _hashes(data, np.append(0, ends[:-1]), ends)
    order = np.argsort(one)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    at = {w: int(p) for w, p in zip(words, place)}
    of = [[] for _ in items]
    for r in rows:
        of[number[r["item"]]].append(at[r["term"]])
    bounds = np.cumsum([0, *map(len, of)])
    flat = np.array([t for own in of for t in sorted(own)], np.int64)
    return Asked(one[order], two[order], max(map(len, raw)), bounds, flat), items


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", top: int = TOP, item_terms: int = ITEM_TERMS,
) -> DataFrame:
    """(item key, rank, key, score): the ``top`` documents with the highest scores for each item.

    Terms are runs of digits, letters and characters outside ASCII, with A-Z in lower case. A term
    held by df of N documents weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms
    scores weight * (10^9 tf div (1000 tf + 20 m)) per term of the item, with m = 50 + 50 n N div L
    and L terms in all documents, in whole numbers. Equal scores go by ascending key, null keys last.

    Items are asked for in groups of about ``item_terms`` terms, which are what tasks are sent; the
    documents are read twice per group, once for the counts. A task keeps ``top`` documents per item.

    The key of ``docs`` is a whole number. Rows of equal item keys, null ones too, are one item with
    the terms of all; every row of ``docs`` is a document, repeated or not. Null and empty texts
    hold nothing; items without terms, or whose terms are nowhere, have no rows; nor has anything
    with empty tables. Other columns are not read.
    """
    spark = docs.sparkSession
    if top < 1:
        raise ValueError("top must be at least 1")
    wanted = items.select(F.col(item_key).alias("item"), F.explode(terms(item_text)).alias("term")).distinct()
    wanted = durable(wanted, "item-terms")
    groups = -(-wanted.count() // item_terms)
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    kind = items.schema[item_key].dataType
    made = None
    for group in range(groups):
        # One item's terms stay together, so a group may be somewhat larger.
        mine = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).collect()
        if not mine:
            continue
        asked, keys = _asked(mine)
        found = _search_group(texts, asked, top)
        names = spark.createDataFrame(list(enumerate(keys)), f"item int, `{item_key}` {kind.simpleString()}")
        found = found.join(F.broadcast(names), "item").select(  # as many rows as the group has items
            item_key, "rank", F.col("doc").alias(key), "score"
        )
        made = found if made is None else made.unionByName(found)
    if made is None:
        columns = f"`{item_key}` {kind.simpleString()}, rank int, `{key}` long, score long"
        return spark.createDataFrame([], columns)
    return made


def _search_group(texts: DataFrame, asked: Asked, top: int) -> DataFrame:
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(asked)
    counts = texts.mapInArrow(lambda batches: _counted(batches, sent.value), _COUNTS)
    counts = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    asked.total_docs, asked.total_terms = counts.pop(_DOCS, 0), counts.pop(_ALL, 0)
    weight = [
        math.floor(1000 * math.log((2 * asked.total_docs + 2) / (2 * counts.get(t, 0) + 1)))
        for t in range(len(asked.first))
    ]
    asked.weight = np.array(weight, np.int64)
    sent = spark.sparkContext.broadcast(asked)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _searched(batches, sent.value, TaskContext.get().partitionId(), top)

    found = durable(texts.mapInArrow(searched, _FOUND), "found-documents")
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    # A task has at most ``top`` rows of an item: 256 tasks together, then the best of all these.
    some = Window.partitionBy("item", F.floor(F.col("part") / 256)).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(
        F.col("rank") <= top
    )
