"""Sampled SentencePiece segmentations by forward filtering and backward sampling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from revisit.llm.words import BYTE_BASES, mix, rolling, text_slices

SPACE = "▁"  # how pieces spell a space
_DECODED = 1 << 20  # about so many ids are decoded at a time
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STRETCH = 512  # places of the trie that are tried at a time


class Pieces:
    """A piece vocabulary as tables of bytes: surfaces of ids, and a trie of all surfaces.

    The public vocabulary ranks its pieces instead of giving probabilities, so a piece's weight is
    Zipf's law of its rank: -log(rank + 3). Byte tokens and pieces without a rank (runs of spaces)
    get the least.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        self.weight = np.full(size, -log(size + 3.0))
        surface = [b""] * size
        known: dict[bytes, int] = {}  # every beginning of a piece; its id, or -1
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_id[value], surface[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.weight[i] = -log(min(-model.get_score(i), size) + 3.0)
                surface[i] = piece.replace(SPACE, " ").encode()
                for n in range(1, len(surface[i])):
                    known.setdefault(surface[i][:n], -1)
                known[surface[i]] = i
        self.ends = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.longest = max(map(len, known))
        self._lay_out(known)

    def _lay_out(self, known: dict[bytes, int]) -> None:
        """The trie of ``known`` as a double array: place 0 is the root, and the child of place ``s``
        by byte ``b`` is place ``base[s] + b``, if its ``parent`` is ``s``."""
        children: dict[bytes, list[int]] = {}
        for part in known:
            children.setdefault(part[:-1], []).append(part[-1])
        taken = np.zeros(256 * (len(children) + 3) + _STRETCH, bool)
        shift: dict[bytes, int] = {}
        size, at = 0, 256
        for part, after in sorted(children.items(), key=lambda x: -len(x[1])):
            if len(after) != size:
                size, at = len(after), 256
            low = min(after)
            while True:  # first fit in stretches, on from that of the last node of as many children
                fits = ~taken[at : at + _STRETCH]
                for b in after:
                    if b != low:
                        fits &= ~taken[at + b - low : at + b - low + _STRETCH]
                if fits.any():
                    break
                at += _STRETCH
            at += int(np.argmax(fits))
            shift[part] = at - low
            taken[[at + b - low for b in after]] = True
        place = {part: shift[part[:-1]] + part[-1] for part in known} | {b"": 0}
        size = int(np.flatnonzero(taken)[-1]) + 257
        self.base, self.id = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.parent = np.full(size, -1, np.int32)
        for part, i in known.items():
            self.parent[place[part]], self.id[place[part]] = place[part[:-1]], i
        for part, at in shift.items():
            self.base[place[part]] = at


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattices:
    """Lattices of text units, forward-filtered side by side.

    A node is a place between two bytes of a unit. Its arcs are the pieces that end there, each with
    the probability that a sampled segmentation reaching the node came that way. A character
    without a piece of its own is spelled in byte tokens, over nodes inside of it.
    """

    def __init__(self, pieces: Pieces, power: float, data: np.ndarray, size: np.ndarray):
        """``data``: the bytes of all units one after the other; ``size``: how many of each."""
        # Nodes are numbered by their distance from the start of their unit, of equal distance by unit,
        # longest first; level[d] is the first node of distance d. So what has an arc to a node lies before it.
        rank = np.empty(len(size), np.int32)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
        level = np.concatenate([[0], np.cumsum(np.cumsum(np.bincount(size)[::-1])[::-1])])
        self.last = level[size] + rank
        low = np.int32 if level[-1] < 1 << 31 else np.int64
        level, row = level.astype(low), np.repeat(rank, size)
        ends = np.cumsum(size)
        away = np.arange(len(data), dtype=low) - np.repeat((ends - size).astype(low), size)
        # No two pieces of a length end at one node, so arcs find their places without a sort.
        count = np.zeros(level[-1], np.int32)
        found = []
        for begin, n, token in self._pieces_in(pieces, data, np.repeat(ends.astype(low), size)):
            came, went = level[away[begin]] + row[begin], level[away[begin] + n] + row[begin]
            found.append((came, went, count[went], token))
            count[went] += 1
        before = np.cumsum(count) - count
        self.came, self.token = (np.empty(int(count.sum()), kind) for kind in (low, np.int32))
        while found:
            came, went, earlier, token = found.pop()
            place = before[went] + earlier
            self.came[place], self.token[place] = came, token
        # Forward filtering: all nodes of a distance at once.
        self.has_arc = count > 0
        node = np.flatnonzero(self.has_arc)
        group, count = before[node], count[node]
        total = np.zeros(len(before))
        share = np.empty(len(self.came))
        bounds = np.searchsorted(node, level).tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a < b:
                arcs, at, n = slice(group[a], group[b - 1] + count[b - 1]), group[a:b] - group[a], count[a:b]
                score = total[self.came[arcs]] + power * pieces.weight[self.token[arcs]]
                top = np.maximum.reduceat(score, at)
                score -= np.repeat(top, n)
                np.exp(score, out=score)
                whole = np.add.reduceat(score, at)
                total[node[a:b]] = top + np.log(whole)
                np.divide(score, np.repeat(whole, n), out=share[arcs])
        self.upto = np.cumsum(share)
        self.upto -= np.repeat((self.upto - share)[group], count)
        np.minimum(self.upto, 1.0, out=self.upto)
        self.upto[group + count - 1] = 1.0
        self.upto += np.repeat(node, count)

    @staticmethod
    def _pieces_in(pieces: Pieces, data, end) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(begins, length, ids) of all pieces in the units, and of the bytes of characters without one.

        ``end`` is where the unit of each byte ends.
        """
        lead = (data & 0xC0) != 0x80
        lead[0] = True
        lead[1:] |= end[1:] != end[:-1]
        start = np.flatnonzero(lead).astype(end.dtype)
        width = np.diff(np.append(start, len(data)))
        room = end[start] - start
        spelled = np.zeros(len(start), bool)
        alive = np.arange(len(start))
        state = np.zeros(len(start), np.int32)
        for n in range(1, pieces.longest + 1):
            fits = room[alive] >= n
            alive, state = alive[fits], state[fits]
            if not len(alive):
                break
            after = pieces.base[state] + data[start[alive] + (n - 1)]
            same = pieces.parent[after] == state
            alive, state = alive[same], after[same]
            token = pieces.id[state]
            whole = token >= 0
            spelled[alive[whole & (width[alive] == n)]] = True
            yield start[alive[whole]], n, token[whole]
        rest = np.flatnonzero(~np.repeat(spelled, width)).astype(end.dtype)
        yield rest, 1, pieces.byte_id[data[rest]]

    def sample(self, lattice: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation per unit, walked from its end: all ids, and the number of each unit.

        ``lattice`` is the lattice of each unit, ``seed`` decides its draws.
        """
        units, steps, ids = [], [], []
        at, step = self.last[lattice], 0
        unit = np.argsort(at, kind="stable")  # in the order in which memory has the arcs
        at = at[unit]
        while len(unit):
            draw = mix(seed[unit] + mix(np.full(len(unit), step + 1, np.uint64) * _STEP))
            u = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = np.searchsorted(self.upto, at + u * (1 - 1e-9), side="right")
            units.append(unit)
            steps.append(np.full(len(unit), step))
            ids.append(self.token[arc])
            at = self.came[arc]
            going = self.has_arc[at]
            at, unit, step = at[going], unit[going], step + 1
        if not units:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        unit = np.concatenate(units)
        count = np.bincount(unit, minlength=len(lattice))
        ends = np.cumsum(count)
        made = np.empty(len(unit), np.int32)
        made[ends[unit] - 1 - np.concatenate(steps)] = np.concatenate(ids)
        return made, count


def encode(
    texts: list[bytes], seeds: np.ndarray, path: str, power: float
) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts one after the other, and the number of each text.

    A space is put before every text that is not empty, as the vocabulary asks for. No piece has a
    space after another character or has a control character, so the lattice of a text falls apart
    into units before spaces and around control characters: sampling them one by one is sampling
    the whole. Equal units share a lattice.
    """
    data = np.frombuffer(b"".join(b" " + t if t else b"" for t in texts), np.uint8)
    size = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    first = np.cumsum(size) - size
    space, control = data == 0x20, data < 0x20
    start = np.zeros(len(data) + 1, bool)
    start[first] = True
    start[:-1][1:] |= space[1:] & ~space[:-1]
    start[:-1] |= control
    start[1:] |= control
    begin = np.flatnonzero(start[:-1])
    length = np.diff(np.append(begin, len(data)))
    doc = np.searchsorted(first, begin, side="right") - 1
    number = np.arange(len(begin)) - np.searchsorted(begin, first[doc])
    hashes = mix(rolling(data.astype(np.uint64) + np.uint64(1), BYTE_BASES[0], begin, begin + length))
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    own = length[index]
    where = np.arange(int(own.sum())) + np.repeat(begin[index] - (np.cumsum(own) - own), own)
    store = Lattices(_pieces(path), power, data[where], own)
    seed = mix(seeds[doc] + mix(number.astype(np.uint64) + np.uint64(1)))
    ids, count = store.sample(inverse, seed)
    return ids, np.bincount(doc, count, len(texts)).astype(np.int64)


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> list[bytes]:
    """The texts that ids stand for, without the space put before each."""
    pieces = _pieces(path)
    size = pieces.ends[ids + 1] - pieces.ends[ids]
    ends = np.cumsum(size)
    where = np.arange(int(ends[-1]) if len(ends) else 0)
    raw = pieces.bytes[where + np.repeat(pieces.ends[ids] - (ends - size), size)].tobytes()
    upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [raw[a + (b > a) : b] for a, b in zip(upto[:-1], upto[1:])]


def row_seeds(keys: list[object], seed: int) -> np.ndarray:
    text = (b"" if k is None else str(k).encode() for k in keys)
    return np.array([xxhash.xxh64_intdigest(t, seed) for t in text], np.uint64)


def encode_sampled(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, power: float = 1.0,
    path: str | None = None, carry: tuple[str, ...] = (), check: bool = False,
) -> DataFrame:
    """(key, carried columns, ids, n_tokens): one sampled segmentation per row of ``docs``.

    With ``check`` the ids are decoded at once, and ``lossless`` tells whether that gives the text.

    A segmentation is drawn from the lattice of all pieces in proportion to the product of its
    pieces' weights to the ``power``; the draws depend on the row's key and ``seed`` alone, not on
    partitions, so equal rows get equal ids. Null and empty texts have no ids; a null key draws as
    an empty one; characters without a piece become byte tokens, so decoding is lossless.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    names = list(dict.fromkeys([key, *carry]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text to encode", 1 << 19):
            raw = part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()
            seeds = row_seeds(part.column(0).to_pylist(), seed)
            raw = [t or b"" for t in raw]
            ids, counts = encode(raw, seeds, path, power)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            made = [*part.columns[:-1], pa.ListArray.from_arrays(offsets, ids), pa.array(counts)]
            if check:
                made.append(pa.array([a == b for a, b in zip(decode_ids(ids, counts, path), raw)]))
            yield pa.RecordBatch.from_arrays(made, columns)

    columns = [*names, "ids", "n_tokens", *["lossless"] * check]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    rows = docs.select(*names, F.col(text).cast("string").alias("text to encode"))
    more = ["ids array<int>", "n_tokens bigint", *["lossless boolean"] * check]
    return rows.mapInArrow(run, ", ".join([*kinds, *more]))


def decoded(
    tokens: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None
) -> DataFrame:
    """``tokens`` and their text; null ids are an empty text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index(ids)
            size = pa.compute.list_value_length(batch.column(where)).fill_null(0)
            piece = np.cumsum(size.to_numpy(zero_copy_only=False)) // _DECODED
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(at, end - at)
                counts = size.slice(at, end - at).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = part.column(where).flatten().to_numpy(zero_copy_only=False)
                texts = pa.array(decode_ids(flat, counts, path), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], schema.names)

    schema = StructType([*tokens.schema.fields, StructField(into, StringType())])
    return tokens.mapInArrow(run, schema)
