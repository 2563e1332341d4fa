"""Counts of 64-bit keys over a whole corpus, dealt back to the texts that the keys came from.

Documents are written once as batches of a few megabytes. Each batch sums its own keys, so a key
that fills a third of the corpus is one entry per batch; the sums travel as packed blocks to the
key's bucket, are added up there, and the totals travel back to the batch as blocks in key order.
A lost executor costs the tasks it ran: the batches are a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.llm.words import text_slices
from revisit.plans.durable import durable

BATCH_BYTES = 4 << 20
TOTALS = -1  # the batch number of a bucket's own totals
_BLOCK = "bucket int, batch bigint, body binary"


@dataclass
class Keys:
    """Distinct keys of one batch in ascending order, with what each adds to its total.

    ``low`` holds further key bits where 64 are too few for the number of keys.
    """

    high: np.ndarray
    adds: np.ndarray
    low: np.ndarray | None = None


def sorted_keys(
    high: np.ndarray, low: np.ndarray | None = None, adds: np.ndarray | None = None
) -> tuple[Keys, np.ndarray]:
    """Distinct keys with their sums (of ``adds``, else of ones), and each row's place among them."""
    order = np.argsort(high, kind="stable")
    h = high[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if low is not None:
        l = low[order]
        if np.any(~new[1:] & (l[1:] != l[:-1])):
            order = np.lexsort((low, high))
            h, l = high[order], low[order]
        new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
        low = l[new]
    begin = np.flatnonzero(new)
    if adds is None:
        sums = np.diff(np.append(begin, len(h)))
    else:
        sums = np.add.reduceat(adds[order], begin) if len(begin) else np.zeros(0, np.int64)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return Keys(h[new], sums.astype(np.int64), low), place


def _pack(values: np.ndarray) -> bytes:
    """Sums as the narrowest of three widths, after a byte that tells which."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpack(body: bytes) -> np.ndarray:
    return np.frombuffer(body, f"<u{body[0]}", offset=1).astype(np.int64)


def batches_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(batch, body): rows (key, text) of about BATCH_BYTES of text, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for n, piece in enumerate(text_slices(batches, size=BATCH_BYTES)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=options) as writer:
                writer.write_batch(piece)
            body = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([first + n]), body], ["batch", "body"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return durable(rows.mapInArrow(run, "batch bigint, body binary"), "batches")


def _read(body: pa.Buffer) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as reader:
        return pa.Table.from_batches(list(reader)).combine_chunks().to_batches()[0]


def _blocks(batch: int, sections: list[Keys], bits: int) -> pa.RecordBatch:
    buckets, bodies = [], []
    for s, keys in enumerate(sections):
        of = (keys.high >> np.uint64(64 - bits)).astype(np.int64)
        present, begin = np.unique(of, return_index=True)
        ends = np.append(begin[1:], len(of))
        # The bucket has the key's upper bits, so its top byte need not travel.
        high = keys.high.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
        for bucket, i, j in zip(present.tolist(), begin.tolist(), ends.tolist()):
            low = b"" if keys.low is None else keys.low[i:j].astype("<u2").tobytes()
            buckets.append((s << bits) + bucket)
            bodies.append(
                (j - i).to_bytes(4, "little") + high[i:j].tobytes() + low + _pack(keys.adds[i:j])
            )
    arrays = [
        pa.array(buckets, pa.int32()),
        pa.array(np.full(len(buckets), batch)),
        pa.array(bodies, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "batch", "body"])


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list]]:
    """Rows of equal ``by`` of a sorted partition, one after the other, as (value, rows)."""
    now, held = None, []
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(batch.column(i) if n == "body" else batch.column(i).to_pylist() for i, n in enumerate(names))):
            row = dict(zip(names, row))
            if row[by] != now:
                if held:
                    yield now, held
                now, held = row[by], []
            held.append(row)
    if held:
        yield now, held


def _totals(wide: bool, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, "bucket"):
            high, low, adds, sizes = [], [], [], []
            for row in rows:
                body = row["body"].as_py()
                n = int.from_bytes(body[:4], "little")
                padded = np.zeros((n, 8), np.uint8)
                padded[:, :7] = np.frombuffer(body, np.uint8, 7 * n, 4).reshape(-1, 7)
                high.append(padded.view("<u8").reshape(-1))
                at = 4 + 7 * n
                if wide:
                    low.append(np.frombuffer(body, "<u2", n, at))
                    at += 2 * n
                adds.append(_unpack(body[at:]))
                sizes.append(n)
            keys, place = sorted_keys(
                np.concatenate(high), np.concatenate(low) if wide else None, np.concatenate(adds)
            )
            answer = keys.adds if most is None else np.minimum(keys.adds, most)
            answer = np.split(answer[place], np.cumsum(sizes)[:-1])
            found = np.array([keys.adds.sum(), np.count_nonzero(keys.adds)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows) + 1, bucket, np.int32)),
                    pa.array([*(r["batch"] for r in rows), TOTALS], pa.int64()),
                    pa.array([*map(_pack, answer), _pack(found)], pa.binary()),
                ],
                ["bucket", "batch", "body"],
            )

    return run


def bucket_bits(batches: DataFrame) -> int:
    """Buckets grow with the corpus, so that one bucket's keys stay some tens of megabytes."""
    return max(10, (batches.count() // 4).bit_length())


def key_totals(
    batches: DataFrame,
    keys_of: Callable[[pa.RecordBatch], list[Keys]],
    bits: int,
    wide: bool = False,
    most: int | None = None,
) -> DataFrame:
    """(bucket, batch, body): for each batch the totals of its keys, as blocks in key order.

    ``keys_of`` gives a batch's sections of distinct keys; section s has the buckets from
    s << bits. ``most`` bounds what an answer says (2 where only "more than once" matters). Rows
    with batch TOTALS have each bucket's sum and number of keys with a total above zero.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _blocks(number, keys_of(_read(body.as_buffer())), bits)

    return (
        batches.mapInArrow(run, _BLOCK)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_totals(wide, most), _BLOCK)
    )


def with_totals(
    batches: DataFrame,
    totals: DataFrame,
    bits: int,
    finish: Callable[[pa.RecordBatch, list[np.ndarray]], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """``finish`` applied to each batch's rows and the totals of its keys, a section at a time."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _runs(rows, "batch"):
            answers: dict[int, list[np.ndarray]] = {}
            for part in parts[1:]:
                answers.setdefault(part["bucket"] >> bits, []).append(_unpack(part["body"].as_py()))
            last = max(answers, default=-1)
            none = [np.zeros(0, np.int64)]
            sections = [np.concatenate(answers.get(s, none)) for s in range(last + 1)]
            yield finish(_read(parts[0]["body"].as_buffer()), sections)

    texts = batches.select(F.lit(-1).alias("bucket"), "batch", "body")
    asked = totals.where(F.col("batch") != TOTALS)
    return (
        texts.union(asked)
        .repartition("batch")
        .sortWithinPartitions("batch", "bucket")
        .mapInArrow(run, schema)
    )


def section_sums(totals: DataFrame, bits: int, section: int) -> tuple[int, int]:
    """Sum over all keys of a section, and the number of its keys with a total above zero."""
    own = totals.where((F.col("batch") == TOTALS) & (F.shiftright("bucket", bits) == section))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2, np.int64)
        for batch in rows:
            for body in batch.column(0):
                found += _unpack(body.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(found[:1]), pa.array(found[1:])], ["sum", "keys"])

    made = own.select("body").mapInArrow(run, "sum bigint, keys bigint")
    row = made.agg(F.sum("sum").alias("sum"), F.sum("keys").alias("keys")).first()
    return row["sum"] or 0, row["keys"] or 0
