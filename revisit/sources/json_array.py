"""One large JSON array of objects, read by as many tasks as its size asks for.

A reader of whole JSON documents needs a file in one piece. Here files are cut at every closing
brace, which Spark's text reader does in any byte range. What the text is at the start of a byte range
(inside a string or not, how deep) follows from everything before it in the file. So a first pass sums
up what each range changes, in a row a range; the rows are added along the file; a second pass then cuts
each range into objects. Text moves only where an object crosses the border of two ranges.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.plans.durable import durable
from revisit.schema import PAYLOAD_SCHEMA

_QUOTE, _ESCAPE, _OPEN, _CLOSE = (ord(c) for c in '"\\{}')
_CHANGES = (
    "file string, block bigint, length bigint, bytes bigint, odd int, "
    "as_found array<struct<change: bigint, closes: map<bigint, bigint>>>"
)
_OBJECTS = "file string, place bigint, block bigint, closed boolean, body binary"


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, body): the text of every outermost object in the files under ``path``.

    Files hold an array of objects, or objects one after the other, on one line or many. Objects
    have ``place`` as their order in the file. A file that ends inside an object, or in the middle of
    a string, fails. Text between objects (commas, brackets, white space) is not looked at.
    """
    ranges = ["file", "block", "length"]
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"),
        F.concat("value", F.lit("}")).cast("binary").alias("piece"),
        F.col("_metadata.file_size").alias("size"),
    )
    changes = pieces.select(*ranges, "piece").mapInArrow(_changes, _CHANGES)
    # A row for each range that has pieces.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def added(value: str):
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    quoted = F.coalesce(F.bit_xor("odd").over(before), F.lit(0)).alias("quoted")
    starts = changes.select("*", quoted, added("bytes").alias("begin"))
    starts = starts.select("*", F.inline(F.array(F.get("as_found", "quoted")))).withColumn("depth", added("change"))
    closed = F.coalesce(F.try_element_at("closes", -F.col("depth")), F.lit(0))
    starts = starts.withColumn("closed", closed).withColumn("place", added("closed"))
    starts = durable(starts.select(*ranges, "quoted", "begin", "depth", "place"), "json-ranges")
    # Another number of cores may give other ranges; then the second pass finds no start and fails.
    cut = pieces.join(F.broadcast(starts), ranges, "left").drop("length").mapInArrow(_objects, _OBJECTS)
    found = durable(cut, "json-objects")
    parts = found.where(F.col("block").isNotNull()).groupBy("file", "place").agg(
        F.array_sort(F.collect_list(F.struct("block", F.col("body").cast("string").alias("body")))).alias("parts"),
        F.max("closed").alias("closed"),
    )
    # Spark may parse the body ahead of the filters, so only whole objects have one.
    joined = F.when(F.col("closed"), F.array_join("parts.body", "")).alias("body")
    alone = F.col("block").isNull()
    whole = found.where(alone).select("file", "place", F.when(alone, F.col("body").cast("string")).alias("body"))
    both = whole.unionByName(parts.where("closed").select("file", "place", joined))
    return both.withColumn("body", F.regexp_replace("body", r"(?s)\A[^{]*", ""))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By byte range: its first row in the batch, its text, and where each piece ends in it."""
    if not batch.num_rows:
        return
    piece = batch.column(batch.schema.get_field_index("piece")).cast(pa.large_binary())
    data = np.frombuffer(piece.buffers()[2], np.uint8)
    ends = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
    where = [batch.column(batch.schema.get_field_index(c)) for c in ("file", "block")]
    same = [pa.compute.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in where]
    edges = np.concatenate([[0], np.flatnonzero(~(same[0] & same[1])) + 1, [batch.num_rows]]).astype(int)
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield first, data[ends[first] : ends[last]], ends[first + 1 : last + 1] - ends[first]


def _marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of braces, +1 or -1 for each, the number of quotes before it (0 or 1, odd), and of all quotes.

    Escaped quotes and opening braces do not count. Text ends with a closing brace or begins behind one,
    so no escape is cut.
    """
    plain = np.ones(len(text), bool)
    back = np.flatnonzero(text == _ESCAPE)
    if len(back):
        starts = np.flatnonzero(np.diff(back, prepend=-2) != 1)
        lengths = np.diff(np.append(starts, len(back)))
        after = back[starts] + lengths
        after = after[(lengths % 2 == 1) & (after < len(text))]
        plain[after[text[after] != _CLOSE]] = False
    quotes = np.flatnonzero((text == _QUOTE) & plain)
    braces = np.flatnonzero(((text == _OPEN) & plain) | (text == _CLOSE))
    change = np.where(text[braces] == _OPEN, 1, -1)
    return braces, change, np.searchsorted(quotes, braces) & 1, len(quotes) & 1


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each byte range changes: bytes, quotes (odd or not), and for either start (outside a string or
    inside) the depth, and how many closing braces lead to each depth at or below that of the start."""
    now, n, odd, change, closes = None, 0, 0, [0, 0], [Counter(), Counter()]

    def made() -> pa.RecordBatch:
        found = [{"change": c, "closes": list(k.items())} for c, k in zip(change, closes)]
        kind = pa.list_(pa.struct([("change", pa.int64()), ("closes", pa.map_(pa.int64(), pa.int64()))]))
        columns = [pa.array([v]) for v in now] + [pa.array([n], pa.int64()), pa.array([odd], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([found], kind)], ["file", "block", "length", "bytes", "odd", "as_found"])

    for batch in batches:
        for first, text, _ in _runs(batch):
            here = tuple(batch.column(i)[first].as_py() for i in range(3))
            if here != now:
                if now:
                    yield made()
                now, n, odd, change, closes = here, 0, 0, [0, 0], [Counter(), Counter()]
            _, step, inside, quotes = _marks(text)
            for start in (0, 1):
                counted = inside ^ odd ^ start == 0
                depth = change[start] + np.cumsum(step[counted])
                if len(depth):
                    low, times = np.unique(depth[(step[counted] < 0) & (depth <= 0)], return_counts=True)
                    closes[start].update(dict(zip(low.tolist(), times.tolist())))
                    change[start] = int(depth[-1])
            n, odd = n + len(text), odd ^ quotes
    if now:
        yield made()


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects that lie in one byte range, and the parts of others with the start of their range (``block``)."""
    now, held = None, []

    def part(closed: bool) -> pa.RecordBatch:
        cells = ([now[0]], [place], [now[1]], [closed], [b"".join(held)])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["file", "place", "block", "closed", "body"])

    for batch in batches:
        column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        for first, text, ends in _runs(batch):
            here = (column["file"][first].as_py(), column["block"][first].as_py())
            if here != now:
                if held:
                    yield part(False)
                start = [column[c][first].as_py() for c in ("quoted", "begin", "depth", "place", "size")]
                if start[0] is None:
                    raise ValueError(f"other byte ranges of {here[0]} than in the first pass; read it again")
                now, held, whole = here, [], False
                quoted, at, depth, place, size = start
            at += len(text)
            if at > size:  # the file's rest has no brace
                text = text[:-1]
            braces, step, inside, quotes = _marks(text)
            counted = inside ^ quoted == 0
            deep = depth + np.cumsum(step[counted])
            cuts = braces[counted][(step[counted] < 0) & (deep == 0)] + 1
            quoted, depth = quoted ^ quotes, int(deep[-1]) if len(deep) else depth
            if len(cuts):
                held.append(text[: cuts[0]].tobytes())
                if whole:  # begun in this range, in an earlier batch
                    yield _whole(now[0], place, np.frombuffer(b"".join(held), np.uint8), np.array([0, sum(map(len, held))]))
                else:
                    yield part(True)
                if len(cuts) > 1:
                    yield _whole(now[0], place + 1, text[cuts[0] : cuts[-1]], cuts - cuts[0])
                place, whole, held, text = place + len(cuts), True, [], text[cuts[-1] :]
            if len(text):
                held.append(text.tobytes())
            if at >= size:
                if depth != 0 or quoted:
                    raise ValueError(f"incomplete JSON at the end of {now[0]}")
                held = []
    if held:
        yield part(False)


def _whole(file: str, place: int, text: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    n = len(ends) - 1
    body = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
    none = pa.nulls(n, pa.int64())
    cells = [pa.repeat(file, n), pa.array(np.arange(place, place + n)), none, pa.repeat(True, n), body]
    return pa.RecordBatch.from_arrays(cells, ["file", "place", "block", "closed", "body"])


def read_payload_array(spark: SparkSession, path: str, schema: T.StructType = PAYLOAD_SCHEMA) -> DataFrame:
    """One row per payload object of files that hold one array each, however large."""
    parsed = F.from_json("body", schema, {"mode": "FAILFAST"})
    return json_objects(spark, path).select(parsed.alias("_payload")).select("_payload.*")
