"""Token ids as Parquet list columns that can be read by document, page or metadata alone."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from revisit.llm.word_cache import WordCache
from revisit.llm.words import Words, text_slices, words_of

END_ID = 1
_JOINED = 400  # words encoded in one call
MOST_BROADCAST_FILES = 100_000

# Kinds of bytes in words that are split: letters, digits, signs; zero in a word leaves it whole.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[ord("'")] = 0
_LATIN = np.zeros(256, bool)  # second bytes of letters whose first is C3
_LATIN[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True


class _WordEncoder:
    """Ids of words by a tokenizer that drops white space, many words in one call."""

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        # For words of lower-case letters up to U+00FF: nothing to normalise, nothing to split.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)]
        )
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True

    def __call__(self, texts: list[str]) -> list[list[int]]:
        made: list[list[int]] = [[]] * len(texts)
        plain, other, special = [], [], []
        for i, t in enumerate(texts):
            simple = t.isalpha() and t.islower() and (t.isascii() or max(t) <= "\xff")
            (special if "<|" in t else plain if simple else other).append(i)
        # Such a word is one run of pieces that ends with an end-of-word piece.
        for part in _parts(plain):
            (one,) = self.bare.encode_batch_fast(
                [" ".join(texts[i] for i in part)], add_special_tokens=False
            )
            ids = one.ids
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            for i, a, b in zip(part, [0, *cuts], cuts, strict=False):
                made[i] = ids[a:b]
        for part in _parts(other):
            (one,) = self.model.encode_batch(
                [" ".join(texts[i] for i in part)], add_special_tokens=False
            )
            ids, begins = one.ids, np.fromiter((o[0] for o in one.offsets), np.int64, len(one))
            length = np.fromiter((len(texts[i]) + 1 for i in part), np.int64, len(part))
            cuts = np.searchsorted(begins, np.cumsum(length)).tolist()
            for i, a, b in zip(part, [0, *cuts], cuts):
                made[i] = ids[a:b]
        for i in special:  # may hold the spelling of a special token
            made[i] = self.model.encode(texts[i], add_special_tokens=False).ids
        return made


def _parts(items: list[int]) -> Iterator[list[int]]:
    for i in range(0, len(items), _JOINED):
        yield items[i : i + _JOINED]


def _finer(words: Words) -> Words:
    """``words``, those of ASCII characters and letters of Latin-1 cut where the tokenizer cuts them.

    It takes letters and other signs apart and digits one by one, but contractions (with an
    apostrophe) as they are; control characters and all others are left to it.
    """
    data, kind = words.data, _KIND[words.data]
    begins = np.zeros(len(data), bool)
    begins[words.starts] = True
    # The letters from U+00C0 to U+00FF: two bytes, without the signs of multiplication and division.
    letter = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]] & ~begins[1:])
    kind[letter] = kind[letter + 1] = 1
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut &= ~begins
    whole = np.concatenate([[0], np.cumsum(kind == 0)])
    at = np.flatnonzero(cut)
    word = np.searchsorted(words.starts, at, side="right") - 1
    inside = word >= 0
    at, word = at[inside], word[inside]
    inside = (at < words.ends[word]) & (whole[words.ends[word]] == whole[words.starts[word]])
    at, word = at[inside], word[inside]
    starts, ends = (np.sort(np.concatenate([edge, at])) for edge in (words.starts, words.ends))
    return Words(words.data, starts, ends, words.first + np.searchsorted(word, words.first))


@cache
def _word_cache(path: str) -> WordCache:
    return WordCache(_WordEncoder(path), 600_000)


def encode(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each followed by ``end_id``; and where each ends."""
    # The tokenizer lower-cases; doing so first makes fewer distinct words. It must not make the
    # spelling of a special token, so texts with one stay as they are.
    special = pa.compute.any(pa.compute.match_substring(texts, "<|")).as_py()
    words = words_of(texts, lower=not special)
    if not special:
        words = _finer(words)
    store = _word_cache(path)
    place = store.places(words)
    size = np.concatenate([[0], np.cumsum(store.size[place])])
    counts = size[words.first[1:]] - size[words.first[:-1]] + 1
    ends = np.cumsum(counts)
    ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32)
    inner = np.ones(len(ids), bool)
    inner[ends - 1] = False
    ids[inner] = store.expand(place)
    return ids, ends


def write_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
    tokenizer: str | None = None, end_id: int = END_ID, encoding: str = "dictionary",
    group_bytes: int = 64 << 20, page_rows: int = 256,
) -> None:
    """Write (key, n_tokens, before, ids) to ``path``, in ascending order of ``key`` over the files.

    ``before`` is the number of ids of earlier documents of the same file. ``ids`` are stored with
    a dictionary ("dictionary") or as bit-packed differences ("delta"), in row groups of
    ``group_bytes``; pages of ``page_rows`` rows with page indexes let a reader of some keys skip
    the other pages, and one of the metadata never touches ids.

    Null and empty texts are one end id. Null keys come first; rows of equal keys are written in
    the order of their texts' hashes. Other columns are not written.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for part in text_slices(batches):
            ids, ends = encode(part.column(1), tokenizer, end_id)
            begins = np.concatenate([[0], ends[:-1]])
            lists = pa.ListArray.from_arrays(np.append(begins, ends[-1:]).astype(np.int32), ids)
            counts = pa.array(ends - begins), pa.array(begins + before)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, lists], ["key", "n_tokens", "before", "ids"]
            )
            before += int(ends[-1])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    made = (
        rows.repartitionByRange("key", tie)
        .sortWithinPartitions("key", tie)
        .mapInArrow(run, f"key {kind}, n_tokens bigint, before bigint, ids array<int>")
        .withColumnRenamed("key", key)
    )
    (
        made.write.option("compression", "zstd")
        .option("parquet.block.size", group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "v2")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``: the ids of all documents before each, over all files."""
    rows = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    if sizes.count() <= MOST_BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    joined = rows.join(offsets, "file").withColumn("start", F.col("offset") + F.col("before"))
    return joined.drop("file", "offset", "before")


def with_crc32(tokens: DataFrame, ids: str = "ids", into: str = "ids_crc32") -> DataFrame:
    """``ids`` replaced by the CRC-32 of all of a row's ids as little-endian 32-bit integers."""
    schema = StructType([*tokens.drop(ids).schema.fields, StructField(into, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            column = batch.column(at)
            flat = column.flatten().to_numpy().astype("<u4")
            cuts = np.asarray(column.offsets) - column.offsets[0].as_py()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sums, pa.int64())], schema.names)

    return tokens.mapInArrow(run, schema)
