"""Quality rules from public tokenisers: characters per token, byte fallback, token entropy."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from revisit.llm.word_cache import WordCache
from revisit.llm.words import WORD_BASES, mix, rolling, text_slices, words_of

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_FIRST_BYTE, _LAST_BYTE = 3, 258  # the byte-fallback ids of the piece vocabulary


@dataclass(frozen=True)
class Band:
    """A text of this language or script is rejected outside any of these bounds.

    ``pieces`` and ``byte_pairs`` are the least characters per token of the two vocabularies,
    ``most`` the most (of both), ``fallback`` the largest share of byte-fallback tokens, ``entropy``
    the least collision entropy in bits, for the piece vocabulary.
    """

    pieces: float
    byte_pairs: float
    most: float
    fallback: float
    entropy: float


# By language: what labelled_bands() gives for the labelled-good documents with even ids of sf0.1
# (checked on the odd ones, see the README). The byte fallback of all of those is zero; 0.02 leaves
# room for one rare symbol in 200 tokens. By script for other languages: wide, as no table here has
# labelled texts of them.
BANDS = {
    "en": Band(2.03, 2.11, 2.46, 0.02, 5.77),
    "de": Band(2.05, 1.87, 2.41, 0.02, 5.71),
    "fr": Band(1.73, 1.74, 2.14, 0.02, 5.70),
    "es": Band(1.80, 1.65, 2.08, 0.02, 5.41),
    "latin": Band(1.20, 1.20, 6.0, 0.20, 5.00),
    "cyrillic": Band(0.90, 0.40, 6.0, 0.20, 5.00),
    "greek": Band(0.70, 0.30, 6.0, 0.30, 4.50),
    "han": Band(0.25, 0.20, 4.0, 0.90, 4.00),
    "other": Band(0.25, 0.15, 6.0, 1.00, 3.00),
}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "CJK", "HIRAGANA", "KATAKANA", "HANGUL")

MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
    " n_repeat_words bigint, chars_per_piece double, chars_per_byte_pair double,"
    " fallback_share double, entropy double, collision_entropy double, script string"
)


@cache
def _piece_cache(path: str) -> WordCache:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return WordCache(lambda texts: model.encode(texts, num_threads=1))


@cache
def _byte_cache(path: str) -> WordCache:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return WordCache(lambda texts: [coder.encode_ordinary(" " + t) for t in texts])


def _script(text: bytes) -> str:
    """The script of most letters, looked at from all over the text."""
    letters = set(text.decode("utf-8", "replace"))
    found: dict[str, int] = {}
    for c in letters:
        if c.isalpha():
            name = unicodedata.name(c, "OTHER").split()[0]
            found[name] = found.get(name, 0) + text.count(c.encode("utf-8", "replace"))
    name = max(found, key=lambda k: (found[k], k), default="OTHER")
    if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL"):
        return "han"
    return name.lower() if name in SCRIPTS else "other"


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def _entropies(doc: np.ndarray, ids: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Shannon entropy, and collision entropy without the bias of short texts, in bits."""
    key = np.sort(doc * (1 << 17) + ids)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    count = np.diff(np.append(begin, len(key))).astype(float)
    of = key[begin] >> 17
    n = np.bincount(of, count, n_docs)
    with np.errstate(divide="ignore", invalid="ignore"):
        shannon = np.log2(n) - np.bincount(of, count * np.log2(count), n_docs) / n
        collision = -np.log2(np.bincount(of, count * (count - 1), n_docs) / (n * (n - 1)))
    shannon[n == 0] = 0.0
    collision[n < 2] = 0.0
    return shannon, np.minimum(collision, 64.0)  # no token twice: more than any bound


def measure(texts: pa.Array, piece_path: str, byte_path: str) -> list[pa.Array]:
    """The columns of MEASURES for some texts."""
    words = words_of(texts)
    n_docs, first, doc = len(texts), words.first, words.doc_of_word()
    starts_char = (words.data & 0xC0) != 0x80
    chars_before = np.concatenate([[0], np.cumsum(starts_char)])
    word_chars = _per_doc(chars_before[words.ends] - chars_before[words.starts], first)

    text_list = texts.to_pylist()
    symbols, dup_lines, scripts = [], [], []
    for text in text_list:
        raw = (text or "").encode("utf-8", "replace")
        symbols.append(int(np.count_nonzero(_SYMBOL[np.frombuffer(raw, np.uint8)])))
        lines = [line for line in raw.split(b"\n") if line.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
        scripts.append("latin" if raw.isascii() and raw.strip() else _script(raw))

    n = len(words.starts)
    room = np.repeat(first[1:], words.counts()) - np.arange(n)
    begin = np.flatnonzero(room >= 3)
    three = rolling(words.hashes(), WORD_BASES[0], begin, begin + 3)
    key = mix(three + mix(doc[begin].astype(np.uint64) + np.uint64(1)))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    again = begin[times[inverse] > 1]
    repeated = np.zeros(n, bool)
    for shift in range(3):
        repeated[again + shift] = True

    pieces, pairs = _piece_cache(piece_path), _byte_cache(byte_path)
    place = pieces.places(words)
    n_pieces = _per_doc(pieces.size[place], first)
    ids = pieces.expand(place)
    token_doc = np.repeat(doc, pieces.size[place])
    fallback = np.bincount(token_doc[(ids >= _FIRST_BYTE) & (ids <= _LAST_BYTE)], minlength=n_docs)
    shannon, collision = _entropies(token_doc, ids.astype(np.int64), n_docs)
    pair_place = pairs.places(words)
    n_pairs = _per_doc(pairs.size[pair_place], first)
    whole = lambda x: pa.array(np.asarray(x, np.int64))
    return [
        whole(words.counts()),
        whole(word_chars),
        whole(symbols),
        whole(dup_lines),
        whole(_per_doc(repeated.astype(np.int64), first)),
        pa.array(word_chars / np.maximum(n_pieces, 1)),
        pa.array(word_chars / np.maximum(n_pairs, 1)),
        pa.array(fallback / np.maximum(n_pieces, 1)),
        pa.array(shannon),
        pa.array(collision),
        pa.array(scripts, pa.string()),
    ]


def with_measures(
    docs: DataFrame, into: str, text: str = "text", piece_path: str | None = None,
    byte_path: str | None = None,
) -> DataFrame:
    """``docs`` and a struct column ``into`` of MEASURES, in one pass and without a shuffle.

    Each word is encoded by itself, as after a space. Null texts have no words; zero measures.
    """
    piece_path = piece_path or public_tokenizers.path("piece_bpe_32k.model")
    byte_path = byte_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    measures = StructType.fromDDL(MEASURES)
    names, schema = measures.names, StructType([*docs.schema.fields, StructField(into, measures)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text, 1 << 19):
            texts = part.column(part.schema.get_field_index(text)).cast(pa.large_string())
            made = pa.StructArray.from_arrays(measure(texts, piece_path, byte_path), names)
            yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, into])

    return docs.mapInArrow(run, schema)


def base_failed(measures: Column) -> Column:
    few, repeats = measures["n_words"] < 50, 100 * measures["n_repeat_words"] > 50 * measures["n_words"]
    return few | repeats


def inside_band(measures: Column, lang: Column, bands: dict[str, Band] | None = None) -> Column:
    """Whether a text lies inside the band of its language, or of its script for other languages."""
    bands = bands or BANDS
    codes = F.array(*map(F.lit, sorted(bands)))
    known = F.array_contains(codes, F.lower(F.coalesce(lang, F.lit(""))))
    name = F.when(known, F.lower(lang)).otherwise(measures["script"])

    def bound(field: str) -> Column:
        cells = [x for k, b in bands.items() for x in (F.lit(k), F.lit(getattr(b, field)))]
        return F.element_at(F.create_map(*cells), name)

    return (
        (measures["chars_per_piece"] >= bound("pieces"))
        & (measures["chars_per_byte_pair"] >= bound("byte_pairs"))
        & (F.greatest(measures["chars_per_piece"], measures["chars_per_byte_pair"]) <= bound("most"))
        & (measures["fallback_share"] <= bound("fallback"))
        & (measures["collision_entropy"] >= bound("entropy"))
    )


def labelled_bands(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    tail: float = 0.002, fallback: float = 0.02,
) -> dict[str, Band]:
    """Bands by language that cut ``tail`` off each measure of ``docs``, texts labelled as good.

    Quantiles are exact and rounded outwards to 0.01; texts that fail the base rules do not count.
    The largest byte-fallback share is kept if it is over ``fallback``. One row per language comes back.
    """
    made = with_measures(docs.select(key, text, lang), "m", text).where(~base_failed(F.col("m")))
    most = F.greatest("m.chars_per_piece", "m.chars_per_byte_pair")
    rows = made.where(F.col(lang).isNotNull()).groupBy(F.lower(lang).alias("code")).agg(
        *[
            (F.floor(100 * F.percentile(f"m.{c}", F.lit(tail))) / 100).alias(name)
            for name, c in (
                ("pieces", "chars_per_piece"), ("byte_pairs", "chars_per_byte_pair"), ("entropy", "collision_entropy")
            )
        ],
        (F.ceil(100 * F.percentile(most, F.lit(1 - tail))) / 100).alias("most"),
        F.greatest(F.max("m.fallback_share"), F.lit(fallback)).alias("fallback"),
    )
    fields = ("pieces", "byte_pairs", "most", "fallback", "entropy")
    return {r.code: Band(*[float(r[f]) for f in fields]) for r in rows.collect()}


def judged(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    bands: dict[str, Band] | None = None,
) -> DataFrame:
    """(key, measures, base_failed, kept) per row of ``docs``.

    Null and empty texts have no words and fail the base rules; a null or unknown language is
    judged by the script of most letters; repeated rows get equal verdicts; other columns of
    ``docs`` are not read.
    """
    made = with_measures(docs.select(key, text, lang), "measures", text)
    measures = F.col("measures")
    failed = base_failed(measures)
    return made.select(
        key,
        "measures.*",
        failed.alias("base_failed"),
        (~failed & inside_band(measures, F.col(lang), bands)).alias("kept"),
    )


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    into = "measures"
    while into in (c.lower() for c in docs.columns):
        into += "_"
    made = with_measures(docs, into, text)
    measures = F.col(into)
    return made.where(~base_failed(measures) & inside_band(measures, F.col(lang))).drop(into)
