import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from revisit.llm.queries import LLM_QUERIES
from revisit.llm import token_files
from revisit.llm.token_files import END_ID, encode, read_tokens, with_crc32, write_tokens
from revisit.plans.durable import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t", "Hello, world's it'S  don't", "é É ́x a b   c d",
    "ΣΑΣ σας ΑΣ. İstanbul ŠŤ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <| x",
    "12345 1a2b __ ## 中文字 かな 😀😀 x😀y", "\x1c \x85   a\x1fb", "w" * 5000, "a b " * 20_000,
]


def direct(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [END_ID]


def test_words_one_by_one_equal_whole_texts(documents):
    texts = ODD + [d["text"] for d in documents]
    ids, ends = encode(pa.array(texts), PATH)
    for text, part in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert part.tolist() == direct(text)


def test_query_equals_direct_encoding(spark, tiny, documents):
    made = {r.doc_id: r for r in LLM_QUERIES["op8_token_files"](spark, tiny).collect()}
    start = 0
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = direct(d["text"])
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        r = made.pop(d["doc_id"])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    assert not made


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip_and_layout(spark, docs_of, encoding):
    pairs = [(i * 7 % 11, t) for i, t in enumerate(ODD)] + [(None, "x"), (3, "again"), (3, "again")]
    with scratch(spark, "tokens") as path:
        write_tokens(docs_of(pairs), path, encoding=encoding, page_rows=2)
        made = read_tokens(spark, path).orderBy("start").collect()
        assert [(r.doc_id is not None, r.doc_id or 0) for r in made] == sorted(
            (k is not None, k or 0) for k, _ in pairs
        )
        assert sorted(tuple(r.ids) for r in made) == sorted(tuple(direct(t)) for _, t in pairs)
        assert [r.start for r in made] == np.cumsum([0, *(r.n_tokens for r in made)])[:-1].tolist()
        files = glob.glob(path.removeprefix("file:") + "/*.parquet")
        seen = set()
        for f in files:
            group = pq.ParquetFile(f).metadata.row_group(0)
            column = group.column(3)
            assert column.has_offset_index and group.column(0).has_column_index
            seen |= set(column.encodings)
        wanted = {"dictionary": "RLE_DICTIONARY", "delta": "DELTA_BINARY_PACKED"}[encoding]
        assert wanted in seen
        plan = read_tokens(spark, path).select("doc_id", "n_tokens")
        assert "ids" not in plan._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark, docs_of):
    with scratch(spark, "tokens") as path:
        write_tokens(docs_of([]), path)
        assert with_crc32(read_tokens(spark, path)).count() == 0
    with pytest.raises(ValueError):
        write_tokens(docs_of([]), "nowhere", encoding="plain")


SIGNS = [
    "alpha alpha, (alpha). \"alpha\" ALPHA! al-pha a_b", "café; CAFÉ, «naïve» Straße. ÀÉ×÷éa ÿ÷, ×× ÷.", "don't, 'tis it's. 's",
    "a1b22,3.4e5 1,000.00 v2.0-rc1", "x—,y …, a… ½, ª, º. µm, e\u0301, a\u0300b.c", "\x1fa,b c.\x7fd \x85.e f\u00a0,g",
    "Šk, ŠŤ. İ, ΑΣ, σ. 漢字, かな. 😀, x😀,y", "a<|b ,<, |>", "é", ",é", "é,", " , ", "'",
]


def test_words_with_signs_equal_whole_texts():
    model = Tokenizer.from_file(PATH)
    draw = np.random.default_rng(3)
    signs = list("abzéßÉ×,.-'1 \t—\u0301")
    mixed = ["".join(draw.choice(signs, 30)) for _ in range(2_000)]
    for texts in (SIGNS, mixed, *([t] for t in SIGNS)):
        ids, ends = encode(pa.array(texts), PATH)
        for text, part in zip(texts, np.split(ids, ends[:-1]), strict=True):
            assert part.tolist() == model.encode(text, add_special_tokens=False).ids + [END_ID]


def test_a_word_is_encoded_once_whatever_signs_surround_it(monkeypatch):
    seen, whole = [], token_files._WordEncoder.__call__
    monkeypatch.setattr(token_files._WordEncoder, "__call__", lambda self, texts: seen.extend(texts) or whole(self, texts))
    token_files._word_cache.cache_clear()
    encode(pa.array(["Alpha alpha, (alpha). café; café, don't, 12"]), PATH)
    token_files._word_cache.cache_clear()
    assert sorted(seen) == sorted(["alpha", ",", "(", ").", "café", ";", "don't,", "1", "2"])
