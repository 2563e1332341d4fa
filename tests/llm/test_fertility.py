import base64
import math
from collections import Counter

import public_tokenizers
import sentencepiece
import tiktoken
from fixtures_llm import plain_words, rows

from revisit.llm.fertility import BANDS, judged, kept_documents, labelled_bands
from revisit.llm.queries import LLM_QUERIES

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
    BYTE = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)},
    )


def base(text):
    words = plain_words(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            again[i : i + 3] = [True] * 3
    lines = [x for x in (text or "").split("\n") if plain_words(x)]
    failed = len(words) < 50 or 100 * sum(again) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), sum(again), failed


def verdict(text, band):
    words = plain_words(text)
    pieces = [i for w in words for i in SP.encode(w)]
    pairs = [i for w in words for i in BYTE.encode_ordinary(" " + w)]
    n, chars = len(pieces), sum(map(len, words))
    counts = Counter(pieces).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts) if n else 0.0
    same = sum(c * (c - 1) for c in counts)
    collision = 0.0 if n < 2 else -math.log2(same / (n * (n - 1))) if same else 64.0
    fallback = sum(3 <= i <= 258 for i in pieces) / max(n, 1)
    per = chars / max(n, 1), chars / max(len(pairs), 1)
    inside = (
        per[0] >= band.pieces and per[1] >= band.byte_pairs and max(per) <= band.most
        and fallback <= band.fallback and collision >= band.entropy
    )
    return (*per, fallback, entropy, collision), inside


def same(r, text, band):
    wanted = base(text)
    made = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
    assert made == wanted
    measures, inside = verdict(text, band)
    made = r.chars_per_piece, r.chars_per_byte_pair, r.fallback_share, r.entropy, r.collision_entropy
    for a, b in zip(made, measures):
        assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    assert r.kept == (inside and not wanted[-1])


def test_query_equals_brute_force(spark, tiny, documents):
    made = {r.doc_id: r for r in LLM_QUERIES["op2_fertility"](spark, tiny).collect()}
    assert len(made) == len(documents)
    for d in documents:
        same(made[d["doc_id"]], d["text"], BANDS[d["lang"]])


def test_junk_goes_and_prose_stays(spark, tiny, documents):
    made = {r.doc_id: r for r in LLM_QUERIES["op2_fertility"](spark, tiny).collect()}
    labels = rows(tiny, "labels")
    bad = [made[x["doc_id"]] for x in labels if x["quality"] == 0]
    good = [made[x["doc_id"]] for x in labels if x["quality"] == 1]
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
    plain = [r for r in good if not r.base_failed]
    assert sum(r.kept for r in plain) >= 0.98 * len(plain)


ODD = [
    (None, "latin"), ("", "other"), (" \n\t\n", "other"), ("a b c a b c\na b c a b c\n\na b c a b c", "latin"),
    ("word " * 60_000, "latin"), ("Проверка текста " * 30, "cyrillic"), ("漢字 テスト " * 40, "han"),
    ("αβγ δεζ " * 30, "greek"), ("😀 123 #*$%&|<> ", "other"), ("▁ x▁y <0x41> </s>", "latin"),
]


def test_odd_texts_and_unknown_languages(spark):
    data = [(i, t, None if i % 2 else "xx", "a", 1) for i, (t, _) in enumerate(ODD)]
    schema = "doc_id bigint, text string, lang string, measures string, kept int"
    docs = spark.createDataFrame(data + data[3:4], schema)
    made = judged(docs).orderBy("doc_id").collect()
    assert len(made) == len(ODD) + 1
    for r in made:
        text, script = ODD[r.doc_id]
        if text is not None:
            assert r.script == script
        same(r, text, BANDS[r.script])
    assert kept_documents(docs).schema == docs.schema
    assert judged(docs.limit(0)).count() == kept_documents(docs.limit(0)).count() == 0


def test_every_measure_takes_part(spark, tiny, documents):
    made = {r.doc_id: r for r in LLM_QUERIES["op2_fertility"](spark, tiny).collect()}
    lang = {d["doc_id"]: d["lang"] for d in documents}
    labels = {x["doc_id"]: x["quality"] for x in rows(tiny, "labels")}
    junk = [made[k] for k, q in labels.items() if q == 0 and lang[k] == "en" and not made[k].base_failed]
    assert junk
    low = [r for r in junk if r.chars_per_piece < BANDS["en"].pieces or r.chars_per_byte_pair < BANDS["en"].byte_pairs]
    assert len(low) >= 0.5 * len(junk)
    plain = max((d for d in documents if lang[d["doc_id"]] == "en" and made[d["doc_id"]].kept), key=lambda d: len(d["text"]))
    words = plain["text"].split()[:400]
    for i in range(0, 400, 40):
        words[i] += chr(0x12000 + i)  # a sign that the piece vocabulary spells as bytes
    odd = " ".join(words)
    (r,) = judged(spark.createDataFrame([(1, odd, "en")], "doc_id bigint, text string, lang string")).collect()
    assert BANDS["en"].fallback < r.fallback_share < 0.1 and not r.kept


def test_bands_are_fitted_to_labelled_texts(spark, tiny, documents):
    good = {x["doc_id"] for x in rows(tiny, "labels") if x["quality"] == 1}
    data = [(d["doc_id"], d["text"], d["lang"]) for d in documents if d["doc_id"] in good]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    bands = labelled_bands(docs, tail=0.1)
    kept = [r for r in judged(docs, bands=bands | {k: v for k, v in BANDS.items() if k not in bands}).collect() if not r.base_failed]
    assert set(bands) <= {"en", "de", "fr", "es"} and 0.5 * len(kept) <= sum(r.kept for r in kept) < len(kept)
