import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import rows

from revisit.llm import byte_gru
from revisit.llm.byte_gru import Network, gradients, identify, text_probabilities
from revisit.llm.queries import LLM_QUERIES


def held_out(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 3 == 1


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_scores(net, text):
    """Scores at every byte of one piece, a step at a time."""
    size = net.new.shape[2]
    found = np.zeros((len(text), len(net.languages))) + net.bias
    for way in (0, 1):
        h = np.zeros(size)
        places = range(len(text)) if way == 0 else reversed(range(len(text)))
        for i in places:
            zr = sigmoid(net.gates[way, text[i]] + h @ net.gate_state[way])
            fresh = np.tanh(net.new[way, text[i]] + zr[size:] * (h @ net.new_state[way]))
            h = (1 - zr[:size]) * fresh + zr[:size] * h
            found[i] += h @ net.out[way]
    return found


def plain_probabilities(net, text):
    data, sums, n = text.encode(), 0, 0
    for at in range(0, len(data), byte_gru.PIECE):
        piece = data[at : at + byte_gru.PIECE]
        e = np.exp(plain_scores(net, piece))
        p = e / e.sum(1, keepdims=True)
        for b, row in zip(piece, p):
            if b >= 0x80 or chr(b).isalpha():
                sums, n = sums + row, n + 1
    return sums / max(n, 1)


def test_probabilities_equal_a_plain_network(monkeypatch):
    monkeypatch.setattr(byte_gru, "_ROWS", 3)
    net = Network.fresh(["a", "b", "c"], np.random.default_rng(1))
    texts = ["x", "", None, "Grüße, " * 60, "1 2 3", "abc" * 43, "日本語 text", "z" * 128]
    made = text_probabilities(Network.from_bytes(net.to_bytes()), pa.array(texts))
    for text, p in zip(texts, made):
        assert np.allclose(p, plain_probabilities(net, text or ""), atol=1e-4)


def test_gradients_equal_differences():
    net = Network.fresh(["a", "b", "c"], np.random.default_rng(2), 4)
    for name in Network.WEIGHTS:
        setattr(net, name, getattr(net, name).astype(np.float64))
    pieces = byte_gru._padded([b"hello w", b"ab", "é".encode(), b"zz9 q"], 7)
    labels = np.array([0, 1, 2, 1])
    _, found = gradients(net, pieces, labels)
    rng = np.random.default_rng(3)
    for name, gradient in zip(Network.WEIGHTS, found):
        weights = getattr(net, name)
        used = np.argwhere(np.abs(gradient) > 1e-4)
        for place in map(tuple, used[rng.permutation(len(used))[:6]]):
            kept, sides = weights[place], []
            for step in (1e-3, -1e-3):
                weights[place] = kept + step
                sides.append(gradients(net, pieces, labels)[0])
            weights[place] = kept
            assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(gradient[place], rel=0.03, abs=2e-5)


def test_odd_rows(spark):
    texts = ["der Hund und die Katze " * 5, "the dog and the cat " * 5]
    data = [(i, texts[i % 2], ["de", "en"][i % 2], 1.0, "x") for i in range(40)]
    odd = [
        (None, "the dog and the cat", "en"), (None, None, None), (100, "", "de"), (101, "12 !? 3", "de"),
        (102, "the dog " * 30_000, None), (103, None, "fr"), (7, "the cat", "en"), (7, "the cat", "en"),
        (104, "der", "de"), (105, "日本", None),
    ]
    kind = "doc_id long, text string, lang string, score double, lang_pred string"
    docs = spark.createDataFrame([*data, *[(*r, 2.0, "y") for r in odd]], kind)
    made = identify(docs)
    assert made.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = made.collect()
    assert len(found) == 50 and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (0, 1, 102, 7, 104)] == ["de", "en", "en", "en", "de"]
    assert [(by[i].lang_pred, by[i].score) for i in (100, 101, 103)] == [("und", 0.0)] * 3
    assert by[105].lang_pred in ("de", "en")
    assert identify(docs.limit(0)).count() == 0
    unlabelled = identify(docs.withColumn("lang", docs.lang.substr(9, 0)).where("lang IS NULL"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_neither_language_nor_source_decide(spark, docs_of):
    net = Network.fresh(["a", "b"], np.random.default_rng(1))
    docs = docs_of(["one two", "three"])
    made = [byte_gru.predict(d, net, {"doc_id": d.doc_id}).collect() for d in (docs, docs.drop("lang", "source"))]
    assert made[0] == made[1]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    made = LLM_QUERIES["op13_byte_gru"](spark, folder).collect()
    truth = {r["doc_id"]: r["lang"] for r in rows(folder, "documents")}
    assert len(made) == len(truth) and all(r.held_out == held_out(r.doc_id) for r in made)
    held = [r.lang_pred == truth[r.doc_id] for r in made if r.held_out]
    assert len(held) > 250 and np.mean(held) > 0.97
    assert min(r.score for r in made) > 0 and np.mean([r.score for r in made]) > 0.9
