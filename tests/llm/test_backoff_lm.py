import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import lower_ascii, plain_words

from revisit.llm import key_counts
from revisit.llm.backoff_lm import Automaton, grams_of, score_texts, tokens_of
from revisit.llm.queries import LLM_QUERIES

MASS = 300.0


def model(docs, order=2):
    """Plain dictionaries: key -> (n_tokens, n_known, N, base, score)."""
    tokens = [(k, [*plain_words(lower_ascii(t)), "\n"]) for k, t in docs]
    word, gram, states = Counter(), Counter(), Counter()
    for k, ts in tokens:
        if zlib.crc32(b"" if k is None else str(k).encode()) % 7 != 2:
            word.update(ts)
            parts = [None, *ts]
            for i in range(1, len(parts)):
                for length in range(1, order):
                    if i >= length:
                        gram[tuple(parts[i - length : i + 1])] += 1
                        states[tuple(parts[i - length : i])] += 1
    n, v = sum(word.values()), len(word)

    def p(context, w):
        if not context:
            return (word[w] + 1) / (n + v + 1)
        return (gram[(*context, w)] + MASS * p(context[1:], w)) / (states[context] + MASS)

    def total(ts):
        parts = (None, *ts)
        return sum(math.log10(p(parts[max(0, i - order + 1) : i], parts[i])) for i in range(1, len(parts)))

    return [
        (
            len(ts),
            sum(word[t] > 0 for t in ts),
            n,
            sum(math.log10((word[t] + 1) / (n + v + 1)) for t in ts),
            total(ts),
        )
        for _, ts in tokens
    ]


def same(row, wanted):
    assert (row.n_tokens, row.n_known, row.train_tokens) == wanted[:3]
    assert math.isclose(row.base_score, wanted[3], rel_tol=1e-9)
    assert math.isclose(row.score, wanted[4], rel_tol=1e-9)


def test_query_equals_dictionaries(spark, tiny, documents):
    made = {r.doc_id: r for r in LLM_QUERIES["op6_backoff_lm"](spark, tiny).collect()}
    wanted = model([(d["doc_id"], d["text"]) for d in documents])
    for d, w in zip(documents, wanted):
        same(made[d["doc_id"]], w)
        assert made[d["doc_id"]].held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2)
    held = [made[d["doc_id"]] for d in documents if made[d["doc_id"]].held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("size", [key_counts.BATCH_BYTES, 20])
def test_odd_texts(docs_of, monkeypatch, size):
    monkeypatch.setattr(key_counts, "BATCH_BYTES", size)
    texts = [None, "", "A b", "a B", " \t", "a b a b a b", "é É", "long " * 30_000, "a b", "a b"]
    made = score_texts(docs_of(texts)).orderBy("doc_id").collect()
    for r, w in zip(made, model(list(enumerate(texts))), strict=True):
        same(r, w)


def test_null_keys_and_empty_table(docs_of):
    assert score_texts(docs_of([])).count() == 0
    docs = [(None, "a b"), (3, "a c")]
    made = sorted(score_texts(docs_of(docs)).collect(), key=lambda r: r.doc_id or 0)
    for r, w in zip(made, model(docs), strict=True):
        same(r, w)


def test_only_held_out(docs_of):
    key = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    (row,) = score_texts(docs_of([(key, "a b")])).collect()
    assert (row.n_known, row.train_tokens, row.base_score, row.score) == (0, 0, 0.0, 0.0)


@pytest.mark.parametrize("order", [1, 3, 5])
def test_other_orders(docs_of, documents, order):
    texts = [None, "", "a b c d a b c e", "a b c d a b c e a b c d", "x", "b c d a b", "a b a b a b", " ".join("ab" * 900)]
    texts += [d["text"] for d in documents[:40]]
    made = score_texts(docs_of(texts), order=order).orderBy("doc_id").collect()
    for r, w in zip(made, model(list(enumerate(texts)), order), strict=True):
        same(r, w)


def automaton(texts, order, mass=5.0):
    t = tokens_of(pa.array(texts))
    grams = grams_of(t, np.ones(len(t.token), bool), order)
    counts = [g.keys.adds for g in grams]
    return t, Automaton.build(grams, counts, len(texts), len(t.token), len(counts[0]), mass)


def test_failure_arcs_in_chains():
    t, made = automaton(["a b c", "b d", "d"], 3)
    seen = [np.array(c) for c in made.counts]
    entered, taken = made.walk(t.first)
    assert entered.tolist() == [1, 2, 2, 2, 1, 2, 2, 1, 2]
    assert taken.tolist() == entered.tolist()  # every token was seen where it stands
    made.counts[2] = np.zeros_like(seen[2])  # no arc after two parts: a failure arc each
    assert made.walk(t.first)[1].tolist() == [1, 1, 1, 1, 1, 1, 1, 1, 1]
    made.counts[1] = np.zeros_like(seen[1])  # nor after one: two in a row, and no state of two parts
    entered, taken = made.walk(t.first)
    assert entered.tolist() == [1, 1, 1, 1, 1, 1, 1, 1, 1] and not taken.any()


@pytest.mark.parametrize("order", [2, 3])
def test_states_add_up_to_one(order):
    t, made = automaton(["a b a c", "b a", "c c b a b"], order)
    words = len(made.root_arc)
    p = {(): 10**made.root_arc}
    unknown = {(): 1 / (len(t.token) + words + 1)}
    assert math.isclose(p[()].sum() + unknown[()], 1)
    parts = [[words, *made.grams[0].place[i:j]] for i, j in zip(t.first[:-1], t.first[1:])]
    for length in range(1, order):
        found = Counter(tuple(x[i : i + length + 1]) for x in parts for i in range(len(x) - length))
        states = Counter()
        for g, n in found.items():
            states[g[:-1]] += n
        for state, n in states.items():
            lower = p.get(state[1:], p[()]), unknown.get(state[1:], unknown[()])
            count = np.array([found[(*state, w)] for w in range(words)])
            p[state] = (count + 5.0 * lower[0]) / (n + 5.0)
            unknown[state] = 5.0 * lower[1] / (n + 5.0)
            assert math.isclose(p[state].sum() + unknown[state], 1)
    weight = made.weights(t.first)
    for x, at in zip(parts, t.first):
        for i in range(1, len(x)):
            state = tuple(x[max(0, i - order + 1) : i])
            assert math.isclose(10 ** weight[at + i - 1], p[state][x[i]], rel_tol=1e-12)
