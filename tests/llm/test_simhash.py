import random

import numpy as np
import pytest
import xxhash
from fixtures_llm import lower_ascii, plain_words

from revisit.llm.queries import LLM_QUERIES
from revisit.llm.simhash import _linked, close_links, near_duplicates


def fingerprint(text):
    words = plain_words(lower_ascii(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """id -> smallest id reachable, from (id, fingerprint) pairs, comparing all of them."""
    up = {i: i for i, _ in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= 3:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in prints}


def test_query_equals_brute_force(spark, tiny, documents):
    made = {r.doc_id: r for r in LLM_QUERIES["op10_simhash"](spark, tiny).collect()}
    prints = [(d["doc_id"], fingerprint(d["text"])) for d in documents]
    assert {i: r.fingerprint for i, r in made.items()} == {i: f"{p:016x}" for i, p in prints}
    assert {i: r.component_id for i, r in made.items()} == classes(prints)


def test_odd_rows(docs_of):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", " \t\n", "Aa", "aA", "one two", long, long + " end", "b c d e", "b c d e"]
    docs = docs_of(texts)
    made = {r.doc_id: (r.fp, r.component) for r in near_duplicates(docs).collect()}
    prints = [(i, fingerprint(t)) for i, t in enumerate(texts)]
    assert {i: fp & (1 << 64) - 1 for i, (fp, _) in made.items()} == dict(prints)
    assert {i: c for i, (_, c) in made.items()} == classes(prints)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_keys(docs_of):
    docs = docs_of([(None, "q w e r"), (7, "q w e r"), (7, "q w e r"), (None, "z")])
    made = sorted((r.doc_id or 0, r.component or 0) for r in near_duplicates(docs).collect())
    assert made == [(0, 0), (0, 7), (7, 7), (7, 7)]


@pytest.mark.parametrize("size", [40, 300, 5000])
def test_lists_of_every_size(size):
    random.seed(size)
    base = random.getrandbits(64)
    values = {base}
    while len(values) < size:  # bytes 0 to 2 vary, the other five agree
        values.add(base ^ random.getrandbits(24) if random.random() < 0.9 else base ^ 1 << random.randrange(24))
    v = np.array(sorted(values), np.uint64)
    a, b = _linked(np.zeros(size, np.int64), v, 3, 5)
    up = {int(x): int(x) for x in v}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = sorted((root(x), root(y)))
        up[y] = x
    links = 0
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3).tolist():
            links += 1
            assert root(int(v[i])) == root(int(v[i + 1 + j]))
    assert links


def test_chain_of_links(spark):
    chain = [0]
    for i in range(60):
        chain.append(chain[-1] | 1 << i)
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in chain], "fp bigint")
    assert close_links(frame).count() >= len(chain) - 1
