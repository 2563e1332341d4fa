import hashlib
from collections import Counter

import pytest
from fixtures_llm import plain_words

from revisit.llm import key_counts
from revisit.llm.queries import LLM_QUERIES
from revisit.llm.substring_dedup import remove_repeats


def expected(texts, length):
    """Per text: its words and which of them go."""
    words = [plain_words(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    gone = []
    for w in words:
        g = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                g[i : i + length] = [True] * length
        gone.append(g)
    return list(zip(words, gone))


def check(made, texts, length):
    for r, (words, gone) in zip(made, expected(texts, length)):
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept) == (len(words), sum(gone), kept)
        covered = [any(s.start <= i < s.end for s in r.spans) for i in range(len(words))]
        assert covered == gone
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))  # maximal


def test_query_equals_brute_force(spark, tiny, documents):
    made = {r.doc_id: r for r in LLM_QUERIES["op1_substring_dedup"](spark, tiny).collect()}
    wanted = expected([d["text"] for d in documents], 35)
    assert len(made) == len(documents)
    assert any(sum(g) for _, g in wanted)
    for d, (words, gone) in zip(documents, wanted):
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        r = made[d["doc_id"]]
        digest = hashlib.sha256(kept.encode()).hexdigest()
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), sum(gone), digest)


ODD = [
    None, "", "  \n", "a b c", "a b c d", "x a b c y", "q r é s q r é s t",
    "a a a a a a", "p1 a b c p2 a b c p3", "same text of words", "same text of words",
    " ".join(f"n{i}" for i in range(40_000)),
]


@pytest.mark.parametrize("size", [key_counts.BATCH_BYTES, 20])
def test_odd_texts(docs_of, monkeypatch, size):
    monkeypatch.setattr(key_counts, "BATCH_BYTES", size)
    made = remove_repeats(docs_of(ODD), length=3).orderBy("doc_id").collect()
    assert [r.doc_id for r in made] == list(range(len(ODD)))
    check(made, ODD, 3)


def test_windows_do_not_cross_texts(docs_of):
    made = remove_repeats(docs_of(["a b", "c d", "a b c d"]), length=3).collect()
    assert [r.n_removed for r in made] == [0, 0, 0]


def test_empty_table_and_null_keys(docs_of):
    assert remove_repeats(docs_of([]), length=3).count() == 0
    docs = docs_of([(None, "a b c"), (None, "a b c"), (4, "a b d")])
    made = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(docs, length=3).collect())
    assert made == [(0, 3), (0, 3), (4, 0)]
