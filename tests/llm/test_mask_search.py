import math
import random
import re

import pytest

from revisit.llm import mask_search
from revisit.llm.mask_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, top=50):
    counted = []
    for k, text in docs:
        words = terms(text)
        counted.append((k, len(words), {w: words.count(w) for w in set(words)}))
    n_docs, total = sum(1 for _, n, _ in counted if n), sum(n for _, n, _ in counted)
    asked = {}
    for k, text in items:
        asked.setdefault(k, set()).update(terms(text))
    found = []
    for item, words in asked.items():
        weight = {
            w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(w in c for _, _, c in counted) + 1)))
            for w in words
        }
        scored = []
        for k, n, c in counted:
            m = 50 + (50 * n * n_docs) // total if total else 0
            score = sum(weight[w] * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if score > 0:
                scored.append((-score, k is None, k or 0))
        for rank, (score, unknown, k) in enumerate(sorted(scored)[:top], 1):
            found.append((item, rank, None if unknown else k, -score))
    return sorted(found, key=str)


def of(df):
    return sorted(map(tuple, df.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "item_id long, text string, doc_id string, score int")


def random_tables(seed, n_docs, n_items):
    chance = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ä", "ß9", "WORD", "word", "日本"]
    weights = [1 / (1 + i) for i in range(len(words))]
    text = lambda most: " ,.-"[chance.randrange(4)].join(
        chance.choices(words, weights, k=chance.randrange(most)))
    return [(i // 2, text(60)) for i in range(n_docs)], [(i, text(25)) for i in range(n_items)]


@pytest.mark.parametrize("seed, n_docs, n_items, top", [(1, 300, 12, 50), (2, 400, 9, 3), (3, 90, 30, 1)])
def test_random_tables(spark, docs_of, monkeypatch, seed, n_docs, n_items, top):
    docs, items = random_tables(seed, n_docs, n_items)
    for groups in (100_000, 40):
        made = search(docs_of(docs), items_of(spark, items), top=top, item_terms=groups)
        assert made.columns == ["item_id", "rank", "doc_id", "score"]
        assert of(made) == brute_force(docs, items, top)


def test_odd_rows(spark, docs_of):
    docs = [
        (0, None), (1, ""), (2, "... ---"), (3, "Alpha beta"), (3, "Alpha beta"), (None, "alpha beta"),
        (4, "alpha " * 40_000 + "beta"), (5, "x" * 300_000 + " gamma"), (6, "ALPHA\x00beta|Gamma"),
        (-7, "alpha beta"), (8, "Éalpha É"),
    ]
    items = [(1, "ALPHA alpha beta"), (2, None), (3, ""), (4, "nowhere"), (None, "gamma é É"), (5, "gamma"), (5, "beta")]
    assert of(search(docs_of(docs), items_of(spark, items))) == brute_force(docs, items)


def test_long_texts_are_read_in_pieces(spark, docs_of, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(mask_search, "PIECE", 64)
    texts = ["ab cd " * 100, "", "q" * 500 + " ab", "cd" + "." * 300 + "ab", "ä ab" * 40, None]
    asked, _ = mask_search._asked([{"item": 1, "term": t} for t in ("ab", "cd", "ä")])
    block = mask_search.read_block(pa.array(texts), asked)
    assert block.lengths.tolist() == [len(terms(t)) for t in texts]
    total = sum(terms(t).count(w) for t in texts for w in ("ab", "cd", "ä"))
    assert block.times.sum() == total


def test_empty_tables(spark, docs_of):
    nothing, items = docs_of([(1, "a")]).limit(0), items_of(spark, [(1, "a")])
    assert search(nothing, items).count() == 0
    assert search(docs_of([(1, "a")]), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_last_masks_are_not_scored(monkeypatch):
    """Masks that cannot reach the last place are left out."""
    import numpy as np
    import pyarrow as pa

    texts = ["rare common"] * 60 + ["common"] * 3000
    asked, _ = mask_search._asked([{"item": 1, "term": t} for t in ("rare", "common")])
    block = mask_search.read_block(pa.array(texts), asked)
    asked.total_docs, asked.total_terms = len(texts), int(block.lengths.sum())
    asked.weight = np.array([3000, 3000])
    scored = []
    add = mask_search.Best.add
    monkeypatch.setattr(mask_search.Best, "add", lambda self, s, *a: (scored.append(len(s)), add(self, s, *a))[1])
    best = mask_search.Best()
    ids = np.arange(len(texts))
    mask_search.Masks(block, asked).improve(best, np.array([0, 1]), ids >= 0, ids, 50)
    assert best.doc.tolist() == list(range(50)) and sum(scored) == 60
