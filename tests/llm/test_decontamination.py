import re
from math import ceil

import pytest

from oracle import connect, difference
from revisit.llm import bounded
from revisit.llm.decontamination import clean_documents, contained_items
from revisit.llm.queries import LLM_ORACLES, LLM_QUERIES

ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "two words"), (3, ""), (4, None), (5, "One, two; three four five!"),
    (6, "the quick brown fox jumps over the lazy dog near the river bank today"), (None, "null item of five words"),
]


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def expected(docs, items):
    made = set()
    for k, t in items:
        w = words(t)
        n = min(5, len(w))
        own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for d, text in docs:
            v = words(text)
            there = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} & own
            if own and len(there) >= ceil(round(0.8 * len(own), 9)):
                made.add((d, k, len(there), len(own)))
    return made


@pytest.mark.parametrize("most", [bounded.MOST_BROADCAST, 0])
def test_odd_rows(spark, docs_of, monkeypatch, most):
    monkeypatch.setattr(bounded, "MOST_BROADCAST", most)
    fox = ITEMS[0][1]
    docs = [
        (0, "noise " * 30_000 + fox.upper().replace(" ", " - ") + " tail" * 5000), (1, None), (2, ""),
        (3, " ".join(fox.split()[:11])), (4, " ".join(fox.split()[:9])), (5, "Two\nwords"), (6, "two other words"),
        (7, "one two three four five six"), (8, "x null item of five words y"), (None, fox), (9, fox.replace("quick", "slow")),
    ]
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id bigint, text string, doc_id string")
    frame = docs_of(docs)
    made = {tuple(r)[:4] for r in contained_items(frame, items).collect()}
    assert made == expected(docs, ITEMS)
    kept = clean_documents(frame, items)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, *_ in made}
    assert kept.schema == frame.schema


def test_query_equals_sql(spark, tiny):
    name = "op5_decontamination"
    made = LLM_QUERIES[name](spark, tiny)
    assert made.count() > 0
    assert difference(made, connect(tiny), LLM_ORACLES[name]) is None
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = docs_of(["two words"])
    assert contained_items(docs.limit(0), items).count() == 0
    assert contained_items(docs, items.limit(0)).count() == 0
    assert clean_documents(docs, items.limit(0)).count() == 1
