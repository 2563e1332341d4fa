import random

from revisit.llm import snapshots
from revisit.llm.queries import LLM_QUERIES
from revisit.llm.snapshots import maximal, rendered

SCHEMA = "conv_id bigint, turn bigint, role string, text string, a string, n_turns int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(rows):
    convs = {}
    for c, t, r, x in sorted(set(rows), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((r, x))
    kept = {}
    for c, turns in convs.items():
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values()):
            kept.setdefault(tuple(turns), []).append(c)
    return {
        (min((c for c in cs if c is not None), default=None), len(turns), len(cs))
        for turns, cs in kept.items()
    }


def test_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "CHUNK", 3)
    random.seed(5)
    rows = []
    for c in range(120):
        for t in range(random.randint(1, 9)):
            rows.append((c, t * 2, random.choice(["user", "bot"]) if t > 5 else "user", str(random.random() < 0.2)))
    rows += rows[:40]
    made = {tuple(r) for r in maximal(frame(spark, rows)).collect()}
    assert made == expected(rows) and len(made) < 120


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yes"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"),
        (4, 0, None, "hi"), (5, 0, "user", None), (6, 0, "user", ""), (None, 0, "user", "lost"),
        (7, None, "user", "n"), (7, 4, "user", "m"), (8, None, "user", "n"), (9, 0, "user", "long " * 50_000),
        (9, 0, "user", "long " * 50_000),
    ]
    made = {tuple(r) for r in maximal(frame(spark, rows)).collect()}
    assert made == expected(rows)
    assert maximal(frame(spark, [])).count() == rendered(frame(spark, [])).count() == 0
    chats = {r.conv_id: r.chat for r in rendered(frame(spark, rows)).collect()}
    assert chats[2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyes<|im_end|>\n"
    assert chats[5] == "<|im_start|>user\n<|im_end|>\n" and 3 not in chats and 1 not in chats
    assert chats[None].count("lost") == 1 and chats[9].count("<|im_start|>") == 1


def test_query_equals_sql(spark, tiny):
    import duckdb

    from oracle import TABLES, connect, difference
    from revisit.llm.queries import LLM_ORACLES

    assert TABLES and duckdb
    name = "op3_snapshots"
    assert difference(LLM_QUERIES[name](spark, tiny), connect(tiny), LLM_ORACLES[name]) is None
