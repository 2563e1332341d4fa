import hashlib
import random
import zlib

import pytest
from fixtures_llm import rows

from revisit.llm.prefix_trie import shared_prefixes
from revisit.llm.queries import LLM_QUERIES

COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


def brute_force(turns):
    """Nodes by walking every prefix of every rebuilt conversation."""
    said = {}
    for c, turn, role, text in turns:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts)] for c, ts in said.items()}
    members, ends = {}, {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = said.get(base, [])[:h] + said[c][h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m),
            len(children.get(node, [])), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, turns):
    clashing = "conv_id long, turn long, role string, text string, n1 int, depth string, c1 int"
    return spark.createDataFrame([(*t, 1, "x", 2) for t in turns], clashing)


ODD = [
    (0, 1, "u", "a"), (0, 2, "u", "b"), (0, 2, "a", "b"), (0, None, None, None), (0, 2, "a", "b"),
    (1, 1, "u", "a"), (2, None, "", ""), (2, None, "u", "ä" * 3000), (3, 5, "u", "b"), (3, 5, "u", "b"),
    (None, 1, "u", "a"), (-3, 1, "u", "a"), (-5, 1, "u", "a"), (-5, 2, "u", "c"), (11, 0, "u", "z"),
]


@pytest.mark.parametrize("most_local", [1, 3, 4096])
def test_odd_rows(spark, most_local):
    made = shared_prefixes(frame(spark, ODD), most_local=most_local)
    assert tuple(made.columns) == COLUMNS
    assert of(made) == brute_force(ODD)


@pytest.mark.parametrize("n, most_local", [(0, 4096), (60, 8), (150, 4096)])
def test_random_tries(spark, n, most_local):
    chance = random.Random(n)
    turns = [
        (c, t, chance.choice("ua"), chance.choice(["x", "y", "zz"]))
        for c in range(n)
        for t in range(chance.choice([0, 1, 3, 12, 30]))
    ]
    assert of(shared_prefixes(frame(spark, turns), most_local=most_local)) == brute_force(turns)


def test_a_long_conversation_and_many_equal_ones(spark):
    turns = [(5, t, "u", f"t{t}") for t in range(700)]
    turns += [(c, 0, "u", "same") for c in range(1000, 1400)]
    assert of(shared_prefixes(frame(spark, turns), most_local=200)) == brute_force(turns)


def test_query_equals_brute_force(spark, tiny):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows(tiny, "conversations")]
    assert of(LLM_QUERIES["op12_prefix_trie"](spark, tiny)) == brute_force(turns)
