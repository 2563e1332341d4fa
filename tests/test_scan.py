"""Running values equal a plain loop, also where one key fills most partitions."""

import random

import pytest

from revisit.operators.scan import BEFORE, PEERS, Running, segmented_scan

KINDS = {
    "total": Running("sum", "v"),
    "least": Running("min", "v"),
    "most": Running("max", "v"),
    "mixed": Running("xor", "v"),
    "last": Running("last", "v"),
    "last_before": Running("last", "v", BEFORE),
    "total_before": Running("sum", "v", BEFORE),
    "with_peers": Running("sum", "v", PEERS),
}


def plain(rows):
    made = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[3]))
        for i, row in enumerate(own):
            upto = [r[2] for r in own[: i + 1] if r[2] is not None]
            before = [r[2] for r in own[:i] if r[2] is not None]
            peers = [r[2] for r in own if (r[1] is not None, r[1] or 0) <= (row[1] is not None, row[1] or 0)]
            peers = [v for v in peers if v is not None]
            mixed = 0
            for v in upto:
                mixed ^= v
            made[row[3]] = (
                sum(upto) if upto else None, min(upto, default=None), max(upto, default=None),
                mixed if upto else None, upto[-1] if upto else None, before[-1] if before else None,
                sum(before) if before else None, sum(peers) if peers else None,
            )
    return made


def rows_of(n, heavy):
    chance = random.Random(n)
    keys = [None, 1, 2, 3]
    return [
        (
            7 if chance.random() < heavy else chance.choice(keys),
            chance.choice([None, *range(40)]),
            chance.choice([None, *range(-5, 50)]),
            i,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("n, heavy", [(0, 0), (1, 0), (300, 0.2), (400, 0.9), (200, 1)])
def test_running_values(spark, n, heavy):
    rows = rows_of(n, heavy)
    df = spark.createDataFrame(rows, "k int, t int, v bigint, `i.d` int")
    distinct = {k: v for k, v in KINDS.items() if k != "with_peers"}
    made = segmented_scan(df, ["k"], ["t", "i.d"], distinct, partitions=7)
    peers = segmented_scan(df, ["k"], ["t"], {"with_peers": KINDS["with_peers"]}, partitions=7)
    assert made.columns == ["k", "t", "v", "i.d", *distinct]
    wanted = plain(rows)
    assert {r["i.d"]: tuple(r)[4:] for r in made.collect()} == {i: w[:-1] for i, w in wanted.items()}
    assert {r["i.d"]: r["with_peers"] for r in peers.collect()} == {i: w[-1] for i, w in wanted.items()}


def test_a_heavy_key_lies_in_many_partitions(spark):
    from revisit.operators.scan import PART, place

    placed = place(spark.range(10_000).selectExpr("1 AS k", "id AS t"), ["k"], ["t"], partitions=8)
    sizes = [r["count"] for r in placed.rows.groupBy(PART).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 4000
