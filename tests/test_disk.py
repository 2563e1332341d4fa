"""What queries lay down in the shared folder, against the size of the tables they read."""

from pathlib import Path

import pytest

from workload import QUERIES


def laid_down(spark, run):
    """What ``run`` returns, and the bytes of the files that came into the shared folder meanwhile."""
    kept = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {f for f in kept.rglob("*") if f.is_file()}
    made = run()
    return made, sum(f.stat().st_size for f in kept.rglob("*") if f.is_file() and f not in before)


@pytest.mark.parametrize("name", ["json_file_tables", "stream_scores"])
def test_copies_are_bounded_by_the_input(spark, tiny, name):
    read = sum(Path(tiny, f"{t}.parquet").stat().st_size for t in ("customer", "lineitem", "orders"))
    rows, copies = laid_down(spark, lambda: QUERIES[name](spark, tiny).collect())
    assert rows and copies < 4 * read


def test_child_rows_without_key_or_item_stay_as_they_were(spark, tmp_path):
    from workload.model_queries import payload_rows

    lines = "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE"
    made = {
        "orders": spark.createDataFrame(
            [(1, 7, "O", 120000.0, "1-URGENT"), (2, 7, "F", 10.0, "5-LOW")],
            "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING",
        ).selectExpr("*", "TIMESTAMP_NTZ'1995-01-01 00:00:00' AS o_orderdate"),
        "lineitem": spark.createDataFrame(
            [(1, 1, 5.0, 0.1, 0.0), (1, None, 5.0, 0.1, 0.0), (None, 3, 5.0, 0.1, 0.0), (1, 1, 5.0, 0.1, 0.0)], lines
        ).selectExpr("*", "'A' AS l_returnflag", "'O' AS l_linestatus"),
        "customer": spark.createDataFrame(
            [(7, 1, 100.0, "BUILDING")], "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
        ),
        "nation": spark.createDataFrame([(1, 2)], "n_nationkey INT, n_regionkey INT"),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r.referral[0].referralinstanceid: r for r in payload_rows(spark, str(tmp_path)).where("referral IS NOT NULL").collect()}
    issues = [(i.referralinstanceid, i.clientissueid) for i in found[1].referralissue]
    assert sorted(issues, key=str) == [(1, 1), (1, 1), (1, None)] and found[2].referralissue is None


def cells_differ(spark, dense, sparse):
    from workload.model_queries import _CELLS_DIFFER, _by_event

    kind = "referral_referralinstanceid INT, cells ARRAY<STRUCT<i: INT, v: DOUBLE>>"
    a, b = (_by_event(spark.createDataFrame(rows, kind), s) for rows, s in ((dense, "a"), (sparse, "b")))
    joined = a.join(b, "referral_referralinstanceid", "left")
    found = joined.selectExpr("referral_referralinstanceid AS id", f"{_CELLS_DIFFER} AS wrong").collect()
    return {r.id for r in found if r.wrong}


def test_cells_are_compared_by_place(spark):
    dense = [(1, [(0, 1.0), (3, 2.0)]), (2, [(0, 1.0)]), (3, [(0, 1.0)]), (4, []), (5, [(1, 1.0)]), (6, [(-1, 1.0)]), (7, [])]
    sparse = [(1, [(0, 1.0), (3, 2.0 + 1e-12)]), (2, [(0, 1.1)]), (3, [(1, 1.0)]), (4, [(0, 1.0)]), (6, [(0, 1.0)])]
    assert cells_differ(spark, dense, sparse) == {2, 3, 4, 5, 6}
    # Rows of one event: every cell of a place against every other one of it.
    twice = [(1, [(0, 1.0)]), (1, [(0, 1.0)]), (2, [(0, 1.0)]), (2, [(0, 2.0)]), (3, [(0, 1.0)]), (3, [(1, 1.0)])]
    assert cells_differ(spark, twice, twice) == {2}
