"""Every registered query against its SQL in DuckDB."""

import glob
import numbers
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or v is pd.NA or v != v else (float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool | np.bool_) else str(v))
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_no_cartesian_products(spark):
    for name in ("q12_top_actors_windowed", "t6_missed_snapshot", "j7_claim_range_join"):
        assert "CartesianProduct" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


RANGED = [n for n in catalog.QUERIES if re.match(r"q(12|14|16|18|25|26|27|29|3[0-9]|40|41|43)_", n)] + ["mnt8_rollup_backfill", "mnt24_last_seen_touch"]


@pytest.mark.parametrize("name", RANGED)
def test_time_ranges_reach_the_scan(spark, name):
    """Every scan of the events' times is bounded from below, so history outside the range isn't read."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    try:
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [x for x in plan.split("\n") if "FileScan parquet" in x and re.search(r"FileScan parquet \[[^\]]*\bts#", x)]
    assert scans
    for scan in scans:
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", scan), scan


def test_plans_have_no_products_of_tables(spark):
    """Joins of tables are joins of equality; nested loops are left to broadcast one-row sides and schedules."""
    for name in ("q47_inclusion_summary", "q48_inclusion_timeline", "q58_classify_lookup", "f5_prefix_search", "mnt15_missed_repair", "q42_producer_leaderboard"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct", plan), name
        if name in ("f5_prefix_search", "q48_inclusion_timeline", "mnt15_missed_repair"):
            assert not re.search("BroadcastNestedLoopJoin", plan), name


def test_gate_waits_for_missing_predecessors(spark):
    """Every block is asked; those behind a gap aren't ready."""
    got = {r.block_number: r.ready for r in catalog.QUERIES["t7_ordered_gate"](spark, SF).collect()}
    assert sorted(got) == list(range(max(got) + 1))
    missing = {n for n in got if n % 17 == 16}
    assert missing and got == {n: n >= 5 and not missing & set(range(n - 5, n)) for n in got}
