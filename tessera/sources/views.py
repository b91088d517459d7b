"""Canonical views of block data derived from the given tables, in Spark and as SQL text.

One block per 720 seconds. Times are epoch seconds, exact
amounts are DECIMAL(38,0). Views over time take a half-open range [first, last) of block times, which
becomes a range of the stored ``ts``, so that files and row groups outside it are not read.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, STEP = 1704067200, 720
ITEM = 131072
TARGET, MAX = 3, 6
AS_OF = 1706659200
WEI = "decimal(38,0)"
#: Seconds that a pending item lives and that it must have been seen for; blocks opened at once.
LIFE, MIN_AGE, CHUNK = 3600, 60, 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def block_time(b: Column) -> Column:
    return F.lit(START) + (b + 1) * STEP


def block_range(first: int | None, last: int | None) -> tuple[int | None, int | None]:
    """First block at or after ``first`` and first block at or after ``last``."""
    at = lambda t: None if t is None else max(0, -(-(t - START) // STEP) - 1)
    return at(first), at(last)


def _events(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    moment = lambda b: f"TIMESTAMP_NTZ '{datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=b * STEP)}'"
    lo, hi = block_range(first, last)
    limits = ([] if lo is None else [f"ts >= {moment(lo)}"]) + ([] if hi is None else [f"ts < {moment(hi)}"])
    if limits:
        rows = rows.where(" AND ".join(limits))
    us = "unix_micros(CAST(ts AS TIMESTAMP))"
    return rows.selectExpr("event_id", "CAST(user_id AS BIGINT) AS user_id", "event_type", f"CAST(floor({us} / 1000000) AS BIGINT) AS s", f"CAST(floor(({us} - {START * 1_000_000}) / {STEP * 1_000_000}) AS BIGINT) AS b")


def facts(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row per item."""
    rows = _events(spark, sf_dir, first, last).where("event_type <> 'error'")
    fee = "1000000007 * (1 + b % 97)"
    return rows.selectExpr(
        "b AS block_number",
        "CAST(row_number() OVER (PARTITION BY b ORDER BY event_id) - 1 AS BIGINT) AS item_index",
        "concat('tx-', user_id, '-', b) AS tx_hash", "concat('vh-', event_id - event_id % 3) AS content_hash",
        "concat('0xS', user_id) AS actor",
        "CASE WHEN user_id % 4 = 1 THEN concat('Label ', user_id % 5) WHEN user_id % 20 = 2 THEN '  ' ELSE '' END AS label",
        f"{fee} AS fee", f"CAST({fee} * {ITEM} AS {WEI}) AS cost", f"{START} + (b + 1) * {STEP} AS t",
        "CASE WHEN b % 8 <> 0 THEN 500000000 + (user_id % 17) * 250000000 END AS tip",
        "CASE WHEN (user_id + b) % 11 <> 0 THEN min(s) OVER (PARTITION BY b, user_id) END AS seen",
    )


def blocks(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row per block, empty ones included. Numbers are opened in chunks, dealt out before that."""
    lo, hi = block_range(first, last)
    low = lo or 0
    counts = _events(spark, sf_dir, first, last).groupBy("b").agg(F.expr("count_if(event_type <> 'error') AS c"))
    if hi is None:  # the newest number comes from the counts, by the same exchange (which needs the same columns)
        top = counts.agg(F.expr("max(CASE WHEN c >= 0 THEN b END) AS m"))
    else:
        top = _events(spark, sf_dir, first).agg(F.expr(f"least(max(b), {hi - 1}) AS m"))
    chunks = top.where(f"m >= {low}").selectExpr("m", f"explode(sequence({low // CHUNK}L, m div {CHUNK})) AS chunk").repartition("chunk")
    spine = chunks.selectExpr(f"explode(sequence(greatest(chunk * {CHUNK}, {low}), least(m, chunk * {CHUNK} + {CHUNK - 1}))) AS b")
    return spine.join(counts, "b", "left").selectExpr(
        "b AS block_number", f"{START} + (b + 1) * {STEP} AS t", "CAST(coalesce(c, 0) AS BIGINT) AS items", "1000000007 * (1 + b % 97) AS fee",
        "CAST(CASE WHEN b % 13 = 0 OR floor(b / 50) % 7 = 3 THEN 0 ELSE 20000000000 + (b % 29) * 1000000007 END AS BIGINT) AS base_fee",
        f"CAST(CASE WHEN b % 3 = 0 THEN {ITEM * TARGET} ELSE 0 END AS BIGINT) AS target_gas", f"CAST(CASE WHEN b % 3 = 0 THEN {ITEM * MAX} ELSE 0 END AS BIGINT) AS limit_gas",
        f"CAST(CASE WHEN b % 5 = 0 THEN 0 ELSE {TARGET} END AS BIGINT) AS params_target", f"CAST(CASE WHEN b % 5 = 0 THEN 0 ELSE {MAX} END AS BIGINT) AS params_max",
        "CAST((b % 211) * 400000 AS BIGINT) AS excess",
    )


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of which every seventeenth is missing, for what looks for gaps."""
    return blocks(spark, sf_dir).where("block_number % 17 <> 16")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known actors: customers of all market segments but one."""
    c, n, r = (read(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    rows = c.where("c_mktsegment <> 'FURNITURE'").join(n, F.expr("c_nationkey = n_nationkey")).join(r, F.expr("n_regionkey = r_regionkey"))
    return rows.selectExpr("lower(concat('0xS', c_custkey)) AS address", "concat('Rollup ', n_name) AS name", "r_name AS category")


def producers(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    s, b = read(spark, sf_dir, "supplier"), blocks(spark, sf_dir, first, last)
    pay = f"CASE WHEN block_number % 5 <> 0 THEN CAST({10**18} AS {WEI}) + CAST(block_number % 1000 AS {WEI}) * CAST({10**15 + 1} AS {WEI}) END"
    return b.join(s, F.expr("block_number % 10 = s_suppkey")).selectExpr("block_number", "t", "items", "s_name AS producer", "concat('0xP', block_number % 3, '-', s_suppkey) AS recipient", f"CAST({pay} AS {WEI}) AS payment", "fee")


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap, items = "CASE WHEN event_id % 9 <> 0 THEN 1000000007 * (1 + event_id % 120) END", "CAST(1 + event_id % 6 AS BIGINT)"
    nonce = "CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / (2 + user_id % 4)) AS BIGINT)"
    return _events(spark, sf_dir).where("event_type = 'error'").selectExpr(
        "concat('px-', event_id) AS tx_hash", "concat('vh-', event_id - event_id % 3) AS content_hash", "concat('0xS', user_id) AS actor", f"CASE WHEN event_id % 41 <> 0 THEN {nonce} END AS nonce", f"{items} AS items",
        f"{cap} AS max_fee", "CASE WHEN event_id % 19 <> 0 THEN 15000000000 + (event_id % 40) * 1000000000 END AS max_exec", "CASE WHEN event_id % 7 <> 0 THEN 500000000 + (event_id % 23) * 100000000 END AS tip",
        "s AS seen", f"CAST(CAST({items} AS DECIMAL(10,0)) * CAST({ITEM} AS DECIMAL(10,0)) * CAST(coalesce({cap}, 0) AS DECIMAL(18,0)) AS {WEI}) AS cost", "event_id",
    )


def reason(age: Column, nonce: Column, lowest: Column, max_fee: Column, fee: Column, max_exec: Column, base_fee: Column, wanted: Column, items: Column) -> Column:
    """Why a block left a pending item out; the first rule that holds wins. An unknown cap, or a block's
    execution fee of 0 (not recorded), is never below."""
    rules = F.when(age < MIN_AGE, "too_recent").when(nonce > lowest, "nonce_gap").when(max_fee < fee, "priced_out_item_fee")
    return rules.when((base_fee > 0) & (max_exec < base_fee), "priced_out_exec_fee").when(items + wanted > MAX, "no_room").otherwise("eligible")


def missed(p: DataFrame, b: DataFrame) -> DataFrame:
    """Pending items and the blocks that they lived through without being taken. Pending rows go to the
    block-time slots of their life (at most six), so the interval join is an equality join."""
    lowest = p.groupBy("actor").agg(F.min("nonce").alias("lowest"))  # not a window: a busy sender would be one task
    slots = p.join(lowest, "actor").selectExpr("tx_hash", "actor", "nonce", "lowest", "items AS wanted", "max_fee", "max_exec", "tip", "seen", f"explode(sequence(floor(seen / {STEP}), floor((seen + {LIFE}) / {STEP}))) AS slot")
    held = slots.join(b.selectExpr("block_number", "t", "items", "fee", "base_fee", f"floor(t / {STEP}) AS slot"), "slot").where(f"seen <= t AND t < seen + {LIFE}")
    why = reason(F.col("t") - F.col("seen"), *(F.col(c) for c in ("nonce", "lowest", "max_fee", "fee", "max_exec", "base_fee", "wanted", "items")))
    return held.select("block_number", "t", "tx_hash", "actor", "nonce", "wanted", "tip", "seen", why.alias("reason"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missed(pending(spark, sf_dir), blocks(spark, sf_dir))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with ranges; four of them an address."""
    start = "CAST(c_custkey * 37 % 3000 AS BIGINT)"
    return read(spark, sf_dir, "customer").selectExpr(
        "lower(concat('0xS', floor(c_custkey / 4))) AS address", "concat('Claim ', c_nationkey) AS name", "CAST(c_custkey AS BIGINT) AS claim",
        "CASE c_custkey % 5 WHEN 0 THEN 'disputed' WHEN 1 THEN 'retired' ELSE 'active' END AS status",
        "CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'probable' WHEN 2 THEN 'possible' ELSE '' END AS confidence",
        f"{start} AS valid_from", f"CASE WHEN c_custkey % 2 <> 0 THEN {start} + 400 END AS valid_to",
    )


#: The same views for DuckDB, in an order in which later ones may use earlier ones.
SQL = {
    "ev": "SELECT event_id, CAST(user_id AS BIGINT) AS user_id, event_type, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, CAST((epoch_us(ts) - 1704067200000000) // 720000000 AS BIGINT) AS b FROM events",
    "facts": """SELECT b AS block_number, row_number() OVER (PARTITION BY b ORDER BY event_id) - 1 AS item_index, 'tx-' || user_id || '-' || b AS tx_hash, 'vh-' || (event_id - event_id % 3) AS content_hash, '0xS' || user_id AS actor,
        CASE WHEN user_id % 4 = 1 THEN 'Label ' || (user_id % 5) WHEN user_id % 20 = 2 THEN '  ' ELSE '' END AS label, 1000000007 * (1 + b % 97) AS fee,
        CAST(1000000007 * (1 + b % 97) * 131072 AS DECIMAL(38,0)) AS cost, 1704067200 + (b + 1) * 720 AS t, CASE WHEN b % 8 <> 0 THEN 500000000 + (user_id % 17) * 250000000 END AS tip,
        CASE WHEN (user_id + b) % 11 <> 0 THEN min(s) OVER (PARTITION BY b, user_id) END AS seen FROM ev WHERE event_type <> 'error'""",
    "blocks": """SELECT r.b AS block_number, 1704067200 + (r.b + 1) * 720 AS t, coalesce(c.c, 0) AS items, 1000000007 * (1 + r.b % 97) AS fee,
        CASE WHEN r.b % 13 = 0 OR r.b // 50 % 7 = 3 THEN 0 ELSE 20000000000 + (r.b % 29) * 1000000007 END AS base_fee,
        CAST(CASE WHEN r.b % 3 = 0 THEN 393216 ELSE 0 END AS BIGINT) AS target_gas, CAST(CASE WHEN r.b % 3 = 0 THEN 786432 ELSE 0 END AS BIGINT) AS limit_gas,
        CAST(CASE WHEN r.b % 5 = 0 THEN 0 ELSE 3 END AS BIGINT) AS params_target, CAST(CASE WHEN r.b % 5 = 0 THEN 0 ELSE 6 END AS BIGINT) AS params_max, r.b % 211 * 400000 AS excess
        FROM (SELECT unnest(range(0, (SELECT max(b) FROM ev) + 1)) AS b) r LEFT JOIN (SELECT block_number AS b, count(*) AS c FROM facts GROUP BY 1) c ON r.b = c.b""",
    "indexed": "SELECT * FROM blocks WHERE block_number % 17 <> 16",
    "registry": "SELECT lower('0xS' || c_custkey) AS address, 'Rollup ' || n_name AS name, r_name AS category FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment <> 'FURNITURE'",
    "producers": """SELECT block_number, t, items, s_name AS producer, '0xP' || (block_number % 3) || '-' || s_suppkey AS recipient,
        CASE WHEN block_number % 5 <> 0 THEN CAST(1000000000000000000 AS DECIMAL(38,0)) + CAST(block_number % 1000 AS DECIMAL(18,0)) * CAST(1000000000000001 AS DECIMAL(18,0)) END AS payment, fee
        FROM blocks JOIN supplier ON block_number % 10 = s_suppkey""",
    "pending": """SELECT 'px-' || event_id AS tx_hash, 'vh-' || (event_id - event_id % 3) AS content_hash, '0xS' || user_id AS actor, CASE WHEN event_id % 41 <> 0 THEN n END AS nonce, CAST(1 + event_id % 6 AS BIGINT) AS items,
        cap AS max_fee, CASE WHEN event_id % 19 <> 0 THEN 15000000000 + (event_id % 40) * 1000000000 END AS max_exec, CASE WHEN event_id % 7 <> 0 THEN 500000000 + (event_id % 23) * 100000000 END AS tip, s AS seen,
        CAST((1 + event_id % 6) * 131072 * CAST(coalesce(cap, 0) AS HUGEINT) AS DECIMAL(38,0)) AS cost, event_id
        FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // (2 + user_id % 4) AS n, CASE WHEN event_id % 9 <> 0 THEN 1000000007 * (1 + event_id % 120) END AS cap FROM ev WHERE event_type = 'error')""",
    "candidates": """SELECT b.block_number, b.t, p.tx_hash, p.actor, p.nonce, p.items AS wanted, p.tip, p.seen,
        CASE WHEN b.t - p.seen < 60 THEN 'too_recent' WHEN p.nonce > p.lowest THEN 'nonce_gap' WHEN p.max_fee < b.fee THEN 'priced_out_item_fee'
        WHEN b.base_fee > 0 AND p.max_exec < b.base_fee THEN 'priced_out_exec_fee' WHEN b.items + p.items > 6 THEN 'no_room' ELSE 'eligible' END AS reason
        FROM (SELECT *, min(nonce) OVER (PARTITION BY actor) AS lowest FROM pending) p JOIN blocks b ON p.seen <= b.t AND b.t < p.seen + 3600""",
    "claims": """SELECT lower('0xS' || (c_custkey // 4)) AS address, 'Claim ' || c_nationkey AS name, CAST(c_custkey AS BIGINT) AS claim,
        CASE c_custkey % 5 WHEN 0 THEN 'disputed' WHEN 1 THEN 'retired' ELSE 'active' END AS status,
        CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'probable' WHEN 2 THEN 'possible' ELSE '' END AS confidence,
        CAST(c_custkey * 37 % 3000 AS BIGINT) AS valid_from, CASE WHEN c_custkey % 2 <> 0 THEN CAST(c_custkey * 37 % 3000 + 400 AS BIGINT) END AS valid_to FROM customer""",
}


def sql(body: str) -> str:
    """``body`` (a SELECT, or CTEs and a SELECT) on top of the views."""
    views = ",\n".join(f"{name} AS ({text})" for name, text in SQL.items())
    body = body.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{views},\n{body[len(start):]}"
    return f"WITH {views}\n{body}"
