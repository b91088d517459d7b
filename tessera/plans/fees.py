"""The schedule of parameters: reading, building and reconciling it, regimes by time, and the next block's fee."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import core
from tessera.sources import views as V

QUERIES, ORACLES = {}, {}
#: Fixed values of the fee market: cost of an item's gas in execution gas, and the least fee.
ITEM_BASE_COST, LEAST_FEE = 8192, 1
#: since, name, target, cap, fraction, and whether a reserve price holds.
SCHEDULE = [(1704067200 + 86400, "one", 3, 6, 3338477, False), (1704931200, "two", 6, 9, 5007716, False), (1706140800, "three", 10, 15, 8346193, True)]
_SCHEDULE = "(VALUES " + ", ".join(f"({s}, '{n}', {t}, {c}, {f}, {str(r).lower()})" for s, n, t, c, f, r in SCHEDULE) + ") v(since, stage, target, cap, fraction, reserve)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = V.sql(sql)
        return f

    return add


def fake_exponential(numerator: int, denominator: int, factor: int = LEAST_FEE) -> int:
    """factor * e ** (numerator / denominator) in whole numbers, term by term."""
    i, out, term = 1, 0, factor * denominator
    while term > 0:
        out += term
        term = term * numerator // (denominator * i)
        i += 1
    return out // denominator


def _fees(excess: pd.Series, fraction: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(e) or pd.isna(f) or f <= 0 else str(fake_exponential(int(e), int(f))) for e, f in zip(excess, fraction, strict=True)], dtype=object)


def fee_of(excess: str, fraction: str) -> Column:
    """The item fee at an excess as text, exact beyond 64 bits; null without a fraction."""
    return F.pandas_udf(_fees, "string")(excess, fraction)


def staged(spark, blocks: DataFrame, at: str = "t") -> DataFrame:
    """Blocks with the parameters in force at ``at``; null before the first boundary. The schedule has a handful of rows."""
    i = core.asof_intervals(spark.createDataFrame(SCHEDULE, "since long, stage string, target long, cap long, fraction long, reserve boolean"), "since")
    return blocks.join(F.broadcast(i), (F.col(at) >= i.since) & (F.col(at) < i.until), "left").drop("since", "until")


@query("q60_fork_stage", f"SELECT b.block_number, coalesce(p.stage, 'before') AS stage FROM blocks b ASOF LEFT JOIN (SELECT * FROM {_SCHEDULE}) p ON b.t >= p.since")
def q60(spark, d):
    return staged(spark, V.blocks(spark, d)).select("block_number", F.coalesce("stage", F.lit("before")).alias("stage"))


Q59_SQL = f"""WITH RECURSIVE b AS (SELECT b.block_number, b.base_fee, b.excess, CAST(b.items * 131072 AS BIGINT) AS used, p.target, p.cap, p.fraction, p.reserve FROM (SELECT *, t + 12 AS t2 FROM blocks) b ASOF LEFT JOIN (SELECT * FROM {_SCHEDULE}) p ON b.t2 >= p.since),
    e1(n, f, i, o, a) AS (SELECT DISTINCT CAST(excess AS HUGEINT), fraction, 1, CAST(0 AS HUGEINT), CAST(fraction AS HUGEINT) FROM b WHERE fraction IS NOT NULL UNION ALL SELECT n, f, i + 1, o + a, a * n // (CAST(f AS HUGEINT) * i) FROM e1 WHERE a > 0),
    f1 AS (SELECT n, f, o // f AS fee FROM e1 WHERE a = 0),
    c AS (SELECT b.*, CASE WHEN excess + used < target * 131072 THEN 0 WHEN reserve AND CAST(8192 AS HUGEINT) * base_fee > 131072 * f1.fee THEN excess + used * (cap - target) // cap ELSE excess + used - target * 131072 END AS next_excess FROM b LEFT JOIN f1 ON f1.n = b.excess AND f1.f = b.fraction),
    e2(n, f, i, o, a) AS (SELECT DISTINCT CAST(next_excess AS HUGEINT), fraction, 1, CAST(0 AS HUGEINT), CAST(fraction AS HUGEINT) FROM c WHERE fraction IS NOT NULL UNION ALL SELECT n, f, i + 1, o + a, a * n // (CAST(f AS HUGEINT) * i) FROM e2 WHERE a > 0),
    f2 AS (SELECT n, f, o // f AS fee FROM e2 WHERE a = 0)
    SELECT block_number, CASE WHEN fraction IS NULL THEN NULL ELSE next_excess END AS next_excess, coalesce(CAST(f2.fee AS VARCHAR), '1') AS next_fee FROM c LEFT JOIN f2 ON f2.n = c.next_excess AND f2.f = c.fraction"""


def with_fee(rows: DataFrame, excess: str, name: str) -> DataFrame:
    """``rows`` with the fee at an excess and ``fraction``. There are few distinct pairs, so each is computed once and joined back."""
    pairs = rows.select(excess, "fraction").where(f"{excess} IS NOT NULL AND fraction IS NOT NULL").distinct()
    return rows.join(pairs.withColumn(name, fee_of(excess, "fraction")), [excess, "fraction"], "left")


def next_fees(spark, blocks: DataFrame) -> DataFrame:
    """``blocks`` with next_excess and next_fee."""
    b = core.cut(staged(spark, blocks.withColumn("t2", F.col("t") + 12), "t2").withColumn("used", F.col("items") * V.ITEM))
    spare = F.expr("excess + used * (cap - target) div cap")
    sum_, goal = F.col("excess") + F.col("used"), F.col("target") * V.ITEM
    reserved = F.col("reserve") & (F.col("base_fee").cast("decimal(20,0)") * F.lit(ITEM_BASE_COST).cast("decimal(10,0)") > (F.col("now").cast(V.WEI).cast("decimal(28,0)") * F.lit(V.ITEM).cast("decimal(9,0)")))
    after = with_fee(b, "excess", "now").withColumn("next_excess", F.when(F.col("fraction").isNull(), F.lit(None)).when(sum_ < goal, 0).when(reserved, spare).otherwise(sum_ - goal).cast("long"))
    return with_fee(after, "next_excess", "next_fee").withColumn("next_fee", F.coalesce("next_fee", F.lit(str(LEAST_FEE))))


@query("q59_next_fee", Q59_SQL)
def q59(spark, d):
    """The fee of the block that follows each one, under the schedule of its time. The excess falls by the target,
    or, where a reserve price from the execution fee holds, grows by the part of use above it. Before the
    schedule begins the least fee is taken."""
    return next_fees(spark, V.blocks(spark, d)).select("block_number", "next_excess", "next_fee")


_NOTED = "(SELECT 1700000000 + (n_nationkey % 20) * 864000 AS since, n_nationkey % 7 - 1 AS target, n_nationkey % 7 + n_regionkey - 1 AS cap, CASE WHEN n_nationkey % 11 = 0 THEN 0 ELSE 3338477 + n_regionkey * 100 END AS fraction, n_nationkey AS id FROM nation)"


def noted(spark, d) -> DataFrame:
    n = V.read(spark, d, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    return n.select((F.lit(1700000000) + (k % 20) * 864000).cast("long").alias("since"), (k % 7 - 1).cast("long").alias("target"), (k % 7 + r - 1).cast("long").alias("cap"), F.when(k % 11 == 0, 0).otherwise(3338477 + r * 100).cast("long").alias("fraction"), k.cast("long").alias("id"))


def read_schedule(rows: DataFrame) -> DataFrame:
    """Valid boundaries, one a time: targets above 0, caps not below them, fractions other than 0; of several of
    one time the last noted."""
    fine = rows.where("target > 0 AND cap >= target AND fraction > 0")
    return fine.groupBy("since").agg(F.max_by(F.struct("target", "cap", "fraction"), "id").alias("p")).select("since", "p.*")


_READ = f"SELECT since, target, cap, fraction FROM (SELECT *, row_number() OVER (PARTITION BY since ORDER BY id DESC) AS rn FROM {_NOTED} WHERE target > 0 AND cap >= target AND fraction > 0) WHERE rn = 1"


@query("src5_read_schedule", _READ)
def src5(spark, d):
    return read_schedule(noted(spark, d))


NOW = 1700000000 + 9 * 864000


def reconcile(stored: DataFrame, advertised: DataFrame, now: int) -> DataFrame:
    """Stored boundaries after a look at what is advertised: advertised ones are put in or replaced, future ones
    that nobody advertises any more go, past ones stay."""
    kept = stored.join(advertised.select("since"), "since", "left_anti").where(F.col("since") <= now)
    return kept.unionByName(advertised)


@query("mnt17_schedule_reconcile", f"WITH r AS ({_READ}), s AS (SELECT since, target, cap, fraction FROM r WHERE since % 3 <> 0), a AS (SELECT since, target + 1 AS target, cap + 1 AS cap, fraction FROM r WHERE since % 2 = 0 AND target % 2 = 0) SELECT * FROM s WHERE since <= {NOW} AND since NOT IN (SELECT since FROM a) UNION ALL SELECT * FROM a")
def mnt17(spark, d):
    r = read_schedule(noted(spark, d))
    return reconcile(r.where("since % 3 <> 0"), r.where("since % 2 = 0 AND target % 2 = 0").withColumns({"target": F.col("target") + 1, "cap": F.col("cap") + 1}), NOW)


def build(base: DataFrame, learned: DataFrame, most: int = 7) -> DataFrame:
    """One schedule of compiled and learned boundaries: learned ones win at equal times, those that change nothing
    fall to the one before, and the newest ``most`` stay. ``reserve_from`` is the third of all times, before any
    fall together. A schedule holds tens of rows, so one ordering sees it whole."""
    merged = base.join(learned.select("since"), "since", "left_anti").unionByName(learned)
    order = Window.orderBy("since")
    own = F.struct("target", "cap", "fraction")
    rows = merged.withColumn("n", F.row_number().over(order)).withColumn("same", F.lag(own).over(order).eqNullSafe(own))
    third = rows.agg(F.max(F.when(F.col("n") == 3, F.col("since"))).alias("reserve_from")).withColumn("_one", F.lit(1))
    kept = rows.where("NOT same").orderBy(F.desc("since")).limit(most).withColumn("_one", F.lit(1))
    return kept.join(F.broadcast(third), "_one").select("since", "target", "cap", "fraction", "reserve_from")


@query("mnt18_schedule_build", f"WITH r AS ({_READ}), base AS (SELECT since, target % 2 + 1 AS target, 6 AS cap, 3338477 AS fraction FROM r WHERE since % 3 <> 1), learned AS (SELECT since, target % 3 + 1 AS target, 6 AS cap, 3338477 AS fraction FROM r WHERE since % 3 <> 0), m AS (SELECT * FROM base WHERE since NOT IN (SELECT since FROM learned) UNION ALL SELECT * FROM learned), o AS (SELECT *, row_number() OVER (ORDER BY since) AS n, (target, cap, fraction) IS NOT DISTINCT FROM lag((target, cap, fraction)) OVER (ORDER BY since) AS same FROM m) SELECT since, CAST(target AS BIGINT) AS target, CAST(cap AS BIGINT) AS cap, CAST(fraction AS BIGINT) AS fraction, (SELECT since FROM o WHERE n = 3) AS reserve_from FROM o WHERE NOT same OR n = 1 ORDER BY since DESC LIMIT 7")
def mnt18(spark, d):
    r = read_schedule(noted(spark, d))
    made = lambda rows, n: rows.withColumns({"target": F.col("target") % n + 1, "cap": F.lit(6).cast("long"), "fraction": F.lit(3338477).cast("long")})
    return build(made(r.where("since % 3 <> 1"), 2), made(r.where("since % 3 <> 0"), 3))
