"""What the streams of ``tessera.streaming`` come to, computed from tables in one go, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.registrar import registrar
from tessera.sources import views as V

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)
DAY = 86400
LATE = 2 * DAY
#: Some items reach the stream days after their time: after one day, or after four.
_ARRIVAL = f"t + CASE block_number % 23 WHEN 3 THEN {4 * DAY} WHEN 8 THEN {DAY} ELSE 0 END"


def live_rollups(rows: DataFrame, late: int = LATE) -> DataFrame:
    """Items (actor, t, and the number of the batch that brought them) per grain, bucket and actor, as the live rollups hold
    them in the end: hours and more count all, minutes leave out what came later than ``late`` behind the newest
    item of the batches up to the last but one, which is the watermark that Spark holds rows against."""
    newest = rows.groupBy("batch").agg(F.max("t").alias("m"))
    before = newest.withColumn("mark", F.max("m").over(Window.partitionBy(F.lit(0)).orderBy("batch").rowsBetween(Window.unboundedPreceding, -2)) - late).select("batch", "mark")
    marked = rows.join(before, "batch")
    grains = F.filter(F.array(*(F.when(F.lit(g > 60) | F.col("mark").isNull() | (F.col("t") - F.pmod("t", F.lit(60)) + 60 > F.col("mark")), F.lit(g)) for g in (60, 3600, 21600, DAY))), lambda g: g.isNotNull())
    each = marked.withColumn("seconds", F.explode(grains)).withColumn("bucket", F.col("t") - F.pmod("t", "seconds"))
    return each.groupBy("seconds", "bucket", "actor").agg(F.count(F.lit(1)).alias("items"))


@query("t1_live_rollups", f"""WITH a AS (SELECT actor, t, ({_ARRIVAL}) // {DAY} AS batch FROM facts),
m AS (SELECT batch, max(max(t)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - {LATE} AS mark FROM a GROUP BY batch)
SELECT g AS seconds, t - t % g AS bucket, actor, count(*) AS items FROM a JOIN m USING (batch), (SELECT unnest([60, 3600, 21600, {DAY}]) AS g)
WHERE g > 60 OR mark IS NULL OR t - t % 60 + 60 > mark GROUP BY 1, 2, 3""")
def t1(spark, d):
    """Live rollups after a day's arrivals a batch. The window over batches has a row a day."""
    return live_rollups(V.facts(spark, d).select("actor", "t", F.floor(F.expr(_ARRIVAL) / DAY).alias("batch")))


def promotion_observations(spark, d) -> DataFrame:
    """Pending transactions as they were seen, and every fifth one confirmed in the next block; a third of those
    were never seen before."""
    p = V.pending(spark, d)
    at, n = F.timestamp_seconds("seen"), F.floor((F.col("seen") - V.START) / V.STEP) + 1
    seen = p.where("event_id % 15 <> 0").select(F.lit("seen").alias("kind"), "tx_hash", "actor", "nonce", "max_fee", "tip", at.alias("at"), F.lit(None).cast("long").alias("block_number"), "items")
    done = p.where("event_id % 5 = 0").select(F.lit("confirmed").alias("kind"), "tx_hash", "actor", "nonce", "max_fee", "tip", F.timestamp_seconds(V.block_time(n)).alias("at"), n.cast("long").alias("block_number"), "items")
    return seen.unionByName(done)


def promoted(observed: DataFrame) -> DataFrame:
    """The first confirmation of each sender's nonce, with its own first sight if it was under way until then, and
    else with the transaction that it displaced. Sights and confirmations of one moment: confirmed first, then by hash."""
    keyed = observed.withColumn("slot", F.coalesce(F.col("nonce").cast("string"), "tx_hash"))
    order = F.struct("at", "kind", "tx_hash")
    first = keyed.where("kind = 'confirmed'").groupBy("actor", "slot").agg(F.min_by(F.struct("tx_hash", "at", "block_number", "items", "max_fee", "tip"), order).alias("c"), F.min(order).alias("o"))
    sights = keyed.where("kind = 'seen'").join(first, ["actor", "slot"]).where(order < F.col("o"))
    last = sights.groupBy("actor", "slot").agg(F.max_by(F.struct("tx_hash", "at", "max_fee", "tip"), order).alias("s"))
    both = first.join(last, ["actor", "slot"], "left")
    own = F.coalesce(F.col("s.tx_hash") == F.col("c.tx_hash"), F.lit(False))
    other = lambda c: F.when(~own, F.col(f"s.{c}"))
    return both.select("c.tx_hash", "c.block_number", "c.items", "c.max_fee", "c.tip", F.when(own, F.col("s.at")).alias("first_seen"), other("tx_hash").alias("evicted"), other("max_fee").alias("evicted_max_fee"), other("tip").alias("evicted_tip"))


@query("t5_promotion", """WITH o AS (
    SELECT 'seen' AS kind, tx_hash, actor, coalesce(CAST(nonce AS VARCHAR), tx_hash) AS slot, max_fee, tip, seen AS moment, NULL AS block_number, items FROM pending WHERE event_id % 15 <> 0
    UNION ALL SELECT 'confirmed', tx_hash, actor, coalesce(CAST(nonce AS VARCHAR), tx_hash), max_fee, tip, 1704067200 + ((seen - 1704067200) // 720 + 2) * 720, (seen - 1704067200) // 720 + 1, items FROM pending WHERE event_id % 5 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY actor, slot ORDER BY moment, tx_hash) AS r FROM o WHERE kind = 'confirmed'),
s AS (SELECT o.*, row_number() OVER (PARTITION BY o.actor, o.slot ORDER BY o.moment DESC, o.tx_hash DESC) AS r FROM o JOIN c ON c.r = 1 AND c.actor = o.actor AND c.slot = o.slot AND o.kind = 'seen' AND o.moment < c.moment)
SELECT c.tx_hash, c.block_number, c.items, c.max_fee, c.tip, CASE WHEN s.tx_hash = c.tx_hash THEN s.moment END AS first_seen, CASE WHEN s.tx_hash <> c.tx_hash THEN s.tx_hash END AS evicted,
    CASE WHEN s.tx_hash <> c.tx_hash THEN s.max_fee END AS evicted_max_fee, CASE WHEN s.tx_hash <> c.tx_hash THEN s.tip END AS evicted_tip
FROM c LEFT JOIN s ON s.r = 1 AND s.actor = c.actor AND s.slot = c.slot WHERE c.r = 1""")
def t5(spark, d):
    return promoted(promotion_observations(spark, d)).withColumn("first_seen", F.unix_seconds("first_seen"))
