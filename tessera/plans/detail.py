"""Listings, entity details, per-block charts and figures from rollups."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tessera.functions.exprs import bucket, share, wei_text
from tessera.operators import core
from tessera.plans import fees, tiers
from tessera.plans.charts import _TOP_PRICED, FIRST, LAST, NAMED, RANGE, SAVED, SLUG, WINDOWS, bucketed, hourly_items, named, percent_saved, top_or_other, with_entity
from tessera.plans.records import REPLACED, VC, t4
from tessera.sources import views as V

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = V.sql(sql)
        return f

    return add


@query("q2_items_by_actor", "SELECT block_number, item_index, tx_hash, t FROM facts WHERE actor = '0xS7' ORDER BY t DESC, block_number DESC, item_index LIMIT 100")
def q2(spark, d):
    rows = V.facts(spark, d).where("actor = '0xS7'")
    return rows.orderBy(F.desc("t"), F.desc("block_number"), "item_index").limit(100).select("block_number", "item_index", "tx_hash", "t")


@query("q7_replacements", REPLACED + " SELECT replaced, replacement, actor, nonce, replaced_at FROM r WHERE replacement IS NOT NULL ORDER BY replaced_at DESC, replaced LIMIT 100")
def q7(spark, d):
    return t4(spark, d).orderBy(F.desc("replaced_at"), "replaced").limit(100)


@query("q7_replacements_touching", REPLACED + ", e AS (SELECT * FROM r WHERE replacement IS NOT NULL) SELECT p.tx_hash, e.replaced, e.replacement, e.replaced_at FROM pending p JOIN e ON p.tx_hash IN (e.replaced, e.replacement)")
def q7_touching(spark, d):
    """Every transaction with the replacements that touch it on either side: each replacement goes to both."""
    sides = t4(spark, d).select(F.explode(F.array("replaced", "replacement")).alias("tx_hash"), "replaced", "replacement", "replaced_at")
    return V.pending(spark, d).select("tx_hash").join(sides, "tx_hash")


@query("q9_recent_blocks_pricing", f"SELECT b.block_number, b.t, b.items, b.fee, p.producer, greatest(0, 6 - b.items) AS available, b.items >= 6 AS is_full, coalesce(s.stage, 'before') AS stage, CAST(s.target AS BIGINT) AS stage_target, CAST(s.cap AS BIGINT) AS stage_cap, (SELECT arg_max(fee, block_number) FROM blocks) AS current_fee FROM blocks b LEFT JOIN producers p USING (block_number) ASOF LEFT JOIN (SELECT * FROM {fees._SCHEDULE}) s ON b.t >= s.since ORDER BY b.block_number DESC LIMIT 512")
def q9(spark, d):
    """The newest blocks are taken first, so that the joins see 512 rows of one side."""
    b = V.blocks(spark, d).orderBy(F.desc("block_number")).limit(512)
    rows = fees.staged(spark, b.join(V.producers(spark, d).select("block_number", "producer"), "block_number", "left"))
    now = b.agg(F.max_by("fee", "block_number").alias("current_fee")).withColumn("_one", F.lit(1))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(now), "_one")
    return rows.select("block_number", "t", "items", "fee", "producer", F.greatest(F.lit(0), V.MAX - F.col("items")).alias("available"), (F.col("items") >= V.MAX).alias("is_full"), F.coalesce("stage", F.lit("before")).alias("stage"), F.col("target").alias("stage_target"), F.col("cap").alias("stage_cap"), "current_fee")


TIP = 128
_STEPS, _LAST = fees.Q59_SQL.rsplit("SELECT block_number, CASE", 1)


@query("q10_market_pressure", _STEPS.rstrip() + f""", nf AS (SELECT block_number, CASE{_LAST}), z AS (SELECT * FROM blocks ORDER BY block_number DESC LIMIT {TIP}), l AS (SELECT arg_max(items, block_number) AS newest FROM z)
    SELECT count(*) AS blocks, count(*) FILTER (items > 3) AS above_target, round(CAST(count(*) FILTER (items >= 6) AS DOUBLE) * 100 / count(*), 6) AS at_max_percent, count(*) FILTER (block_number > (SELECT coalesce(max(block_number), -1) FROM z WHERE items < 6)) AS full_run, CASE WHEN (SELECT newest FROM l) > 3 THEN 'up' WHEN (SELECT newest FROM l) < 3 THEN 'down' ELSE 'flat' END AS direction,
    (SELECT CAST(min(CAST(next_fee AS HUGEINT)) AS VARCHAR) FROM nf JOIN z USING (block_number)) AS low_fee, (SELECT CAST(max(CAST(next_fee AS HUGEINT)) AS VARCHAR) FROM nf JOIN z USING (block_number)) AS high_fee FROM z""")
def q10(spark, d):
    """Over the newest blocks: the run of full blocks at the tip is what lies beyond the newest block with room,
    the direction is that of the newest block, and fees are those that each block's successor would have."""
    b = V.blocks(spark, d).orderBy(F.desc("block_number")).limit(TIP)
    rows = core.with_totals(fees.next_fees(spark, b), roomy=F.coalesce(F.max(F.when(F.col("items") < V.MAX, F.col("block_number"))), F.lit(-1)))
    n, newest = F.count(F.lit(1)), F.max_by("items", "block_number")
    at_max = share(F.count_if(F.col("items") >= V.MAX), n)
    way = F.when(newest > V.TARGET, "up").when(newest < V.TARGET, "down").otherwise("flat")
    fee = F.col("next_fee").cast(V.WEI)
    return rows.agg(n.alias("blocks"), F.count_if(F.col("items") > V.TARGET).alias("above_target"), at_max.alias("at_max_percent"), F.count_if(F.col("block_number") > F.col("roomy")).alias("full_run"), way.alias("direction"), wei_text(F.min(fee)).alias("low_fee"), wei_text(F.max(fee)).alias("high_fee"))


def members(spark, d, since: int | None):
    """Registry and history per address; members without items in the window stay with zeros."""
    rows = V.facts(spark, d).withColumn("address", F.lower("actor"))
    inside = F.lit(True) if since is None else F.col("t") >= since
    totals = rows.groupBy("address").agg(F.count_if(inside).alias("items"), F.sum(F.when(inside, F.col("cost"))).alias("cost"))
    r = V.registry(spark, d).select("address", "name", F.lit(True).alias("in_registry"))
    m = r.join(totals, "address", "full_outer").withColumns({"items": F.coalesce("items", F.lit(0)), "cost": F.coalesce("cost", F.lit(0).cast(V.WEI)).cast(V.WEI), "in_registry": F.coalesce("in_registry", F.lit(False))})
    m = m.withColumn("entity", core.entity_key(F.coalesce("name", F.lit("")), F.col("address")))
    whole = m.groupBy("entity").agg(F.sum("items").alias("entity_items"), wei_text(F.sum("cost")).alias("entity_cost"))
    return m.join(whole, "entity").select("entity", "address", "in_registry", "items", wei_text(F.col("cost")).alias("cost"), "entity_items", "entity_cost")


def _members_sql(inside: str) -> str:
    return f"""WITH a AS (SELECT lower(actor) AS address, count(*) FILTER ({inside}) AS items, sum(cost) FILTER ({inside}) AS cost FROM facts GROUP BY 1),
    m AS (SELECT address, r.address IS NOT NULL AS in_registry, coalesce(a.items, 0) AS items, coalesce(a.cost, 0) AS cost, coalesce(nullif({SLUG.format("coalesce(r.name, '')")}, ''), address) AS entity FROM registry r FULL OUTER JOIN a USING (address))
    SELECT entity, address, in_registry, items, {VC.format('m.cost')} AS cost, CAST(sum(items) OVER w AS BIGINT) AS entity_items, {VC.format('sum(m.cost) OVER w')} AS entity_cost FROM m WINDOW w AS (PARTITION BY entity)"""


@query("q22_entity_detail_all", _members_sql("true"))
def q22(spark, d):
    return members(spark, d, None)


@query("q23_entity_detail_windowed", _members_sql(f"t >= {V.AS_OF - 86400}"))
def q23(spark, d):
    return members(spark, d, V.AS_OF - 86400)


def _rolling(spark, d, tier: str, fee: str, p: str, store: str | None = None):
    """Figures of the windows from rollups of a tier: sums, actors from per-actor rows, weighted mean fee,
    and percentiles over the buckets' own percentiles. Rollups come from ``store`` where one is given."""
    inside = F.filter(F.array(*(F.when(F.col("bucket") >= V.AS_OF - n, F.lit(w)) for w, n in WINDOWS.items())), lambda x: x.isNotNull())
    held = tiers.block_tier(spark, d, tier, store, percentiles=True).withColumn("w", F.explode(inside))
    blocks = held.groupBy("w").agg(*(F.sum(c).alias(c) for c in ("blocks", "above_target", "at_max")), F.round(F.sum("items").cast("double") / (F.sum("blocks") * V.TARGET), 6).alias("utilization"))
    middle = core.few_disc_percentiles(held.select("w", F.explode(F.array(F.struct(F.lit("median").alias("what"), F.col("median").alias("v")), F.struct(F.lit("high").alias("what"), F.col(fee).alias("v")))).alias("x")).select("w", "x.what", "x.v"), ["w", "what"], "v", half="0.5", high=p)
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    blocks = blocks.join(middle.groupBy("w").agg(of("median", "half").alias("median_fee"), of("high", "high").alias("p95_fee")), "w")
    i = tiers.item_tier(spark, d, tier, store).withColumn("w", F.explode(inside))
    bytes_ = F.sum("items") * V.ITEM
    items = i.groupBy("w").agg(F.sum("items").alias("items"), bytes_.alias("gas"), wei_text(F.sum("cost")).alias("cost"), F.countDistinct("actor").alias("actors"), F.round(F.sum("cost").cast("double") / bytes_, 3).alias("avg_fee"))
    return blocks.join(items, "w")


def _rolling_sql(seconds: int, fee: str, p: str) -> str:
    windows = "SELECT unnest(['1h', '24h', '7d', '30d']) AS w, unnest([3600, 86400, 604800, 2592000]) AS n"
    inside = f"bucket >= {V.AS_OF} - n AND bucket < {V.AS_OF}"
    return f"""WITH w AS ({windows}), r AS (SELECT t - t % {seconds} AS bucket, count(*) AS blocks, sum(items) AS items, count(*) FILTER (items > 3) AS above_target, count(*) FILTER (items >= 6) AS at_max, quantile_disc(fee, 0.5) AS median, quantile_disc(fee, 0.95) AS p95 FROM blocks GROUP BY 1),
    i AS (SELECT t - t % {seconds} AS bucket, actor, count(*) AS items, sum(cost) AS cost FROM facts GROUP BY 1, 2),
    b AS (SELECT w.w, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(above_target) AS BIGINT) AS above_target, CAST(sum(at_max) AS BIGINT) AS at_max, round(CAST(sum(items) AS DOUBLE) / CAST(sum(blocks) * 3 AS DOUBLE), 6) AS utilization, quantile_disc(median, 0.5) AS median_fee, quantile_disc({fee}, {p}) AS p95_fee FROM w JOIN r ON {inside} GROUP BY 1),
    c AS (SELECT w.w, CAST(sum(items) AS BIGINT) AS items, CAST(sum(items) * 131072 AS BIGINT) AS gas, CAST(CAST(sum(cost) AS DECIMAL(38,0)) AS VARCHAR) AS cost, count(DISTINCT actor) AS actors, round(CAST(sum(cost) AS DOUBLE) / CAST(sum(items) * 131072 AS DOUBLE), 3) AS avg_fee FROM w JOIN i ON {inside} GROUP BY 1) SELECT * FROM b JOIN c USING (w)"""


@query("q26_rolling_fine", _rolling_sql(60, "median", "0.95"))
def q26(spark, d, store: str | None = None):
    """From minute rollups; p95 is the p95 of the minutes' medians."""
    return _rolling(spark, d, "minutes", "median", "0.95", store)


@query("q27_rolling_hourly", _rolling_sql(3600, "p95", "0.5"))
def q27(spark, d, store: str | None = None):
    """From hourly rollups; p95 is the median of the hours' p95s."""
    return _rolling(spark, d, "hourly", "p95", "0.5", store)


_TOP = "top AS (SELECT entity FROM n WHERE entity <> 'unknown' GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 5)"
_SERIES = "CASE WHEN entity IN (SELECT entity FROM top) OR entity = 'unknown' THEN entity ELSE 'other' END AS series"


@query("q33_usage_chart_block", f"WITH {NAMED}, {_TOP} SELECT block_number, {_SERIES}, count(*) AS items FROM n GROUP BY 1, 2")
def q33(spark, d):
    x = top_or_other(named(spark, d), "entity", F.count(F.lit(1)), 5, "series")
    return x.groupBy("block_number", "series").agg(F.count(F.lit(1)).alias("items"))


def _q34_sql(seconds: int) -> str:
    return f"WITH {NAMED}, {_TOP} SELECT t - t % {seconds} AS bucket, {_SERIES}, count(*) AS items FROM n GROUP BY 1, 2"


def q34(spark, d, seconds: int, store: str | None = None):
    """From hourly sums per entity, regrouped; the ranking uses the same sums."""
    hours = with_entity(hourly_items(spark, d, store), V.registry(spark, d)).groupBy("bucket", "entity").agg(F.sum("items").alias("items"))
    x = top_or_other(hours, "entity", F.sum("items"), 5, "series")
    return x.groupBy(bucket(F.col("bucket"), seconds).alias("bucket"), "series").agg(F.sum("items").alias("items"))


for _name, _seconds in (("q34_usage_chart_rollup", 21600), ("q34_usage_chart_rollup_by_days", 86400)):
    query(_name, _q34_sql(_seconds))(functools.partial(q34, seconds=_seconds))


@query("q36_cost_comparison_block", f"WITH j AS (SELECT block_number, items, CAST(fee AS HUGEINT) * items * 131072 AS cost, CAST(items AS HUGEINT) * 131072 * 16 * CASE WHEN base_fee > 0 THEN base_fee ELSE fee END AS alternative FROM blocks WHERE {RANGE}) SELECT block_number, items, CAST(cost AS VARCHAR) AS cost, CAST(alternative AS VARCHAR) AS alternative, CAST(alternative - cost AS VARCHAR) AS savings, {SAVED.format(a='alternative', c='cost')} AS savings_percent FROM j")
def q36(spark, d):
    """A block without an execution fee is priced at its item fee."""
    gas = (F.col("items") * V.ITEM).cast("decimal(18,0)")
    own = F.when(F.col("base_fee") > 0, F.col("base_fee")).otherwise(F.col("fee")).cast("decimal(18,0)")
    rows = bucketed(V.blocks, spark, d).withColumns({"c": (gas * F.col("fee").cast("decimal(18,0)")).cast(V.WEI), "a": ((gas * 16).cast("decimal(18,0)") * own).cast(V.WEI)})
    a, c = F.col("a"), F.col("c")
    return rows.select("block_number", "items", wei_text(c).alias("cost"), wei_text(a).alias("alternative"), wei_text(a - c).alias("savings"), percent_saved(a, c).alias("savings_percent"))


def _q37_sql(seconds: int) -> str:
    return f"WITH b AS (SELECT t - t % {seconds} AS bucket, sum(base_fee) AS s, count(*) FILTER (base_fee > 0) AS n FROM blocks WHERE {RANGE} GROUP BY 1), f AS (SELECT t - t % {seconds} AS bucket, count(*) AS items, CAST(sum(cost) AS HUGEINT) AS cost FROM facts WHERE {RANGE} GROUP BY 1), j AS (SELECT bucket, coalesce(items, 0) AS items, coalesce(cost, 0) AS cost, CASE WHEN n > 0 THEN CAST(coalesce(items, 0) AS HUGEINT) * 131072 * 16 * ((2 * s + n) // (2 * n)) ELSE 16 * coalesce(cost, 0) END AS alternative FROM b LEFT JOIN f USING (bucket)) SELECT bucket, CAST(items AS BIGINT) AS items, {VC.format('cost')} AS cost, {VC.format('alternative')} AS alternative, {SAVED.format(a='alternative', c='cost')} AS savings_percent FROM j"


def q37(spark, d, seconds: int, store: str | None = None):
    """From hourly sums: the mean fee over blocks with one is a ratio of sums, rounded in whole numbers; a
    point without one takes the items' own fees."""
    if store:
        hours = tiers.stored(spark, store, "blocks", "hourly", FIRST, LAST).select("bucket", F.col("fee_sum").alias("s"), F.col("fee_blocks").alias("n"))
    else:
        hours = bucketed(V.blocks, spark, d, 3600).groupBy("bucket").agg(F.sum("base_fee").alias("s"), F.count_if(F.col("base_fee") > 0).alias("n"))
    costs = hourly_items(spark, d, store).groupBy("bucket").agg(F.sum("items").alias("items"), F.sum("cost").cast(V.WEI).alias("cost"))
    six = bucket(F.col("bucket"), seconds).alias("bucket")
    b, f = hours.groupBy(six).agg(F.sum("s").alias("s"), F.sum("n").alias("n")), costs.groupBy(six).agg(F.sum("items").alias("items"), F.sum("cost").cast(V.WEI).alias("c"))
    rows = b.join(f, "bucket", "left").withColumns({"items": F.coalesce("items", F.lit(0)), "c": F.coalesce("c", F.lit(0).cast(V.WEI)).cast(V.WEI)})
    priced = ((F.col("items") * V.ITEM * 16).cast("decimal(18,0)") * F.expr("(2 * s + n) div nullif(2 * n, 0)").cast("decimal(18,0)")).cast(V.WEI)
    own = (F.col("c").cast("decimal(30,0)") * F.lit(16).cast("decimal(2,0)")).cast(V.WEI)
    a, c = F.col("a"), F.col("c")
    return rows.withColumn("a", F.when(F.col("n") > 0, priced).otherwise(own)).select("bucket", "items", wei_text(c).alias("cost"), wei_text(a).alias("alternative"), percent_saved(a, c).alias("savings_percent"))


for _name, _seconds in (("q37_cost_comparison_rollup", 21600), ("q37_cost_comparison_rollup_by_days", 86400)):
    query(_name, _q37_sql(_seconds))(functools.partial(q37, seconds=_seconds))


@query("q39_tips_chart_block", f"SELECT block_number, count(*) AS total, count(tip) AS priced, round(avg(tip), 2) AS avg_tip, quantile_disc(tip, 0.5) AS median_tip, quantile_disc(tip, 0.95) AS p95_tip, max(tip) AS max_tip FROM facts WHERE {RANGE} GROUP BY 1")
def q39(spark, d):
    f = bucketed(V.facts, spark, d)
    stats = f.groupBy("block_number").agg(F.count(F.lit(1)).alias("total"), F.count("tip").alias("priced"), F.round(F.avg("tip"), 2).alias("avg_tip"), F.max("tip").alias("max_tip"))
    return stats.join(core.disc_percentiles(f, ["block_number"], "tip", median_tip="0.5", p95_tip="0.95"), "block_number", "left")


@query("q39_tips_series_by_entity_block", f"WITH {NAMED}, {_TOP_PRICED} SELECT block_number, series, count(*) AS priced, round(avg(tip), 2) AS avg_tip, max(tip) AS max_tip FROM x GROUP BY 1, 2")
def q39_series(spark, d):
    x = top_or_other(named(spark, d).where("tip IS NOT NULL"), "entity", F.count(F.lit(1)), 5, "series")
    return x.groupBy("block_number", "series").agg(F.count(F.lit(1)).alias("priced"), F.round(F.avg("tip"), 2).alias("avg_tip"), F.max("tip").alias("max_tip"))


@query("q41_producer_share_block", f"WITH top AS (SELECT producer FROM producers WHERE {RANGE} GROUP BY 1 ORDER BY sum(items) DESC, producer LIMIT 8) SELECT block_number, CASE WHEN producer IN (SELECT producer FROM top) THEN producer ELSE 'other' END AS series, items FROM producers WHERE {RANGE}")
def q41(spark, d):
    return top_or_other(V.producers(spark, d, FIRST, LAST), "producer", F.sum("items"), 8, "series").select("block_number", "series", "items")


@query("q43_producer_users", f"WITH {NAMED}, c AS (SELECT producer, entity, count(*) AS items FROM n JOIN producers USING (block_number) GROUP BY 1, 2), s AS (SELECT *, CAST(items AS DOUBLE) * 100 / CAST(sum(items) OVER (PARTITION BY producer) AS DOUBLE) AS own, CAST(sum(items) OVER (PARTITION BY entity) AS DOUBLE) * 100 / CAST(sum(items) OVER () AS DOUBLE) AS overall FROM c) SELECT producer, entity, items, round(own, 6) AS own_share, round(overall, 6) AS overall_share, round(own / overall, 4) AS inclusion_index FROM s")
def q43(spark, d):
    """Counts per producer and entity are all that later steps read."""
    c = named(spark, d).join(V.producers(spark, d, FIRST, LAST).select("block_number", "producer"), "block_number").groupBy("producer", "entity").agg(F.count(F.lit(1)).alias("items"))
    rows = c.join(c.groupBy("producer").agg(F.sum("items").alias("mine")), "producer").join(c.groupBy("entity").agg(F.sum("items").alias("theirs")), "entity")
    rows = core.with_totals(rows, whole=F.sum("items"))
    own, overall = F.col("items").cast("double") * 100 / F.col("mine"), F.col("theirs").cast("double") * 100 / F.col("whole")
    return rows.select("producer", "entity", "items", F.round(own, 6).alias("own_share"), F.round(overall, 6).alias("overall_share"), F.round(own / overall, 4).alias("inclusion_index"))
