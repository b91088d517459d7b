"""Rolling statistics and zero-filled time charts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import bucket, share, slug, wei_text
from tessera.operators import core
from tessera.plans import tiers
from tessera.sources import views as V

FIRST, LAST, STEP = V.AS_OF - 7 * 86400, V.AS_OF, 3600
WINDOWS = {"1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000}
QUERIES, ORACLES = {}, {}
RANGE = f"t >= {FIRST} AND t < {LAST}"
SPINE = f"s AS (SELECT unnest(range({FIRST}, {LAST}, {STEP})) AS bucket)"
SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = V.sql(sql)
        return f

    return add


def bucketed(view, spark, d, step: int = STEP) -> DataFrame:
    """A view's rows of the range, with their bucket. The range reaches the scan as one of ``ts``."""
    return view(spark, d, FIRST, LAST).where((F.col("t") >= FIRST) & (F.col("t") < LAST)).withColumn("bucket", bucket(F.col("t"), step))


def hourly_items(spark, d, store: str | None = None) -> DataFrame:
    """Items of the range by hour, actor and label, from stored rollups where a ``store`` is given."""
    return tiers.stored(spark, store, "items", "hourly", FIRST, LAST) if store else tiers.of_items(bucketed(V.facts, spark, d), 3600)


def percent_saved(alternative, cost):
    """(alternative - cost) / alternative in percent, six places; 0 without an alternative."""
    return F.when(alternative > 0, F.round((alternative.cast("double") - cost.cast("double")) * 100 / alternative.cast("double"), 6)).otherwise(0.0)


SAVED = "CASE WHEN {a} > 0 THEN round((CAST({a} AS DOUBLE) - CAST({c} AS DOUBLE)) * 100 / CAST({a} AS DOUBLE), 6) ELSE 0.0 END"


@query("q25_rolling_raw", "WITH w AS (SELECT unnest(['1h', '24h', '7d', '30d']) AS w, unnest([3600, 86400, 604800, 2592000]) AS n), b AS (SELECT w.w, count(*) AS blocks, CAST(sum(items) AS BIGINT) AS items, round(avg(fee), 6) AS avg_fee, quantile_disc(fee, 0.5) AS median_fee, quantile_disc(fee, 0.95) AS p95_fee, count(*) FILTER (items > 3) AS above_target, count(*) FILTER (items >= 6) AS at_max, round(CAST(sum(items) AS DOUBLE) * 100 / (count(*) * 3), 6) AS utilization FROM w JOIN blocks ON t >= " + str(V.AS_OF) + " - n AND t < " + str(V.AS_OF) + " GROUP BY 1), f AS (SELECT w.w, count(DISTINCT actor) AS actors, CAST(CAST(sum(cost) AS DECIMAL(38,0)) AS VARCHAR) AS cost FROM w JOIN facts ON t >= " + str(V.AS_OF) + " - n AND t < " + str(V.AS_OF) + " GROUP BY 1) SELECT * FROM b JOIN f USING (w)")
def q25(spark, d):
    """Each row goes to the windows it lies in (at most four), in one pass, instead of a range join."""
    inside = F.filter(F.array(*(F.when(F.col("t") >= V.AS_OF - n, F.lit(w)) for w, n in WINDOWS.items())), lambda x: x.isNotNull())
    widest = V.AS_OF - max(WINDOWS.values())
    b = V.blocks(spark, d, widest, V.AS_OF).withColumn("w", F.explode(inside))
    stats = b.groupBy("w").agg(F.count(F.lit(1)).alias("blocks"), F.sum("items").alias("items"), F.round(F.avg("fee"), 6).alias("avg_fee"), F.count_if(F.col("items") > V.TARGET).alias("above_target"), F.count_if(F.col("items") >= V.MAX).alias("at_max"), share(F.sum("items"), F.count(F.lit(1)) * V.TARGET).alias("utilization"))
    f = V.facts(spark, d, widest, V.AS_OF).withColumn("w", F.explode(inside)).groupBy("w").agg(F.countDistinct("actor").alias("actors"), wei_text(F.sum("cost")).alias("cost"))
    return stats.join(core.few_disc_percentiles(b, ["w"], "fee", median_fee="0.5", p95_fee="0.95"), "w").join(f, "w")


_MARKET = f"""WITH {SPINE}, b AS (SELECT t - t % {STEP} AS bucket, min(block_number) AS first_block, max(block_number) AS last_block, count(*) AS blocks, CAST(sum(items) AS BIGINT) AS items, round(avg(fee), 6) AS avg_fee, quantile_disc(fee, 0.5) AS median_fee, quantile_disc(fee, 0.95) AS p95_fee FROM blocks WHERE {RANGE} GROUP BY 1),
f AS (SELECT t - t % {STEP} AS bucket, sum(cost) AS cost, count(DISTINCT actor) AS actors FROM facts WHERE {RANGE} GROUP BY 1)"""


@query("q29_market_chart_time", _MARKET + " SELECT s.bucket, first_block, last_block, coalesce(blocks, 0) AS blocks, coalesce(items, 0) AS items, coalesce(items, 0) * 131072 AS gas, coalesce(round(CAST(items AS DOUBLE) * 100 / (3 * blocks), 6), 0) AS utilization, coalesce(avg_fee, 0) AS avg_fee, coalesce(median_fee, 0) AS median_fee, coalesce(p95_fee, 0) AS p95_fee, CAST(CAST(coalesce(cost, 0) AS DECIMAL(38,0)) AS VARCHAR) AS cost, coalesce(actors, 0) AS actors FROM s LEFT JOIN b USING (bucket) LEFT JOIN f USING (bucket)")
def q29(spark, d):
    b = bucketed(V.blocks, spark, d)
    stats = b.groupBy("bucket").agg(F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"), F.count(F.lit(1)).alias("blocks"), F.sum("items").alias("items"), F.round(F.avg("fee"), 6).alias("avg_fee"))
    f = bucketed(V.facts, spark, d).groupBy("bucket").agg(F.sum("cost").alias("cost"), F.countDistinct("actor").alias("actors"))
    rows = core.spine(FIRST, LAST, STEP, spark).join(stats, "bucket", "left").join(core.disc_percentiles(b, ["bucket"], "fee", median_fee="0.5", p95_fee="0.95"), "bucket", "left").join(f, "bucket", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("blocks", "items", "median_fee", "p95_fee", "actors")}
    rows = rows.withColumns(zero).withColumn("avg_fee", F.coalesce("avg_fee", F.lit(0.0))).withColumn("cost", wei_text(F.coalesce("cost", F.lit(0).cast(V.WEI))))
    return rows.withColumns({"gas": F.col("items") * V.ITEM, "utilization": share(F.col("items"), F.col("blocks") * V.TARGET)})


@query("q29_market_chart_summary", f"""SELECT count(*) AS blocks, CAST(sum(items) AS BIGINT) AS items, round(avg(fee), 6) AS avg_fee, quantile_disc(fee, 0.5) AS median_fee, quantile_disc(fee, 0.95) AS p95_fee, arg_max(fee, block_number) AS current_fee,
    (SELECT CAST(CAST(sum(cost) AS DECIMAL(38,0)) AS VARCHAR) FROM facts WHERE {RANGE}) AS cost, (SELECT count(DISTINCT actor) FROM facts WHERE {RANGE}) AS actors FROM blocks WHERE {RANGE}""")
def q29_summary(spark, d):
    """The whole range in one row, and the fee of its newest block."""
    b = bucketed(V.blocks, spark, d).withColumn("_one", F.lit(1))
    stats = b.groupBy("_one").agg(F.count(F.lit(1)).alias("blocks"), F.sum("items").alias("items"), F.round(F.avg("fee"), 6).alias("avg_fee"), F.max_by("fee", "block_number").alias("current_fee"))
    f = bucketed(V.facts, spark, d).agg(wei_text(F.sum("cost")).alias("cost"), F.countDistinct("actor").alias("actors")).withColumn("_one", F.lit(1))
    return stats.join(core.few_disc_percentiles(b, ["_one"], "fee", median_fee="0.5", p95_fee="0.95"), "_one").join(f, "_one").drop("_one")


@query("q30_market_chart_block", f"SELECT b.block_number, b.t, b.items, b.fee, CAST(CAST(coalesce(f.cost, 0) AS DECIMAL(38,0)) AS VARCHAR) AS cost, coalesce(f.actors, 0) AS actors FROM blocks b LEFT JOIN (SELECT block_number, sum(cost) AS cost, count(DISTINCT actor) AS actors FROM facts WHERE {RANGE} GROUP BY 1) f USING (block_number) WHERE {RANGE}")
def q30(spark, d):
    f = bucketed(V.facts, spark, d).groupBy("block_number").agg(F.sum("cost").alias("cost"), F.countDistinct("actor").alias("actors"))
    rows = bucketed(V.blocks, spark, d).join(f, "block_number", "left")
    return rows.select("block_number", "t", "items", "fee", wei_text(F.coalesce("cost", F.lit(0).cast(V.WEI))).alias("cost"), F.coalesce("actors", F.lit(0)).alias("actors"))


def _q31_sql(seconds: int) -> str:
    return f"""WITH h AS (SELECT t - t % 3600 AS bucket, count(*) AS blocks, sum(fee) AS fee_sum, quantile_disc(fee, 0.5) AS median, quantile_disc(fee, 0.95) AS p95 FROM blocks WHERE {RANGE} GROUP BY 1),
    m AS (SELECT bucket - bucket % {seconds} AS bucket, CAST(sum(blocks) AS BIGINT) AS blocks, round(CAST(sum(fee_sum) AS DOUBLE) / CAST(sum(blocks) AS DOUBLE), 3) AS avg_fee, quantile_disc(median, 0.5) AS median_fee, quantile_disc(p95, 0.5) AS p95_fee FROM h GROUP BY 1),
    f AS (SELECT t - t % {seconds} AS bucket, count(*) AS items, CAST(CAST(sum(cost) AS DECIMAL(38,0)) AS VARCHAR) AS cost, count(DISTINCT actor) AS actors FROM facts WHERE {RANGE} GROUP BY 1)
    SELECT bucket, coalesce(items, 0) AS items, coalesce(cost, '0') AS cost, coalesce(actors, 0) AS actors, blocks, avg_fee, median_fee, p95_fee FROM m LEFT JOIN f USING (bucket)"""


def q31(spark, d, seconds: int, store: str | None = None):
    """Regrouped from hourly rollup rows: sums are exact, actors are counted from per-actor rows, and the
    95th percentile of a point is the median of its hours' (of an hour from minutes: that of their medians)."""
    r = hourly_items(spark, d, store)
    f = r.groupBy(bucket(F.col("bucket"), seconds).alias("bucket")).agg(F.sum("items").alias("items"), wei_text(F.sum("cost")).alias("cost"), F.countDistinct("actor").alias("actors"))
    if store:
        h = tiers.stored(spark, store, "blocks", "hourly", FIRST, LAST).withColumn("fee_sum", F.col("item_fee_sum"))
    else:
        b = bucketed(V.blocks, spark, d, 3600)
        h = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("blocks"), F.sum("fee").alias("fee_sum")).join(core.disc_percentiles(b, ["bucket"], "fee", median="0.5", p95="0.95"), "bucket")
    h = h.withColumn("bucket", bucket(F.col("bucket"), seconds))
    m = h.groupBy("bucket").agg(F.sum("blocks").alias("blocks"), F.round(F.sum("fee_sum") / F.sum("blocks"), 3).alias("avg_fee"))
    m = m.join(core.disc_percentiles(h, ["bucket"], "median", median_fee="0.5"), "bucket").join(core.disc_percentiles(h, ["bucket"], "p95", p95_fee="0.5"), "bucket")
    return m.join(f, "bucket", "left").withColumns({"items": F.coalesce("items", F.lit(0)), "cost": F.coalesce("cost", F.lit("0")), "actors": F.coalesce("actors", F.lit(0))})


for _name, _seconds in (("q31_market_chart_rollup", 21600), ("q31_market_chart_rollup_by_days", 86400)):
    query(_name, _q31_sql(_seconds))(functools.partial(q31, seconds=_seconds))


NAMED = f"n AS (SELECT f.*, coalesce(nullif({SLUG.format('coalesce(nullif(trim(f.label), %s), r.name, %s)' % (chr(39) * 2, chr(39) * 2))}, ''), 'unknown') AS entity FROM facts f LEFT JOIN registry r ON lower(f.actor) = r.address WHERE {RANGE})"


def named(spark, d) -> DataFrame:
    """Items of the range with their entity; items without a name are 'unknown'."""
    return with_entity(bucketed(V.facts, spark, d), V.registry(spark, d))


def with_entity(items: DataFrame, registry: DataFrame) -> DataFrame:
    rows = core.enrich(items, registry)
    return rows.withColumn("entity", F.coalesce(F.nullif(slug(F.col("name")), F.lit("")), F.lit("unknown")))


def top_or_other(rows: DataFrame, key: str, value, n: int, out: str) -> DataFrame:
    """Relabels all but the n largest keys as 'other'; the list of the largest holds n rows."""
    top = rows.where(F.col(key) != "unknown").groupBy(key).agg(value.alias("_v")).orderBy(F.desc("_v"), key).limit(n).select(key, F.lit(True).alias("_top"))
    return rows.join(F.broadcast(top), key, "left").withColumn(out, F.when(F.col("_top") | (F.col(key) == "unknown"), F.col(key)).otherwise("other")).drop("_top")


@query("q32_usage_chart_time", f"WITH {SPINE}, {NAMED}, top AS (SELECT entity FROM n WHERE entity <> 'unknown' GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 5), x AS (SELECT t - t % {STEP} AS bucket, CASE WHEN entity IN (SELECT entity FROM top) OR entity = 'unknown' THEN entity ELSE 'other' END AS series FROM n), k AS (SELECT DISTINCT series FROM x), c AS (SELECT bucket, series, count(*) AS items FROM x GROUP BY 1, 2) SELECT s.bucket, k.series, coalesce(c.items, 0) AS items FROM s CROSS JOIN k LEFT JOIN c ON c.bucket = s.bucket AND c.series = k.series")
def q32(spark, d):
    """Counts per bucket and series; the few series (top 5, other, unknown) are spread over the spine."""
    x = top_or_other(named(spark, d), "entity", F.count(F.lit(1)), 5, "series")
    counts = x.groupBy("bucket", "series").agg(F.count(F.lit(1)).alias("items"))
    series = counts.agg(F.collect_set("series").alias("all")).withColumn("_one", F.lit(1))  # seven names at most
    grid = core.spine(FIRST, LAST, STEP, spark).withColumn("_one", F.lit(1)).join(F.broadcast(series), "_one").select("bucket", F.explode("all").alias("series"))
    return grid.join(counts, ["bucket", "series"], "left").withColumn("items", F.coalesce("items", F.lit(0)))


@query("q32_usage_chart_summary", f"WITH {NAMED}, top AS (SELECT entity FROM n WHERE entity <> 'unknown' GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 5), x AS (SELECT CASE WHEN entity IN (SELECT entity FROM top) OR entity = 'unknown' THEN entity ELSE 'other' END AS series, count(*) AS items FROM n GROUP BY 1) SELECT series, items, round(CAST(items AS DOUBLE) * 100 / CAST(sum(items) OVER () AS DOUBLE), 6) AS share FROM x")
def q32_summary(spark, d):
    x = top_or_other(named(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity", F.sum("n"), 5, "series").groupBy("series").agg(F.sum("n").alias("items"))
    return core.with_totals(x, whole=F.sum("items")).select("series", "items", share(F.col("items"), F.col("whole")).alias("share"))


_COSTS = f"""WITH {SPINE}, b AS (SELECT t - t % {STEP} AS bucket, CAST(floor(avg(base_fee) FILTER (base_fee > 0) + 0.5) AS HUGEINT) AS exec_fee FROM blocks WHERE {RANGE} GROUP BY 1), f AS (SELECT t - t % {STEP} AS bucket, count(*) AS items, sum(cost) AS cost FROM facts WHERE {RANGE} GROUP BY 1),
j AS (SELECT s.bucket, coalesce(items, 0) AS items, CAST(coalesce(cost, 0) AS HUGEINT) AS cost, CASE WHEN exec_fee IS NULL THEN 16 * CAST(coalesce(cost, 0) AS HUGEINT) ELSE CAST(coalesce(items, 0) AS HUGEINT) * 131072 * 16 * exec_fee END AS alternative, exec_fee FROM s LEFT JOIN b USING (bucket) LEFT JOIN f USING (bucket))"""


def _costs(spark, d) -> DataFrame:
    """Per bucket: items, cost, and what the bytes would cost at the mean execution fee, rounded to an integer
    before it is multiplied. Where no block has a fee, the items' own fees stand in."""
    mean = F.floor(F.avg(F.when(F.col("base_fee") > 0, F.col("base_fee").cast("double"))) + 0.5).cast(V.WEI)
    b = bucketed(V.blocks, spark, d).groupBy("bucket").agg(mean.alias("exec_fee"))
    f = bucketed(V.facts, spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("items"), F.sum("cost").cast(V.WEI).alias("cost"))
    rows = core.spine(FIRST, LAST, STEP, spark).join(b, "bucket", "left").join(f, "bucket", "left").withColumns({"items": F.coalesce("items", F.lit(0)), "cost": F.coalesce("cost", F.lit(0).cast(V.WEI)).cast(V.WEI)})
    own = (F.col("cost").cast("decimal(30,0)") * F.lit(16).cast("decimal(2,0)")).cast(V.WEI)
    priced = ((F.col("items") * V.ITEM * 16).cast("decimal(18,0)") * F.col("exec_fee").cast("decimal(18,0)")).cast(V.WEI)
    return rows.withColumn("alternative", F.when(F.col("exec_fee").isNull(), own).otherwise(priced).cast(V.WEI))


@query("q35_cost_comparison_time", _COSTS + f" SELECT bucket, items, CAST(cost AS VARCHAR) AS cost, CAST(alternative AS VARCHAR) AS alternative, CAST(alternative - cost AS VARCHAR) AS savings, {SAVED.format(a='alternative', c='cost')} AS savings_percent, CAST(exec_fee AS VARCHAR) AS exec_fee FROM j")
def q35(spark, d):
    a, c = F.col("alternative"), F.col("cost")
    return _costs(spark, d).select("bucket", "items", wei_text(c).alias("cost"), wei_text(a).alias("alternative"), wei_text(a - c).alias("savings"), percent_saved(a, c).alias("savings_percent"), wei_text(F.col("exec_fee")).alias("exec_fee"))


@query("q35_cost_comparison_summary", _COSTS + f", z AS (SELECT sum(cost) AS cost, sum(alternative) AS alternative FROM j) SELECT CAST(CAST(cost AS HUGEINT) AS VARCHAR) AS cost, CAST(CAST(alternative AS HUGEINT) AS VARCHAR) AS alternative, {SAVED.format(a='alternative', c='cost')} AS savings_percent FROM z")
def q35_summary(spark, d):
    z = _costs(spark, d).agg(F.sum("cost").cast(V.WEI).alias("cost"), F.sum("alternative").cast(V.WEI).alias("alternative"))
    a, c = F.col("alternative"), F.col("cost")
    return z.select(wei_text(c).alias("cost"), wei_text(a).alias("alternative"), percent_saved(a, c).alias("savings_percent"))


@query("q38_tips_chart_time", f"WITH {SPINE}, f AS (SELECT t - t % {STEP} AS bucket, count(*) AS total, count(tip) AS priced, round(avg(tip), 2) AS avg_tip, quantile_disc(tip, 0.5) AS median_tip, quantile_disc(tip, 0.95) AS p95_tip, max(tip) AS max_tip FROM facts WHERE {RANGE} GROUP BY 1) SELECT s.bucket, coalesce(total, 0) AS total, coalesce(priced, 0) AS priced, avg_tip, median_tip, p95_tip, max_tip FROM s LEFT JOIN f USING (bucket)")
def q38(spark, d):
    f = bucketed(V.facts, spark, d)
    stats = f.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"), F.count("tip").alias("priced"), F.round(F.avg("tip"), 2).alias("avg_tip"), F.max("tip").alias("max_tip"))
    rows = core.spine(FIRST, LAST, STEP, spark).join(stats, "bucket", "left").join(core.disc_percentiles(f, ["bucket"], "tip", median_tip="0.5", p95_tip="0.95"), "bucket", "left")
    return rows.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("priced", F.coalesce("priced", F.lit(0)))


_TOP_PRICED = "top AS (SELECT entity FROM n WHERE entity <> 'unknown' AND tip IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 5), x AS (SELECT *, CASE WHEN entity IN (SELECT entity FROM top) OR entity = 'unknown' THEN entity ELSE 'other' END AS series FROM n WHERE tip IS NOT NULL)"


@query("q38_tips_series_by_entity", f"WITH {NAMED}, {_TOP_PRICED} SELECT t - t % {STEP} AS bucket, series, count(*) AS priced, round(avg(tip), 2) AS avg_tip, quantile_disc(tip, 0.5) AS median_tip, max(tip) AS max_tip FROM x GROUP BY 1, 2")
def q38_series(spark, d):
    """Series of the five largest entities over priced items only."""
    x = top_or_other(named(spark, d).where("tip IS NOT NULL"), "entity", F.count(F.lit(1)), 5, "series")
    stats = x.groupBy("bucket", "series").agg(F.count(F.lit(1)).alias("priced"), F.round(F.avg("tip"), 2).alias("avg_tip"), F.max("tip").alias("max_tip"))
    return stats.join(core.disc_percentiles(x, ["bucket", "series"], "tip", median_tip="0.5"), ["bucket", "series"])


_TOP_PRODUCERS = f"top AS (SELECT producer FROM producers WHERE {RANGE} GROUP BY 1 ORDER BY sum(items) DESC, producer LIMIT 8)"


@query("q40_producer_share_time", f"WITH {_TOP_PRODUCERS} SELECT t - t % 86400 AS bucket, CASE WHEN producer IN (SELECT producer FROM top) THEN producer ELSE 'other' END AS series, count(*) AS blocks, CAST(sum(items) AS BIGINT) AS items FROM producers WHERE {RANGE} GROUP BY 1, 2")
def q40(spark, d):
    p = top_or_other(V.producers(spark, d, FIRST, LAST), "producer", F.sum("items"), 8, "series")
    return p.groupBy(bucket(F.col("t"), 86400).alias("bucket"), "series").agg(F.count(F.lit(1)).alias("blocks"), F.sum("items").alias("items"))


@query("q40_producer_share_summary", f"WITH {_TOP_PRODUCERS}, x AS (SELECT CASE WHEN producer IN (SELECT producer FROM top) THEN producer ELSE 'other' END AS series, count(*) AS blocks, sum(items) AS items FROM producers WHERE {RANGE} GROUP BY 1) SELECT series, blocks, CAST(items AS BIGINT) AS items, round(CAST(items AS DOUBLE) * 100 / CAST(sum(items) OVER () AS DOUBLE), 6) AS item_share, round(CAST(blocks AS DOUBLE) * 100 / CAST(sum(blocks) OVER () AS DOUBLE), 6) AS block_share FROM x")
def q40_summary(spark, d):
    p = top_or_other(V.producers(spark, d, FIRST, LAST), "producer", F.sum("items"), 8, "series").groupBy("series").agg(F.count(F.lit(1)).alias("blocks"), F.sum("items").alias("items"))
    rows = core.with_totals(p, all_items=F.sum("items"), all_blocks=F.sum("blocks"))
    return rows.select("series", "blocks", "items", share(F.col("items"), F.col("all_items")).alias("item_share"), share(F.col("blocks"), F.col("all_blocks")).alias("block_share"))


@query("q42_producer_leaderboard", """WITH p AS (SELECT producer, count(*) AS blocks, count(*) FILTER (items > 0) AS item_blocks, CAST(sum(items) AS BIGINT) AS items, count(*) FILTER (items >= 6) AS full_blocks, CAST(CAST(sum(payment) AS DECIMAL(38,0)) AS VARCHAR) AS paid, CAST(CAST(quantile_disc(payment, 0.5) AS DECIMAL(38,0)) AS VARCHAR) AS median_paid FROM producers GROUP BY 1),
    x AS (SELECT DISTINCT f.tx_hash, f.block_number, f.tip, p.producer, CASE WHEN seen IS NOT NULL AND seen <= f.t THEN f.t - f.seen END AS wait FROM facts f JOIN producers p USING (block_number)),
    y AS (SELECT producer, min(tip) AS min_tip, round(quantile_cont(CAST(tip AS DOUBLE), 0.1), 3) AS tip_p10, round(quantile_cont(CAST(tip AS DOUBLE), 0.5), 3) AS tip_p50, round(quantile_cont(CAST(tip AS DOUBLE), 0.9), 3) AS tip_p90, round(quantile_cont(CAST(wait AS DOUBLE), 0.5), 3) AS wait_p50, round(quantile_cont(CAST(wait AS DOUBLE), 0.9), 3) AS wait_p90 FROM x GROUP BY 1),
    m AS (SELECT producer, count(*) AS missed, CAST(sum(wanted) AS BIGINT) AS missed_items FROM candidates JOIN producers USING (block_number) WHERE reason = 'eligible' GROUP BY 1),
    r AS (SELECT producer, string_agg(recipient, ',' ORDER BY n DESC, recipient) AS recipients FROM (SELECT producer, recipient, count(*) AS n, row_number() OVER (PARTITION BY producer ORDER BY count(*) DESC, recipient) AS rank FROM producers GROUP BY 1, 2) WHERE rank <= 3 GROUP BY 1)
    SELECT p.*, min_tip, tip_p10, tip_p50, tip_p90, wait_p50, wait_p90, coalesce(missed, 0) AS missed, coalesce(missed_items, 0) AS missed_items, recipients, round(CAST(items AS DOUBLE) * 100 / CAST((SELECT sum(items) FROM p) AS DOUBLE), 6) AS item_share FROM p LEFT JOIN y USING (producer) LEFT JOIN m USING (producer) LEFT JOIN r USING (producer)""")
def q42(spark, d):
    pr = core.cut(V.producers(spark, d).select("block_number", "t", "producer", "recipient", "items", "payment"))
    p = pr.groupBy("producer").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("items") > 0).alias("item_blocks"), F.sum("items").alias("items"), F.count_if(F.col("items") >= V.MAX).alias("full_blocks"), wei_text(F.sum("payment")).alias("paid"))
    tx = V.facts(spark, d).groupBy("block_number", "tx_hash").agg(F.min("tip").alias("tip"), F.min("t").alias("t"), F.min("seen").alias("seen"))
    of = pr.select("block_number", "producer")
    x = tx.join(of, "block_number").select("producer", "tip", F.when(F.col("seen") <= F.col("t"), F.col("t") - F.col("seen")).alias("wait"))
    # tips, waits and payments are counted by value once, and ranked together
    kinds = F.explode(F.array(F.struct(F.lit("tip").alias("what"), F.col("tip").cast(V.WEI).alias("v")), F.struct(F.lit("wait").alias("what"), F.col("wait").cast(V.WEI).alias("v"))))
    values = x.select("producer", kinds.alias("x")).select("producer", "x.what", "x.v").unionByName(pr.select("producer", F.lit("paid").alias("what"), F.col("payment").alias("v"))).where("v IS NOT NULL")
    values = core.cut(values.groupBy("producer", "what", "v").agg(F.count(F.lit(1)).alias("_c")))
    keys, only = ["producer", "what"], lambda what: values.where(F.col("what").isin(*what))
    middles = core.few_cont_percentiles(only(["tip", "wait"]), keys, "v", counted=True, p10="0.1", p50="0.5", p90="0.9")
    pick = lambda what, c: F.round(F.max(F.when(F.col("what") == what, F.col(c))), 3)
    tips = middles.groupBy("producer").agg(*(pick("tip", c).alias(f"tip_{c}") for c in ("p10", "p50", "p90")), *(pick("wait", c).alias(f"wait_{c}") for c in ("p50", "p90")))
    paid = core.few_disc_percentiles(only(["paid"]), ["producer"], "v", counted=True, median_paid="0.5").withColumn("median_paid", wei_text(F.col("median_paid")))
    least = only(["tip"]).groupBy("producer").agg(F.min("v").cast("long").alias("min_tip"))
    missed = V.candidates(spark, d).where("reason = 'eligible'").join(of, "block_number").groupBy("producer").agg(F.count(F.lit(1)).alias("missed"), F.sum("wanted").alias("missed_items"))
    three = core.top_k(pr.groupBy("producer", "recipient").agg(F.count(F.lit(1)).alias("n")), ["producer"], [F.desc("n"), F.col("recipient")], 3)
    recipients = three.groupBy("producer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "recipient"))), lambda r: r["recipient"]), ",").alias("recipients"))
    for more in (paid, least, tips, missed, recipients):
        p = p.join(more, "producer", "left")
    out = core.with_totals(p, all_items=F.sum("items")).withColumns({"missed": F.coalesce("missed", F.lit(0)), "missed_items": F.coalesce("missed_items", F.lit(0))})
    return out.withColumn("item_share", share(F.col("items"), F.col("all_items"))).drop("all_items")