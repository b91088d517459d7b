"""How pending items waited: windows, timelines, misses by producer; freshness and the choice of tiers."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import share
from tessera.operators import core
from tessera.plans import tiers
from tessera.plans.charts import WINDOWS
from tessera.sources import views as V

QUERIES, ORACLES = {}, {}
DAY, HOUR = 86400, 3600


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = V.sql(sql)
        return f

    return add


def first_at_or_after(blocks: DataFrame, asked: DataFrame, key: str, t: str) -> DataFrame:
    """``asked`` (key, t) with ``from_block``: the first block at or after t. Both are ordered inside an hour only;
    where the rest of the hour has no block, the next hour that has one gives its first. Windows run from the
    latest time back: a frame that grows is one step a row, one that shrinks (to the following rows) is summed up anew for each."""
    b = blocks.select(F.lit(None).cast(asked.schema[key].dataType).alias(key), F.col("t").alias(t), F.col("block_number").alias("_b"), F.lit(1).alias("_k"))
    a = asked.select(key, t, F.lit(None).cast("long").alias("_b"), F.lit(0).alias("_k"))
    rest = Window.partitionBy("_hour").orderBy(F.desc(t), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_hour", F.floor(F.col(t) / HOUR)).withColumn("_own", F.min("_b").over(rest)).where("_k = 0")
    later = Window.orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)  # one row an hour
    hours = asked.select(F.floor(F.col(t) / HOUR).alias("_hour")).union(blocks.select(F.floor(F.col("t") / HOUR))).distinct()
    heads = blocks.groupBy(F.floor(F.col("t") / HOUR).alias("_hour")).agg(F.min("block_number").alias("_h"))
    after = hours.join(heads, "_hour", "left").withColumn("_next", F.min("_h").over(later)).select("_hour", "_next")
    return rows.join(after, "_hour", "left").select(key, t, F.coalesce("_own", "_next").alias("from_block"))


def counted_before(blocks: DataFrame, chunk: int = 1000) -> DataFrame:
    """block_number with ``n`` and ``m``: how many blocks, and marked ones, come before it. Counts are summed
    inside chunks of numbers, and chunks before one another."""
    c = F.floor(F.col("block_number") / chunk)
    inside = Window.partitionBy("_c").orderBy("block_number")
    rows = blocks.withColumn("_c", c).withColumn("_n", F.count(F.lit(1)).over(inside) - 1).withColumn("_m", F.sum("mark").over(inside) - F.col("mark"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    sums = blocks.groupBy(c.alias("_c")).agg(F.count(F.lit(1)).alias("_a"), F.sum("mark").alias("_b"))
    sums = sums.select("_c", F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_a"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b"))
    return rows.join(sums, "_c").select("block_number", (F.col("_n") + F.col("_a")).alias("n"), (F.col("_m") + F.col("_b")).alias("m"))


_WAITING = "w AS (SELECT tx_hash, seen, CAST(NULL AS BIGINT) AS included FROM pending UNION ALL SELECT tx_hash, min(seen), min(block_number) FROM facts GROUP BY tx_hash)"


@query("j15_first_at_or_after", "SELECT tx_hash, (SELECT min(block_number) FROM indexed b WHERE b.t >= p.seen) AS from_block FROM pending p")
def j15(spark, d):
    asked = V.pending(spark, d).select("tx_hash", "seen")
    return first_at_or_after(V.indexed(spark, d).select("block_number", "t"), asked, "tx_hash", "seen").select("tx_hash", "from_block")


@query("q47_inclusion_summary", f"""WITH {_WAITING}, c AS (SELECT tx_hash, count(*) AS missed, count(*) FILTER (reason = 'eligible') AS eligible, min(block_number) AS first FROM candidates GROUP BY 1), tip AS (SELECT max(block_number) AS tip FROM blocks), snap AS (SELECT DISTINCT block_number FROM candidates),
    s AS (SELECT w.tx_hash, coalesce(least((SELECT min(block_number) FROM blocks b WHERE b.t >= w.seen), c.first), CASE WHEN w.seen IS NOT NULL THEN coalesce(w.included - 1, tip) + 1 END) AS from_block, coalesce(w.included - 1, tip) AS to_block, coalesce(missed, 0) AS missed, coalesce(eligible, 0) AS eligible FROM w LEFT JOIN c USING (tx_hash), tip),
    r AS (SELECT b.block_number, count(*) OVER (ORDER BY b.block_number) AS n, count(snap.block_number) OVER (ORDER BY b.block_number) AS m FROM blocks b LEFT JOIN snap USING (block_number)),
    u AS (SELECT *, coalesce((SELECT max(n) FROM r WHERE block_number <= to_block), 0) AS n1, coalesce((SELECT max(n) FROM r WHERE block_number < from_block), 0) AS n0, coalesce((SELECT max(m) FROM r WHERE block_number <= to_block), 0) AS m1, coalesce((SELECT max(m) FROM r WHERE block_number < from_block), 0) AS m0 FROM s)
    SELECT tx_hash, from_block, to_block, CASE WHEN from_block IS NULL THEN 0 ELSE greatest(n1 - n0, 0) END AS blocks, CASE WHEN from_block IS NULL THEN 0 ELSE greatest(m1 - m0, 0) END AS snapshot_blocks, missed, eligible FROM u""")
def q47(spark, d):
    """The window of blocks that each transaction waited through, the blocks in it, those with a snapshot, and
    what it missed. Counts of a range are differences of cumulative counts. Blocks that a transaction never
    saw a time of have no window."""
    blocks = core.cut(V.blocks(spark, d).select("block_number", "t", "items", "fee", "base_fee"))
    miss = core.cut(V.missed(V.pending(spark, d), blocks).select("tx_hash", "block_number", "reason"))
    blocks = blocks.select("block_number", "t")
    w = core.cut(V.pending(spark, d).select("tx_hash", "seen", F.lit(None).cast("long").alias("included")).union(V.facts(spark, d).groupBy("tx_hash").agg(F.min("seen"), F.min("block_number"))))
    c = miss.groupBy("tx_hash").agg(F.count(F.lit(1)).alias("missed"), F.count_if(F.col("reason") == "eligible").alias("eligible"), F.min("block_number").alias("first"))
    first = first_at_or_after(blocks, w.where("seen IS NOT NULL").select("tx_hash", "seen"), "tx_hash", "seen").select("tx_hash", "from_block")
    marked = blocks.select("block_number").join(miss.select("block_number", F.lit(1).alias("mark")).distinct(), "block_number", "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    whole = marked.agg(F.max("block_number").alias("tip"), F.count(F.lit(1)).alias("all_n"), F.sum("mark").alias("all_m")).withColumn("_one", F.lit(1))
    s = w.join(c, "tx_hash", "left").join(first, "tx_hash", "left").withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").withColumn("to_block", F.coalesce(F.col("included") - 1, "tip"))
    s = s.withColumn("from_block", F.coalesce(F.least("from_block", "first"), F.when(F.col("seen").isNotNull(), F.col("to_block") + 1)))
    before = core.cut(counted_before(marked))
    at = lambda key, n, m: before.select(F.col("block_number").alias(key), F.col("n").alias(n), F.col("m").alias(m))
    both = s.join(at("from_block", "n0", "m0"), "from_block", "left").join(at("included", "n1", "m1"), "included", "left")
    # a window begins with a block or, where it is empty, behind the tip
    inside = lambda end, all_, start: F.coalesce(F.greatest(F.coalesce(end, all_) - F.col(start), F.lit(0)), F.lit(0)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("tx_hash", "from_block", "to_block", inside("n1", "all_n", "n0").alias("blocks"), inside("m1", "all_m", "m0").alias("snapshot_blocks"), zero("missed"), zero("eligible"))


@query("q48_inclusion_timeline", """WITH m AS (SELECT tx_hash, block_number, t, reason, false AS included FROM (SELECT *, row_number() OVER (PARTITION BY tx_hash ORDER BY block_number DESC) AS rank FROM candidates) WHERE rank <= 500),
    i AS (SELECT DISTINCT tx_hash, block_number, t, '' AS reason, true AS included FROM facts WHERE seen IS NOT NULL) SELECT x.tx_hash, x.block_number, x.t, x.reason, x.included, p.producer, p.items, p.fee FROM (SELECT * FROM m UNION ALL SELECT * FROM i) x LEFT JOIN producers p USING (block_number)""")
def q48(spark, d):
    """Blocks that left a transaction out, the newest 500 of each, with the reason and the block's occupancy, and
    the block that took it."""
    missed = core.top_k(V.candidates(spark, d), ["tx_hash"], [F.desc("block_number")], 500).select("tx_hash", "block_number", "t", "reason", F.lit(False).alias("included"))
    taken = V.facts(spark, d).where("seen IS NOT NULL").select("tx_hash", "block_number", "t", F.lit("").alias("reason"), F.lit(True).alias("included")).distinct()
    return missed.unionByName(taken).join(V.producers(spark, d).select("block_number", "producer", "items", "fee"), "block_number", "left")


@query("q44_producer_missed", """WITH c AS (SELECT p.producer, c.actor, c.wanted, c.tip, coalesce(r.name, '') AS name FROM candidates c JOIN producers p USING (block_number) LEFT JOIN registry r ON lower(c.actor) = r.address WHERE c.reason = 'eligible'),
    k AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM c) SELECT producer, CASE WHEN slug = '' THEN actor ELSE slug END AS entity, first(name ORDER BY wanted DESC, actor, tip NULLS FIRST) AS name, bool_or(slug <> '') AS is_entity, count(*) AS txs, CAST(sum(wanted) AS BIGINT) AS items, max(tip) AS max_tip, round(quantile_cont(CAST(tip AS DOUBLE), 0.5), 3) AS median_tip FROM k GROUP BY 1, 2""")
def q44(spark, d):
    """What each producer could have taken and did not, by entity."""
    c = V.candidates(spark, d).where("reason = 'eligible'").join(V.producers(spark, d).select("block_number", "producer"), "block_number").withColumn("label", F.lit(""))
    k = core.enrich(c, V.registry(spark, d)).withColumn("slug", core.slug(F.col("name")))
    keyed = k.withColumn("entity", F.when(F.col("slug") == "", F.col("actor")).otherwise(F.col("slug")))
    sums = keyed.groupBy("producer", "entity").agg(F.min_by("name", F.struct(-F.col("wanted"), "actor")).alias("name"), F.bool_or(F.col("slug") != "").alias("is_entity"), F.count(F.lit(1)).alias("txs"), F.sum("wanted").alias("items"), F.max("tip").alias("max_tip"))
    middle = core.cont_percentiles(keyed, ["producer", "entity"], "tip", median_tip="0.5")
    return sums.join(middle, ["producer", "entity"], "left").withColumn("median_tip", F.round("median_tip", 3))


@query("q45_missed_detail_from", f"SELECT min(t) AS first_t FROM candidates WHERE t >= {V.AS_OF - 7 * DAY} AND t < {V.AS_OF}")
def q45(spark, d):
    return V.candidates(spark, d).where(f"t >= {V.AS_OF - 7 * DAY} AND t < {V.AS_OF}").agg(F.min("t").alias("first_t"))


_COVERED = f"(SELECT min(t - t % 60) FROM blocks WHERE t >= {V.AS_OF - 2 * DAY})"


@query("q28_tier_select", f"WITH w AS (SELECT unnest(['1h', '24h', '7d', '30d']) AS w, unnest([3600, 86400, 604800, 2592000]) AS n), c AS (SELECT {_COVERED} AS covered) SELECT w.w, CASE WHEN n > 86400 THEN 'hourly' WHEN covered IS NOT NULL AND covered <= {V.AS_OF} - n THEN 'fine' ELSE 'raw' END AS tier, count(*) AS blocks, CAST(sum(items) AS BIGINT) AS items FROM w, c JOIN blocks b ON true WHERE b.t - b.t % CASE WHEN n > 86400 THEN 3600 ELSE 1 END >= {V.AS_OF} - n AND b.t < {V.AS_OF} GROUP BY 1, 2")
def q28(spark, d, store: str | None = None):
    """Each window from the tier that can serve it: long ones from hourly rollups, short ones from minutes if
    these reach back far enough, else from rows. The choice rests on one number, and only files of the tiers chosen
    are read where a ``store`` of rollups is given."""
    fine = tiers.block_tier(spark, d, "fine", store)
    covered = fine.agg(F.min("bucket")).first()[0]
    tier = {w: "hourly" if n > DAY else "fine" if covered is not None and covered <= V.AS_OF - n else "raw" for w, n in WINDOWS.items()}
    made = [tiers.counts(tiers.block_tier(spark, d, tier_of, store), {w: WINDOWS[w] for w, t in tier.items() if t == tier_of}).withColumn("tier", F.lit(tier_of)) for tier_of in sorted(set(tier.values()))]
    return functools.reduce(DataFrame.unionByName, made).select("w", "tier", "blocks", "items")


_CONTROL = """kv AS (SELECT block_number % 3 AS chain, unnest(['last', 'head', 'active', 'start', 'current', 'target']) AS key,
    unnest([CAST(max(block_number) AS VARCHAR), CAST(max(block_number) + 7 * (block_number % 3) AS VARCHAR), CASE block_number % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'x' ELSE 'false' END, CAST(min(block_number) + 10 AS VARCHAR), CASE block_number % 3 WHEN 1 THEN '-5' ELSE CAST(max(block_number) - 100 * (block_number % 3) AS VARCHAR) END, CAST(max(block_number) - 3 AS VARCHAR)]) AS value FROM blocks GROUP BY block_number % 3)"""
_FRESH = f"""WITH {_CONTROL}, p AS (SELECT chain, max(CASE WHEN key = 'last' THEN v END) AS last, max(CASE WHEN key = 'head' THEN v END) AS head, max(CASE WHEN key = 'start' THEN v END) AS start, coalesce(max(CASE WHEN key = 'current' THEN v END), max(CASE WHEN key = 'last' THEN v END), 0) AS current, max(CASE WHEN key IN ('target', 'head') THEN v END) AS target, bool_or(CASE WHEN key = 'active' THEN CASE value WHEN 'true' THEN true WHEN 'false' THEN false END END) AS said
    FROM (SELECT *, CASE WHEN value ~ '^[0-9]+$' THEN CAST(value AS BIGINT) END AS v FROM kv) GROUP BY chain)
    SELECT chain, last, head, greatest(head - last, 0) AS lag, CASE WHEN target <= current THEN false WHEN said IS NULL AND target IS NOT NULL THEN true ELSE coalesce(said, false) END AS active, greatest(target - current, 0) AS remaining,
    CASE WHEN start IS NULL OR target IS NULL THEN NULL WHEN current >= target THEN 100.0 WHEN target <= start OR current <= start THEN 0.0 ELSE round(CAST(current - start AS DOUBLE) * 100 / (target - start), 6) END AS progress FROM p"""


def control(spark, d) -> DataFrame:
    """Control rows (chain, key, value) as a crawler keeps them; values are texts and may be malformed."""
    chain = F.col("block_number") % 3
    g = V.blocks(spark, d).groupBy(chain.alias("chain")).agg(F.max("block_number").alias("hi"), F.min("block_number").alias("lo"))
    c = F.col("chain")
    values = {"last": F.col("hi"), "head": F.col("hi") + 7 * c, "active": F.when(c == 0, "true").when(c == 1, "x").otherwise("false"), "start": F.col("lo") + 10, "current": F.when(c == 1, "-5").otherwise((F.col("hi") - 100 * c).cast("string")), "target": F.col("hi") - 3}
    return g.select("chain", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))).alias("kv")).select("chain", "kv.key", "kv.value")


def freshness(rows: DataFrame) -> DataFrame:
    """Per chain: head, lag and progress of the backfill; malformed values count as missing."""
    number = F.when(F.rlike("value", F.lit("^[0-9]{1,18}$")), F.col("value")).cast("long")
    of = lambda *keys: F.max(F.when(F.col("key").isin(*keys), number))
    said = F.bool_or(F.when(F.col("key") == "active", F.when(F.col("value") == "true", True).when(F.col("value") == "false", False)))
    p = rows.groupBy("chain").agg(of("last").alias("last"), of("head").alias("head"), of("start").alias("start"), F.coalesce(of("current"), of("last"), F.lit(0)).alias("current"), of("target", "head").alias("target"), said.alias("said"))
    active = F.when(F.col("target") <= F.col("current"), False).when(F.col("said").isNull() & F.col("target").isNotNull(), True).otherwise(F.coalesce("said", F.lit(False)))
    done = F.when(F.col("start").isNull() | F.col("target").isNull(), F.lit(None)).when(F.col("current") >= F.col("target"), 100.0).when((F.col("target") <= F.col("start")) | (F.col("current") <= F.col("start")), 0.0)
    progress = done.otherwise(share(F.col("current") - F.col("start"), F.col("target") - F.col("start")))
    return p.select("chain", "last", "head", F.greatest(F.col("head") - F.col("last"), F.lit(0)).alias("lag"), active.alias("active"), F.greatest(F.col("target") - F.col("current"), F.lit(0)).alias("remaining"), progress.alias("progress"))


@query("q57_freshness", _FRESH + " WHERE chain = 2")
def q57(spark, d):
    return freshness(control(spark, d).where("chain = 2"))


@query("q63_networks_overview", _FRESH)
def q63(spark, d):
    return freshness(control(spark, d))
