"""Records, runs, gaps, look-ups, joins over ranges, and pending work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions.exprs import bucket, wei_text
from tessera.operators import core
from tessera.sources import views as V

QUERIES, ORACLES = {}, {}
VC = "CAST(CAST({} AS DECIMAL(38,0)) AS VARCHAR)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = V.sql(sql)
        return f

    return add


KINDS = "SELECT block_number AS n, unnest(CASE WHEN items >= 6 THEN ['full', 'above_target'] WHEN items > 3 THEN ['above_target'] WHEN items = 0 THEN ['drought', 'below_target'] WHEN items < 3 THEN ['below_target'] ELSE [] END) AS kind FROM blocks"
RUNS = f"WITH k AS ({KINDS}), g AS (SELECT kind, n, n - row_number() OVER (PARTITION BY kind ORDER BY n) AS grp FROM k), r AS (SELECT kind, min(n) AS first, max(n) AS last, count(*) AS length FROM g GROUP BY kind, grp)"


def kinds(spark, d):
    """Blocks by kind: full, above target, without items, below target."""
    i = F.col("items")
    of = F.when(i >= V.MAX, F.array(F.lit("full"), F.lit("above_target"))).when(i > V.TARGET, F.array(F.lit("above_target"))).when(i == 0, F.array(F.lit("drought"), F.lit("below_target"))).when(i < V.TARGET, F.array(F.lit("below_target")))
    return V.blocks(spark, d).select(F.col("block_number").alias("n"), F.explode(of).alias("kind"))


def streaks(spark, d):
    """Maximal runs of blocks per kind."""
    return core.islands(kinds(spark, d), ["kind"], "n", span=1000)


def after_change(stored, rows, first: int, span: int = 1000):
    """Stored runs after all blocks from ``first`` on have changed: runs that end there or adjoin are dropped, and
    what they and the change cover is rebuilt. Per kind, one number says how far back that reaches."""
    gone = stored.where(F.col("last") >= first - 1)
    back = gone.groupBy("kind").agg(F.min("first").alias("back"))
    near = rows.join(F.broadcast(back), "kind", "left").where(F.col("n") >= F.least(F.coalesce("back", F.lit(first)), F.lit(first))).select("kind", "n")
    return stored.where(F.col("last") < first - 1).unionByName(core.islands(near, ["kind"], "n", span))


@query("mnt6_streaks", RUNS + " SELECT kind, first, last, length FROM r")
def mnt6(spark, d):
    """Runs kept up to block 2500, then brought up to date."""
    rows = kinds(spark, d)
    return after_change(core.islands(rows.where("n < 2500"), ["kind"], "n", span=1000), rows, 2500).select("kind", "first", "last", "length")


@query("q49_records_streaks", RUNS + " SELECT kind, first, last, length, rank, last = (SELECT max(block_number) FROM blocks) AS open FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY length DESC, last DESC) AS rank FROM r) WHERE rank <= 5 OR last = (SELECT max(block_number) FROM blocks)")
def q49(spark, d):
    """The longest runs of each kind, the later one of equals, and the run that is still open at the tip.
    The tip is one number, sought once."""
    tip = V.blocks(spark, d).agg(F.max("block_number").alias("tip")).withColumn("_one", F.lit(1))
    rows = streaks(spark, d).withColumn("_one", F.lit(1)).join(F.broadcast(tip), "_one").withColumn("open", F.col("last") == F.col("tip"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("length"), F.desc("last"))))
    return ranked.where("rank <= 5 OR open").select("kind", "first", "last", "length", "rank", "open")


@query("q50_records_fee_peaks", "SELECT block_number, t, fee, items FROM blocks ORDER BY fee DESC, block_number LIMIT 10")
def q50(spark, d):
    return V.blocks(spark, d).orderBy(F.desc("fee"), "block_number").limit(10).select("block_number", "t", "fee", "items")


@query("q51_records_expensive_blocks", f"SELECT block_number, t, items, {VC.format('CAST(fee AS DECIMAL(38,0)) * items * 131072')} AS cost FROM blocks WHERE items > 0 ORDER BY CAST(fee AS HUGEINT) * items DESC, block_number LIMIT 10")
def q51(spark, d):
    cost = (F.col("fee").cast("decimal(18,0)") * (F.col("items") * V.ITEM).cast("decimal(18,0)")).cast(V.WEI)
    return V.blocks(spark, d).where("items > 0").withColumn("c", cost).orderBy(F.desc("c"), "block_number").limit(10).select("block_number", "t", "items", wei_text(F.col("c")).alias("cost"))


def _busiest(seconds):
    def run(spark, d):
        rows = V.facts(spark, d).groupBy(bucket(F.col("t"), seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("items"), wei_text(F.sum("cost")).alias("cost"))
        return rows.orderBy(F.desc("items"), "bucket").limit(10)

    return run


for _name, _s in (("q52_records_busiest_hours", 3600), ("q53_records_busiest_days", 86400)):
    query(_name, f"SELECT t - t % {_s} AS bucket, count(*) AS items, {VC.format('sum(cost)')} AS cost FROM facts GROUP BY 1 ORDER BY items DESC, bucket LIMIT 10")(_busiest(_s))


@query("q54_records_utilization_days", "SELECT t - t % 86400 AS bucket, round(CAST(sum(items) AS DOUBLE) * 100 / (count(*) * 3), 6) AS utilization, count(*) AS blocks FROM blocks GROUP BY 1 ORDER BY CAST(sum(items) AS DOUBLE) / count(*) DESC, bucket LIMIT 10")
def q54(spark, d):
    rows = V.blocks(spark, d).groupBy(bucket(F.col("t"), 86400).alias("bucket")).agg(F.sum("items").alias("i"), F.count(F.lit(1)).alias("blocks"))
    return rows.orderBy(F.desc(F.col("i").cast("double") / F.col("blocks")), "bucket").limit(10).select("bucket", X.share(F.col("i"), F.col("blocks") * V.TARGET).alias("utilization"), "blocks")


@query("q56_coverage_bounds", "SELECT min(block_number) AS first, max(block_number) AS last, max(t) AS last_t, count(*) AS blocks FROM blocks")
def q56(spark, d):
    return V.blocks(spark, d).agg(F.min("block_number").alias("first"), F.max("block_number").alias("last"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("blocks"))


@query("mnt20_missing_blocks", "SELECT r.n AS block_number FROM (SELECT unnest(range(100, 3501)) AS n) r WHERE r.n NOT IN (SELECT block_number FROM indexed) AND r.n >= (SELECT min(block_number) FROM indexed) ORDER BY 1 LIMIT 150")
def mnt20(spark, d, a: int = 100, b: int = 3500, limit: int = 150):
    """Missing numbers of [a, b], from the earliest block on, up to a limit. Gaps between neighbours are opened
    by ``sequence``; no full list of numbers is joined. The range's end stands in as a neighbour."""
    held = V.indexed(spark, d).where(F.col("block_number").between(a, b)).select("block_number")
    floor = V.indexed(spark, d).agg(F.min("block_number").alias("f"))
    ends = floor.where(F.col("f") <= b).select(F.explode(F.array(F.greatest(F.col("f"), F.lit(a)) - 1, F.lit(b + 1).cast("long"))).alias("block_number"))
    n = held.union(ends)
    by = Window.partitionBy(F.floor(F.col("block_number") / 1000)).orderBy("block_number")
    rows = n.withColumn("next", F.lead("block_number").over(by))
    heads = rows.groupBy(F.floor(F.col("block_number") / 1000).alias("p")).agg(F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))
    joints = heads.withColumn("next", F.lead("lo").over(Window.orderBy("lo"))).select(F.col("hi").alias("block_number"), "next")
    gaps = rows.unionByName(joints).where("next > block_number + 1")
    return gaps.select(F.explode(F.sequence(F.col("block_number") + 1, F.col("next") - 1)).alias("block_number")).orderBy("block_number").limit(limit)


RANGES = [(0, 100), (16, 40), (17, 32), (40, 40), (3600, 3700)]
_RANGES = "(VALUES (0, 100), (16, 40), (17, 32), (40, 40), (3600, 3700)) v(a, b)"


@query("mnt19_first_unindexed", f"SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(coalesce((SELECT min(n) FROM (SELECT unnest(range(a, b + 1)) AS n) WHERE n NOT IN (SELECT block_number FROM indexed)), b + 1) AS BIGINT) AS first_missing FROM {_RANGES}")
def mnt19(spark, d):
    """First missing number of each asked range, its start included, or the number behind it. A missing number
    is a range's start or follows a block, so nothing else is looked at."""
    asked = spark.createDataFrame(RANGES, "a long, b long")
    n = V.indexed(spark, d).select(F.col("block_number").alias("n"))
    slot = lambda c: F.floor(F.col(c) / 1000)  # noqa: E731  ranges are cut into slots, so the join is one by equality
    slots = asked.select("a", "b", F.explode(F.sequence(slot("a"), slot("b"))).alias("slot"))
    after = n.withColumn("slot", slot("n")).join(slots, "slot").where("n BETWEEN a AND b").select("a", "b", (F.col("n") + 1).alias("n"))
    gaps = asked.withColumn("n", F.col("a")).union(after).where("n <= b").join(n, "n", "left_anti").groupBy("a", "b").agg(F.min("n").alias("m"))
    return asked.join(gaps, ["a", "b"], "left").select("a", "b", F.coalesce("m", F.col("b") + 1).alias("first_missing"))


SCORE = "(CASE status WHEN 'active' THEN 100 WHEN 'disputed' THEN -100 ELSE 0 END + CASE confidence WHEN 'confirmed' THEN 30 WHEN 'probable' THEN 20 WHEN 'possible' THEN 10 ELSE 0 END)"


@query("j7_claim_range_join", f"WITH m AS (SELECT f.block_number, f.item_index, f.actor, c.name, row_number() OVER (PARTITION BY f.block_number, f.item_index ORDER BY {SCORE} DESC, c.valid_from DESC, (c.valid_to IS NULL) DESC, c.name, c.claim) AS rank FROM facts f JOIN claims c ON lower(f.actor) = c.address AND f.block_number >= c.valid_from AND (c.valid_to IS NULL OR f.block_number <= c.valid_to) AND c.status <> 'disputed') SELECT block_number, item_index, actor, name FROM m WHERE rank = 1")
def j7(spark, d):
    """Equality on the address makes it a hash join with a range condition; the best claim of each item
    is an aggregate with map-side parts, not a sort of a window."""
    c = V.claims(spark, d).where("status <> 'disputed'").withColumn("score", F.expr(SCORE))
    f = V.facts(spark, d).select("block_number", "item_index", "actor")
    on = (F.lower(f.actor) == c.address) & (f.block_number >= c.valid_from) & (c.valid_to.isNull() | (f.block_number <= c.valid_to))
    best = F.min_by("name", F.struct(-F.col("score"), -F.col("valid_from"), F.col("valid_to").isNotNull(), "name", "claim"))
    return f.join(c, on).groupBy("block_number", "item_index", "actor").agg(best.alias("name"))


@query("j8_schedule_asof", "WITH p AS (SELECT * FROM (VALUES (1704067200, 'one', 3, 6), (1704931200, 'two', 6, 9), (1706140800, 'three', 10, 15)) v(since, stage, target, cap)) SELECT b.block_number, p.stage, CAST(p.target AS BIGINT) AS target, CAST(p.cap AS BIGINT) AS cap FROM blocks b ASOF JOIN p ON b.t >= p.since")
def j8(spark, d):
    p = spark.createDataFrame([(1704067200, "one", 3, 6), (1704931200, "two", 6, 9), (1706140800, "three", 10, 15)], "since long, stage string, target long, cap long")
    i = core.asof_intervals(p, "since")
    b = V.blocks(spark, d)
    return b.join(F.broadcast(i), (b.t >= i.since) & (b.t < i.until)).select("block_number", "stage", "target", "cap")


REPLACED = "WITH r AS (SELECT tx_hash AS replaced, lead(tx_hash) OVER w AS replacement, actor, nonce, lead(seen) OVER w AS replaced_at FROM pending WHERE nonce IS NOT NULL WINDOW w AS (PARTITION BY actor, nonce ORDER BY seen, event_id))"


@query("t4_supersede", REPLACED + " SELECT replaced, replacement, actor, nonce, replaced_at FROM r WHERE replacement IS NOT NULL")
def t4(spark, d):
    w = Window.partitionBy("actor", "nonce").orderBy("seen", "event_id")
    rows = V.pending(spark, d).where("nonce IS NOT NULL").select(F.col("tx_hash").alias("replaced"), F.lead("tx_hash").over(w).alias("replacement"), "actor", "nonce", F.lead("seen").over(w).alias("replaced_at"))
    return rows.where("replacement IS NOT NULL")


@query("t6_missed_snapshot", "SELECT reason, count(*) AS candidates, count(DISTINCT block_number) AS blocks FROM candidates GROUP BY 1")
def t6(spark, d):
    return V.candidates(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("block_number").alias("blocks"))


PENDING_CAP = 100_000


@query("q11_pending_pressure", f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY seen DESC, tx_hash) AS rn FROM pending), p AS (SELECT * FROM s WHERE rn <= {PENDING_CAP}), b AS (SELECT arg_max(fee, block_number) AS now FROM blocks)
    SELECT count(*) AS txs, CAST(sum(items) AS BIGINT) AS items, CAST(sum(items) * 131072 AS BIGINT) AS gas, count(DISTINCT actor) AS actors, min(max_fee) AS min_fee, max(max_fee) AS max_fee, round(avg(max_fee), 3) AS avg_fee, quantile_disc(max_fee, 0.5) AS median_fee, quantile_disc(max_fee, 0.95) AS p95_fee, count(*) FILTER (max_fee IS NULL) AS unknown,
    count(*) FILTER (max_fee >= (SELECT now FROM b)) AS includable, count(*) FILTER (max_fee < (SELECT now FROM b)) AS underpriced, max({V.AS_OF} - seen) AS oldest, min({V.AS_OF} - seen) AS newest, round(avg({V.AS_OF} - seen), 3) AS mean_age, (SELECT count(*) FROM s WHERE rn <= {PENDING_CAP} + 1) > {PENDING_CAP} AS truncated FROM p""")
def q11(spark, d):
    """Over the newest pending rows up to a cap, which is the feature; ``truncated`` says if there are more.
    A limit of one row beyond the cap tells."""
    newest = V.pending(spark, d).orderBy(F.desc("seen"), "tx_hash").limit(PENDING_CAP + 1)
    ranked = newest.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("seen"), "tx_hash"))).withColumn("one", F.lit(1))
    now = V.blocks(spark, d).agg(F.max_by("fee", "block_number").alias("now")).withColumn("one", F.lit(1))
    more = ranked.agg(F.coalesce(F.max("rn"), F.lit(0)).alias("n")).select((F.col("n") > PENDING_CAP).alias("truncated"), F.lit(1).alias("one"))
    p = ranked.where(F.col("rn") <= PENDING_CAP)
    age = F.lit(V.AS_OF) - F.col("seen")
    one = p.join(F.broadcast(now), "one").groupBy("one").agg(
        F.count(F.lit(1)).alias("txs"), F.sum("items").alias("items"), F.sum(F.col("items") * V.ITEM).alias("gas"), F.countDistinct("actor").alias("actors"), F.min("max_fee").alias("min_fee"), F.max("max_fee").alias("max_fee"), F.round(F.avg("max_fee"), 3).alias("avg_fee"),
        F.count_if(F.col("max_fee").isNull()).alias("unknown"), F.count_if(F.col("max_fee") >= F.col("now")).alias("includable"), F.count_if(F.col("max_fee") < F.col("now")).alias("underpriced"), F.max(age).alias("oldest"), F.min(age).alias("newest"), F.round(F.avg(age), 3).alias("mean_age"),
    )
    return one.join(core.disc_percentiles(p, ["one"], "max_fee", median_fee="0.5", p95_fee="0.95"), "one", "left").join(more, "one").drop("one")


_SIBLINGS = "SELECT p.block_number, p.item_index, p.tx_hash, p.actor, l.hashes FROM p JOIN (SELECT block_number, tx_hash, string_agg(content_hash, ',' ORDER BY item_index) AS hashes FROM facts GROUP BY 1, 2) l USING (block_number, tx_hash)"


def siblings(facts, page):
    """The rows of a page (of bounded length) with the hashes of all items of their transactions: only the page's
    blocks are looked at."""
    held = facts.join(F.broadcast(page.select("block_number", "tx_hash").distinct()), ["block_number", "tx_hash"], "left_semi")
    lists = held.groupBy("block_number", "tx_hash").agg(F.array_sort(F.collect_list(F.struct("item_index", "content_hash"))).alias("l"))
    rows = page.join(lists, ["block_number", "tx_hash"])
    return rows.select("block_number", "item_index", "tx_hash", "actor", F.array_join("l.content_hash", ",").alias("hashes"))


@query("q1_latest_items", "WITH p AS (SELECT * FROM facts ORDER BY block_number DESC, item_index LIMIT 100) " + _SIBLINGS)
def q1(spark, d):
    f = V.facts(spark, d)
    return siblings(f, f.orderBy(F.desc("block_number"), "item_index").limit(100).select("block_number", "item_index", "tx_hash", "actor"))


@query("q3_items_by_actors", "WITH p AS (SELECT * FROM facts WHERE actor IN ('0xS1', '0xS5', '0xS9') ORDER BY t DESC, block_number DESC, item_index LIMIT 50 OFFSET 10) " + _SIBLINGS)
def q3(spark, d):
    """Each actor's newest rows first (pruned before the shuffle), then the page of all, then its hashes."""
    f = V.facts(spark, d)
    order = [F.desc("t"), F.desc("block_number"), F.col("item_index")]
    page = core.top_k(f.where(F.col("actor").isin("0xS1", "0xS5", "0xS9")), ["actor"], order, 60).orderBy(*order).offset(10).limit(50)
    return siblings(f, page.select("block_number", "item_index", "tx_hash", "actor"))


@query("q4_pending_items", "SELECT tx_hash, actor, nonce, items, seen FROM pending ORDER BY seen DESC, tx_hash LIMIT 100")
def q4(spark, d):
    return V.pending(spark, d).orderBy(F.desc("seen"), "tx_hash").limit(100).select("tx_hash", "actor", "nonce", "items", "seen")


@query("q4_pending_by_actors", "SELECT tx_hash, actor, nonce, items, seen FROM pending WHERE actor IN ('0xS1', '0xS5', '0xS9') ORDER BY seen DESC, tx_hash LIMIT 100")
def q4_actors(spark, d):
    """Of one or several actors: of each the newest, then the newest of all."""
    order = [F.desc("seen"), F.col("tx_hash")]
    rows = core.top_k(V.pending(spark, d).where(F.col("actor").isin("0xS1", "0xS5", "0xS9")), ["actor"], order, 100)
    return rows.orderBy(*order).limit(100).select("tx_hash", "actor", "nonce", "items", "seen")


BOUND = ["0xS9", "0xS1", "0xS5", "0xNONE"]


@query("src6_bind_table", "WITH k AS (SELECT unnest(range(1, 5)) AS place, unnest(['0xS9', '0xS1', '0xS5', '0xNONE']) AS actor) SELECT k.place, k.actor, count(f.actor) AS items FROM k LEFT JOIN facts f ON f.actor = k.actor GROUP BY 1, 2")
def src6(spark, d):
    """A list that comes with a request is a table with places; the facts are cut down to it before they are counted."""
    listed = spark.range(1).select(F.posexplode(F.array(*map(F.lit, BOUND))).alias("place", "actor")).withColumn("place", (F.col("place") + 1).cast("long"))
    counts = V.facts(spark, d).where(F.col("actor").isin(BOUND)).groupBy("actor").agg(F.count(F.lit(1)).alias("items"))
    return listed.join(counts, "actor", "left").select("place", "actor", F.coalesce("items", F.lit(0)).alias("items"))


@query("q8_block_detail", f"SELECT b.block_number, b.items, p.producer, {VC.format('p.payment')} AS payment, x.actors, coalesce(m.missed, 0) AS missed, m.missed_txs FROM blocks b JOIN producers p USING (block_number) LEFT JOIN (SELECT block_number, string_agg(actor, ',' ORDER BY item_index) AS actors FROM facts GROUP BY 1) x USING (block_number) LEFT JOIN (SELECT block_number, count(*) AS missed, string_agg(tx_hash || ':' || reason, ',' ORDER BY tip DESC NULLS LAST, tx_hash) AS missed_txs FROM candidates GROUP BY 1) m USING (block_number)")
def q8(spark, d):
    """Each block with its items, its producer, and what it left out, the best tips first. A block holds a bounded
    number of items, and what waited an hour at most."""
    lists = V.facts(spark, d).groupBy("block_number").agg(F.array_sort(F.collect_list(F.struct("item_index", "actor"))).alias("l"))
    left = F.array_sort(F.collect_list(F.struct(F.col("tip").isNull().alias("none"), (-F.coalesce("tip", F.lit(0))).alias("tip"), "tx_hash", "reason")))
    missed = V.candidates(spark, d).groupBy("block_number").agg(F.count(F.lit(1)).alias("missed"), left.alias("m"))
    rows = V.blocks(spark, d).select("block_number", "items").join(V.producers(spark, d).select("block_number", "producer", "payment"), "block_number").join(lists, "block_number", "left").join(missed, "block_number", "left")
    shown = F.array_join(F.transform("m", lambda x: F.concat(x["tx_hash"], F.lit(":"), x["reason"])), ",")
    return rows.select("block_number", "items", "producer", wei_text(F.col("payment")).alias("payment"), F.array_join("l.actor", ",").alias("actors"), F.coalesce("missed", F.lit(0)).alias("missed"), shown.alias("missed_txs"))


_OCCUPIED = "SELECT block_number, items, CASE WHEN params_target > 0 THEN params_target ELSE target_gas // 131072 END AS target, CASE WHEN params_max > 0 THEN params_max ELSE limit_gas // 131072 END AS cap FROM blocks"


@query("prj6_block_occupancy", f"SELECT block_number, items, target, cap, greatest(0, cap - items) AS available, CASE WHEN cap > 0 THEN round(least(100.0, CAST(items AS DOUBLE) * 100 / cap), 2) ELSE 0.0 END AS used_percent, cap > 0 AND items >= cap AS is_full, target > 0 AND items > target AS is_above_target FROM ({_OCCUPIED})")
def prj6(spark, d):
    """Target and capacity from the parameters, else from the gas columns, else 0."""
    limit = lambda p, g: X.first_positive(F.col(p), F.floor(F.col(g) / V.ITEM))
    rows = V.blocks(spark, d).select("block_number", "items", limit("params_target", "target_gas").alias("target"), limit("params_max", "limit_gas").alias("cap"))
    i, cap, target = F.col("items"), F.col("cap"), F.col("target")
    used = F.when(cap > 0, F.round(F.least(F.lit(100.0), i.cast("double") * 100 / cap), 2)).otherwise(0.0)
    return rows.select("*", F.greatest(F.lit(0), cap - i).alias("available"), used.alias("used_percent"), ((cap > 0) & (i >= cap)).alias("is_full"), ((target > 0) & (i > target)).alias("is_above_target"))


@query("prj2_effective_tip", "SELECT tx_hash, CASE WHEN p.max_fee IS NOT NULL THEN greatest(0, least(2000000000, p.max_fee - 30000000000)) END AS tip, CASE WHEN p.max_fee IS NOT NULL THEN greatest(p.max_fee - 50000000000, 0) END AS headroom FROM pending p")
def prj2(spark, d):
    cap = F.col("max_fee")
    return V.pending(spark, d).select("tx_hash", X.effective_tip(F.lit(2000000000).cast("long"), cap, F.lit(30000000000)).alias("tip"), X.headroom(cap, F.lit(50000000000)).alias("headroom"))


@query("prj11_unit_format", "WITH d AS (SELECT DISTINCT cost FROM facts), x AS (SELECT CAST(cost AS VARCHAR) AS wei, lpad(CAST(cost AS VARCHAR), CAST(greatest(length(CAST(cost AS VARCHAR)), 19) AS INTEGER), '0') AS s FROM d) SELECT wei, CASE WHEN rtrim(right(s, 18), '0') = '' THEN substr(s, 1, length(s) - 18) ELSE substr(s, 1, length(s) - 18) || '.' || rtrim(right(s, 18), '0') END AS units FROM x")
def prj11(spark, d):
    rows = V.facts(spark, d).select("cost").distinct()
    return rows.select(wei_text(F.col("cost")).alias("wei"), X.units(F.col("cost"), 18).alias("units"))


@query("prj4_time_to_inclusion", "SELECT block_number, item_index, (t - seen) * 1000 AS wait_ms, (t - 1704067200) // 12 AS slot FROM facts")
def prj4(spark, d):
    return V.facts(spark, d).select("block_number", "item_index", ((F.col("t") - F.col("seen")) * 1000).alias("wait_ms"), X.slot(F.col("t"), 1704067200, 12).alias("slot"))


@query("t7_ordered_gate", "SELECT block_number, (SELECT count(*) FROM indexed p WHERE p.block_number BETWEEN b.block_number - 5 AND b.block_number - 1) = 5 AS ready FROM blocks b")
def t7(spark, d):
    """Whether all five predecessors of each block are indexed. Each indexed block counts for its five successors: an
    aggregate with an equality key, not a range join."""
    b, there = (of(spark, d).select("block_number") for of in (V.blocks, V.indexed))
    ahead = there.select(F.explode(F.sequence(F.col("block_number") + 1, F.col("block_number") + 5)).alias("block_number")).groupBy("block_number").agg(F.count(F.lit(1)).alias("c"))
    return b.join(ahead, "block_number", "left").select("block_number", (F.coalesce("c", F.lit(0)) == 5).alias("ready"))


@query("w1_top_recipients", "SELECT producer, recipient, blocks, rank FROM (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY blocks DESC, recipient) AS rank FROM (SELECT producer, recipient, count(*) AS blocks FROM producers GROUP BY 1, 2)) WHERE rank <= 3")
def w1(spark, d):
    rows = V.producers(spark, d).groupBy("producer", "recipient").agg(F.count(F.lit(1)).alias("blocks"))
    return core.top_k(rows, ["producer"], [F.desc("blocks"), F.col("recipient")], 3)


@query("q46_producer_recent_blocks", "SELECT producer, block_number, items, rank FROM (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY block_number DESC) AS rank FROM producers) WHERE rank <= 20")
def q46(spark, d):
    return core.top_k(V.producers(spark, d), ["producer"], [F.desc("block_number")], 20).select("producer", "block_number", "items", "rank")


@query("q62_item_counts", "SELECT (SELECT count(*) FROM facts) AS confirmed, (SELECT count(*) FROM pending) AS pending")
def q62(spark, d):
    c = V.facts(spark, d).agg(F.count(F.lit(1)).alias("confirmed")).withColumn("one", F.lit(1))
    return c.join(V.pending(spark, d).agg(F.count(F.lit(1)).alias("pending")).withColumn("one", F.lit(1)), "one").drop("one")


@query("x_slug", "SELECT DISTINCT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM registry")
def x_slug(spark, d):
    return V.registry(spark, d).select("name", X.slug(F.col("name")).alias("slug")).distinct()


@query("u2_union_distinct_names", "SELECT name FROM registry UNION SELECT name FROM claims WHERE status <> 'disputed'")
def u2(spark, d):
    return V.registry(spark, d).select("name").union(V.claims(spark, d).where("status <> 'disputed'").select("name")).distinct()
