"""Incremental maintenance as batch merges: each query applies a change to a stored table, and its SQL computes
what must come out, in most cases from scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions.exprs import bucket, present, wei_text
from tessera.operators import core
from tessera.plans.lookup import _RAW, KNOWN, _raw
from tessera.plans.records import REPLACED, SCORE, VC, t4
from tessera.sources import views as V

QUERIES, ORACLES = {}, {}
DAY = 86400
CUT = 1000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = V.sql(sql)
        return f

    return add


_STORED = "s AS (SELECT block_number, item_index, tx_hash, actor, seen FROM facts WHERE block_number % 20 <> 19)"
_INCOMING = "i AS (SELECT block_number, item_index, CASE WHEN block_number % 4 = 0 THEN tx_hash || '-new' ELSE tx_hash END AS tx_hash, actor, CASE WHEN block_number % 3 = 0 THEN NULL ELSE seen + 5 END AS seen FROM facts WHERE block_number % 20 >= 18)"


def _incoming(spark, d) -> DataFrame:
    b = F.col("block_number")
    rows = V.facts(spark, d).where("block_number % 20 >= 18")
    return rows.select("block_number", "item_index", F.when(b % 4 == 0, F.concat("tx_hash", F.lit("-new"))).otherwise(F.col("tx_hash")).alias("tx_hash"), "actor", F.when(b % 3 != 0, F.col("seen") + 5).alias("seen"))


@query("mnt1_upsert_items", f"WITH {_STORED}, {_INCOMING} SELECT coalesce(i.block_number, s.block_number) AS block_number, coalesce(i.item_index, s.item_index) AS item_index, coalesce(i.tx_hash, s.tx_hash) AS tx_hash, coalesce(i.actor, s.actor) AS actor, CASE WHEN i.block_number IS NULL THEN s.seen WHEN i.tx_hash = s.tx_hash THEN coalesce(s.seen, i.seen) ELSE i.seen END AS seen FROM s FULL OUTER JOIN i ON s.block_number = i.block_number AND s.item_index = i.item_index")
def mnt1(spark, d):
    """Items put in or replaced by block and place. The first sight stays if the place holds the same transaction."""
    stored = V.facts(spark, d).where("block_number % 20 <> 19").select("block_number", "item_index", *(F.col(c).alias(f"s_{c}") for c in ("tx_hash", "actor", "seen")))
    both = stored.join(_incoming(spark, d).withColumn("new", F.lit(True)), ["block_number", "item_index"], "full_outer")
    seen = F.when(F.col("new").isNull(), F.col("s_seen")).when(F.col("tx_hash") == F.col("s_tx_hash"), F.coalesce("s_seen", "seen")).otherwise(F.col("seen"))
    return both.select("block_number", "item_index", F.coalesce("tx_hash", "s_tx_hash").alias("tx_hash"), F.coalesce("actor", "s_actor").alias("actor"), seen.alias("seen"))


@query("mnt2_network_totals", f"SELECT count(*) AS items, {VC.format('sum(cost)')} AS cost, max(block_number) AS last_block, max(t) AS last_t FROM facts WHERE block_number >= 100")
def mnt2(spark, d):
    """One row of totals, after rows came (blocks from 1000 on) and went (the first hundred), by signed deltas
    that never fall below 0."""
    f = V.facts(spark, d)
    one = lambda rows, sign: rows.agg((sign * F.count(F.lit(1))).alias("items"), (sign * F.coalesce(F.sum("cost"), F.lit(0))).cast(V.WEI).alias("cost"), F.max("block_number").alias("last_block"), F.max("t").alias("last_t"))
    parts = one(f.where(f"block_number < {CUT}"), 1).unionByName(one(f.where(f"block_number >= {CUT}"), 1)).unionByName(one(f.where("block_number < 100"), -1))
    floor = lambda c: F.greatest(F.sum(c), F.lit(0))
    return parts.agg(floor("items").alias("items"), wei_text(floor("cost")).alias("cost"), F.max("last_block").alias("last_block"), F.max("last_t").alias("last_t"))


_LABELLED = f"""l AS (SELECT actor, max(trim(label)) FILTER (block_number < {CUT}) AS old, max(trim(label)) FILTER (block_number >= {CUT}) AS new, max(trim(label)) FILTER (block_number >= 100) AS fresh FROM facts GROUP BY 1)"""


@query("mnt3_actor_totals", f"WITH {_LABELLED} SELECT actor, count(*) AS items, {VC.format('sum(cost)')} AS cost, max(t) AS last_t, coalesce(nullif(any_value(l.new), ''), nullif(any_value(l.old), ''), '') AS label FROM facts JOIN l USING (actor) WHERE block_number >= 100 GROUP BY 1")
def mnt3(spark, d):
    """Totals per actor after rows came and went: signed deltas, a new label wins if it has text, the last time
    only grows, and actors without items go. An actor whose rows all went earlier keeps no last time of its own."""
    f = V.facts(spark, d)

    def sums(rows: DataFrame, sign: int) -> DataFrame:
        alive = sign > 0
        return rows.groupBy("actor").agg((sign * F.count(F.lit(1))).alias("items"), (sign * F.sum("cost")).cast(V.WEI).alias("cost"), (F.max("t") if alive else F.lit(None).cast("long")).alias("last_t"), (F.max(present(F.col("label"))) if alive else F.lit(None).cast("string")).alias("label"))

    stored, came, went = sums(f.where(f"block_number < {CUT}"), 1), sums(f.where(f"block_number >= {CUT}"), 1), sums(f.where("block_number < 100"), -1)
    parts = stored.withColumn("age", F.lit(0)).unionByName(came.withColumn("age", F.lit(1))).unionByName(went.withColumn("age", F.lit(2)))
    newest = F.max_by("label", F.when(F.col("label").isNotNull(), F.col("age")))
    merged = parts.groupBy("actor").agg(F.sum("items").alias("items"), F.sum("cost").cast(V.WEI).alias("c"), F.max("last_t").alias("last_t"), F.coalesce(newest, F.lit("")).alias("label")).where("items > 0")
    return merged.select("actor", "items", wei_text(F.col("c")).alias("cost"), "last_t", "label")


GRAINS = (60, 3600, 21600, DAY)
FINE_FROM = V.AS_OF - 2 * DAY
_BLOCK_ROLLUP = f"SELECT g AS seconds, t - t % g AS bucket, count(*) AS blocks, CAST(sum(items) AS BIGINT) AS items, quantile_disc(fee, 0.5) AS median_fee, quantile_disc(fee, 0.95) AS p95_fee, count(*) FILTER (items > 3) AS above_target, count(*) FILTER (items >= 6) AS at_max, CAST(sum(base_fee) AS BIGINT) AS fee_sum, count(*) FILTER (base_fee > 0) AS fee_blocks FROM blocks, (SELECT unnest([60, 3600, 21600, 86400]) AS g) WHERE g > 60 OR t >= {FINE_FROM} GROUP BY 1, 2"


def grained(rows: DataFrame) -> DataFrame:
    """Each row once for every grain that applies to its age: the fine one only for two days."""
    grains = F.filter(F.array(*(F.when(F.lit(g > 60) | (F.col("t") >= FINE_FROM), F.lit(g)) for g in GRAINS)), lambda x: x.isNotNull())
    return rows.withColumn("seconds", F.explode(grains)).withColumn("bucket", F.col("t") - F.pmod("t", "seconds"))


def block_rollup(blocks: DataFrame) -> DataFrame:
    g, keys = grained(blocks), ["seconds", "bucket"]
    sums = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.sum("items").alias("items"), F.count_if(F.col("items") > V.TARGET).alias("above_target"), F.count_if(F.col("items") >= V.MAX).alias("at_max"), F.sum("base_fee").alias("fee_sum"), F.count_if(F.col("base_fee") > 0).alias("fee_blocks"))
    return sums.join(core.disc_percentiles(g, keys, "fee", median_fee="0.5", p95_fee="0.95"), keys)


@query("mnt4_block_rollup", _BLOCK_ROLLUP)
def mnt4(spark, d):
    """New blocks (from 3000 on) come to stored rollups: percentiles can't be merged, so the buckets that the new
    blocks touch are computed anew from all their blocks and replace the stored ones."""
    b, keys = V.blocks(spark, d), ["seconds", "bucket"]
    stored = block_rollup(b.where("block_number < 3000"))
    touched = grained(b.where("block_number >= 3000")).select(*keys).distinct()
    first = b.where("block_number >= 3000").agg(F.min(F.col("t") - F.col("t") % DAY).alias("from")).withColumn("_one", F.lit(1))
    near = b.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one").where("t >= from").drop("_one", "from")
    anew = block_rollup(near).join(touched, keys, "left_semi")
    return core.upsert(stored, anew, keys)


@query("mnt5_item_rollup", f"SELECT t - t % 3600 AS bucket, actor, count(*) AS items, count(*) * 131072 AS bytes, {VC.format('sum(cost)')} AS cost, {VC.format('sum(CAST(fee AS HUGEINT) * 131072)')} AS size_fee FROM facts GROUP BY 1, 2")
def mnt5(spark, d):
    """Two batches merged by signed deltas equal the whole computed at once."""
    f = V.facts(spark, d).withColumn("bucket", bucket(F.col("t"), 3600))
    size_fee = F.sum(F.col("fee").cast("decimal(18,0)") * F.lit(V.ITEM).cast("decimal(6,0)")).cast(V.WEI)
    made = lambda rows: rows.groupBy("bucket", "actor").agg(F.count(F.lit(1)).alias("items"), F.count(F.lit(1)).alias("n"), F.sum("cost").cast(V.WEI).alias("cost"), size_fee.alias("size_fee"))
    both = core.merge(made(f.where("block_number % 2 = 0")), made(f.where("block_number % 2 = 1")), ["bucket", "actor"], ["items", "cost", "size_fee"])
    return both.select("bucket", "actor", "items", (F.col("items") * V.ITEM).alias("bytes"), wei_text(F.col("cost")).alias("cost"), wei_text(F.col("size_fee")).alias("size_fee"))


@query("j13_lateral_grain", f"SELECT g AS seconds, count(*) AS items, count(DISTINCT t - t % g) AS buckets FROM facts, (SELECT unnest([60, 3600, 21600, 86400]) AS g) WHERE g > 60 OR t >= {FINE_FROM} GROUP BY 1")
def j13(spark, d):
    return grained(V.facts(spark, d).select("t")).groupBy("seconds", "bucket").agg(F.count(F.lit(1)).alias("n")).groupBy("seconds").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("buckets"))


@query("mnt7_fine_retention", f"SELECT t - t % 60 AS bucket, actor, count(*) AS items FROM facts WHERE t - t % 60 + 60 > {FINE_FROM} GROUP BY 1, 2")
def mnt7(spark, d):
    """Minutes are kept for two days; a bucket goes when it is over as a whole."""
    return core.rollup(V.facts(spark, d), 60).where(F.col("bucket") + 60 > FINE_FROM).select("bucket", "actor", "items")


@query("mnt8_rollup_backfill", f"WITH c AS (SELECT unnest(range({FINE_FROM}, {V.AS_OF}, 3600)) AS chunk) SELECT chunk, ({V.AS_OF} - chunk) // 3600 AS turn, count(f.t) AS items, count(DISTINCT f.t - f.t % 60) AS buckets FROM c LEFT JOIN facts f ON f.t - f.t % 3600 = chunk AND f.t < {V.AS_OF} GROUP BY 1, 2")
def mnt8(spark, d):
    """Minutes of two days filled in chunks of an hour, the newest first, each replaced whole: here all chunks are
    one job, and ``turn`` is the order in which they become visible."""
    r = core.rollup(V.facts(spark, d, FINE_FROM, V.AS_OF), 60)
    filled = r.groupBy(bucket(F.col("bucket"), 3600).alias("bucket")).agg(F.sum("items").alias("items"), F.countDistinct("bucket").alias("buckets"))
    rows = core.spine(FINE_FROM, V.AS_OF, 3600, spark).join(filled, "bucket", "left")
    return rows.select(F.col("bucket").alias("chunk"), F.floor((F.lit(V.AS_OF) - F.col("bucket")) / 3600).alias("turn"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("buckets", F.lit(0)).alias("buckets"))


@query("mnt9_heal_stale_buckets", "WITH h AS (SELECT t - t % 3600 AS bucket, sum(base_fee) AS fee_sum, count(*) FILTER (base_fee > 0) AS fee_blocks FROM blocks GROUP BY 1) SELECT bucket, CAST(fee_sum AS BIGINT) AS fee_sum, fee_blocks, bucket // 3600 % 7 = 0 AND fee_blocks > 0 AS healed FROM h")
def mnt9(spark, d):
    """Buckets stored without fee sums (every seventh) though their blocks have fees are found and computed anew."""
    b = V.blocks(spark, d).withColumn("bucket", bucket(F.col("t"), 3600))
    made = lambda rows: rows.groupBy("bucket").agg(F.sum("base_fee").alias("fee_sum"), F.count_if(F.col("base_fee") > 0).alias("fee_blocks"))
    lost = F.floor(F.col("bucket") / 3600) % 7 == 0
    stored = made(b).withColumns({c: F.when(~lost, F.col(c)).otherwise(0) for c in ("fee_sum", "fee_blocks")})
    stale = stored.where("fee_blocks = 0").join(b.where("base_fee > 0").select("bucket").distinct(), "bucket", "left_semi").select("bucket")
    healed = made(b.join(stale, "bucket", "left_semi")).withColumn("healed", F.lit(True))
    return core.upsert(stored.withColumn("healed", F.lit(False)), healed, ["bucket"])


_BEST = "(SELECT address, name, score FROM (SELECT *, " + SCORE + " AS score, row_number() OVER (PARTITION BY address ORDER BY " + SCORE + " DESC, valid_from DESC, (valid_to IS NULL) DESC, name, claim) AS rank FROM claims WHERE status <> 'disputed' AND valid_to IS NULL AND {where}) WHERE rank = 1)"


def best_claims(claims: DataFrame, block: int = -1) -> DataFrame:
    """The best claim of each address at a block; a negative one is the tip, where only open-ended claims hold.
    Disputed claims never do. Order: score, later start, open end, name."""
    fine = claims.where("status <> 'disputed'")
    fine = fine.where("valid_to IS NULL") if block < 0 else fine.where(f"valid_from <= {block} AND (valid_to IS NULL OR valid_to >= {block})")
    rows = fine.withColumn("score", F.expr(SCORE))
    order = F.struct(-F.col("score"), -F.col("valid_from"), F.col("valid_to").isNotNull(), "name", "claim")
    return rows.groupBy("address").agg(F.min_by(F.struct("name", "score"), order).alias("b")).select("address", "b.*")


@query("mnt11_claim_scoring", "SELECT * FROM " + _BEST.format(where="true"))
def mnt11(spark, d):
    return best_claims(V.claims(spark, d))


@query("mnt10_claims_sync", f"WITH o AS (SELECT * FROM {_BEST.format(where='claim % 10 <> 3')}), n AS (SELECT * FROM {_BEST.format(where='claim % 10 <> 7')}) SELECT coalesce(o.address, n.address) AS address, o.name AS old_name, n.name AS new_name, CASE WHEN o.address IS NULL THEN 'add' WHEN n.address IS NULL THEN 'remove' ELSE 'change' END AS action FROM o FULL OUTER JOIN n ON o.address = n.address WHERE o.name IS DISTINCT FROM n.name")
def mnt10(spark, d):
    """Registry changes that follow from a new claims file: added, removed and renamed addresses. One ranked
    aggregate a side and one join, in place of clearing and applying labels again."""
    c = V.claims(spark, d)
    old, new = (best_claims(c.where(f"claim % 10 <> {k}")).select("address", F.col("name").alias(n)) for k, n in ((3, "old_name"), (7, "new_name")))
    both = old.join(new, "address", "full_outer").where(~F.col("old_name").eqNullSafe(F.col("new_name")))
    return both.withColumn("action", F.when(F.col("old_name").isNull(), "add").when(F.col("new_name").isNull(), "remove").otherwise("change"))


_MISSES = "m AS (SELECT block_number, count(*) AS pending, count(*) FILTER (reason = 'eligible') AS skipped, CAST(coalesce(sum(wanted) FILTER (reason = 'eligible'), 0) AS BIGINT) AS skipped_items, max(tip) FILTER (reason = 'eligible') AS max_tip FROM candidates GROUP BY 1)"


def misses(rows: DataFrame) -> DataFrame:
    """What the snapshot of a block says: pending, eligible ones, their items, and the best tip among them."""
    fine = F.col("reason") == "eligible"
    return rows.groupBy("block_number").agg(F.count(F.lit(1)).alias("pending"), F.count_if(fine).alias("skipped"), F.coalesce(F.sum(F.when(fine, F.col("wanted"))), F.lit(0)).alias("skipped_items"), F.max(F.when(fine, F.col("tip"))).alias("max_tip"))


@query("mnt12_producer_upsert", f"WITH {_MISSES}, s AS (SELECT p.block_number, p.producer, m.block_number IS NOT NULL AS snapshot, m.pending, m.skipped FROM producers p LEFT JOIN m USING (block_number) WHERE block_number % 20 <> 19), n AS (SELECT block_number, producer || '*' AS producer, block_number % 2 = 0 AS snapshot, CASE WHEN block_number % 2 = 0 THEN 1 END AS pending, CASE WHEN block_number % 2 = 0 THEN 0 END AS skipped FROM producers WHERE block_number % 20 >= 15) SELECT coalesce(n.block_number, s.block_number) AS block_number, coalesce(n.producer, s.producer) AS producer, coalesce(s.snapshot, false) OR coalesce(n.snapshot, false) AS snapshot, CASE WHEN s.snapshot THEN s.pending ELSE n.pending END AS pending, CASE WHEN s.snapshot THEN s.skipped ELSE n.skipped END AS skipped FROM s FULL OUTER JOIN n ON s.block_number = n.block_number")
def mnt12(spark, d):
    """Who built a block is overwritten; a snapshot that is stored survives."""
    p = V.producers(spark, d).select("block_number", "producer")
    s = p.where("block_number % 20 <> 19").join(misses(V.candidates(spark, d)), "block_number", "left").select("block_number", F.col("producer").alias("s_producer"), F.col("pending").isNotNull().alias("s_snapshot"), F.col("pending").alias("s_pending"), F.col("skipped").alias("s_skipped"))
    even = F.col("block_number") % 2 == 0
    n = p.where("block_number % 20 >= 15").select("block_number", F.concat("producer", F.lit("*")).alias("producer"), even.alias("snapshot"), F.when(even, 1).alias("pending"), F.when(even, 0).alias("skipped"))
    keep = lambda c: F.when(F.col("s_snapshot"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c)
    no = lambda c: F.coalesce(c, F.lit(False))
    return s.join(n, "block_number", "full_outer").select("block_number", F.coalesce("producer", "s_producer").alias("producer"), (no("s_snapshot") | no("snapshot")).alias("snapshot"), keep("pending"), keep("skipped"))


_KEY = "CASE WHEN contains(lower(raw), '{0}') THEN '{1}' WHEN contains(lower(raw), '{2}') THEN '{3}' WHEN l <> '' THEN 'extra:' || trim(regexp_replace(lower(l), '[^a-z0-9]+', '-', 'g'), '-') ELSE 'addr:' || lower(recipient) END"
_NEW = [("00000000", "eight", "Group Eight"), ("000001", "one", "Group One")]


@query("mnt13_producer_relabel", f"WITH x AS ({_RAW}), z AS (SELECT *, CASE WHEN trim(raw) ~ '^[ -~]{{3,}}$' THEN trim(raw) ELSE '' END AS l FROM x), k AS (SELECT s_suppkey, {_KEY.format(KNOWN[0][0], KNOWN[0][1], KNOWN[1][0], KNOWN[1][1])} AS old, {_KEY.format(_NEW[0][0], _NEW[0][1], _NEW[1][0], _NEW[1][1])} AS new FROM z) SELECT b.block_number, k.old AS old_key, k.new AS new_key FROM blocks b JOIN k ON b.block_number % 10 = k.s_suppkey WHERE k.old <> k.new")
def mnt13(spark, d):
    """Labels under a new list of known producers, sought for distinct raw pairs only; rows whose label differs
    are rewritten."""
    pairs = _raw(spark, d).select("s_suppkey", "extra", "recipient")
    label = lambda known: X.producer_label(F.col("extra"), F.col("recipient"), known)["key"]
    changed = pairs.select("s_suppkey", label(KNOWN).alias("old_key"), label(_NEW).alias("new_key")).where("NOT (old_key <=> new_key)")
    return V.blocks(spark, d).select("block_number").join(changed, F.col("block_number") % 10 == F.col("s_suppkey")).select("block_number", "old_key", "new_key")


@query("mnt14_backfill_missing", "SELECT block_number, item_index, coalesce(tip, CASE WHEN block_number % 9 <> 0 THEN fee // 2 END) AS tip, tip IS NULL AND block_number % 9 <> 0 AS filled FROM facts")
def mnt14(spark, d):
    """Tips that are missing are taken from a source of blocks; what is stored stays, and blocks whose hash in the
    source is another (every ninth) give nothing."""
    source = V.blocks(spark, d).where("items > 0").select("block_number", F.floor(F.col("fee") / 2).alias("found"), F.when(F.col("block_number") % 9 == 0, F.md5(F.lit("other"))).otherwise(F.md5(F.col("block_number").cast("string"))).alias("source_hash"))
    lacking = V.facts(spark, d).where("tip IS NULL").select("block_number").distinct()
    found = source.join(lacking, "block_number", "left_semi").where(F.col("source_hash") == F.md5(F.col("block_number").cast("string"))).select("block_number", "found")
    rows = V.facts(spark, d).select("block_number", "item_index", "tip").join(found, "block_number", "left")
    return rows.select("block_number", "item_index", F.coalesce("tip", "found").alias("tip"), (F.col("tip").isNull() & F.col("found").isNotNull()).alias("filled"))


def chain_ends(edges: DataFrame, depth: int = 32) -> DataFrame:
    """(replaced, replacement) -> (tx_hash, end): where each chain of replacements leads, by pointer jumping:
    each join doubles the steps, until none leads further. Lineage is cut at each."""
    hop = core.cut(edges.select(F.col("replaced").alias("tx_hash"), F.col("replacement").alias("end")))
    steps = 1
    while steps < depth:
        on = hop.select(F.col("tx_hash").alias("end"), F.col("end").alias("further"))
        moved = core.cut(hop.join(on, "end", "left").select("tx_hash", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")))
        hop, steps = moved.select("tx_hash", "end"), 2 * steps
        if moved.where("moved").isEmpty():
            break
    return hop


@query("j14_two_hop_chain", REPLACED.replace("WITH r", "WITH RECURSIVE r") + ", e AS (SELECT replaced, replacement FROM r WHERE replacement IS NOT NULL), c(tx_hash, hop, n) AS (SELECT replaced, replacement, 1 FROM e UNION ALL SELECT c.tx_hash, e.replacement, n + 1 FROM c JOIN e ON e.replaced = c.hop WHERE n < 32) SELECT tx_hash, arg_max(hop, n) AS \"end\" FROM c GROUP BY 1")
def j14(spark, d):
    return chain_ends(t4(spark, d).select("replaced", "replacement"))


_CONFIRMED = "k AS (SELECT tx_hash, (seen - 1704067200) // 720 + 1 AS confirmed FROM pending WHERE event_id % 5 = 0)"


def _confirmed(spark, d) -> DataFrame:
    return V.pending(spark, d).where("event_id % 5 = 0").select("tx_hash", (F.floor((F.col("seen") - V.START) / V.STEP) + 1).alias("confirmed"))


@query("mnt15_missed_repair", REPLACED.replace("WITH r", "WITH RECURSIVE r") + f", e AS (SELECT replaced, replacement FROM r WHERE replacement IS NOT NULL), z(tx_hash, hop) AS (SELECT replaced, replacement FROM e UNION ALL SELECT z.tx_hash, e.replacement FROM z JOIN e ON e.replaced = z.hop), g AS (SELECT tx_hash, hop FROM z WHERE hop NOT IN (SELECT replaced FROM e)), {_CONFIRMED}, x AS (SELECT c.*, least(k.confirmed, k2.confirmed) AS confirmed FROM candidates c LEFT JOIN k ON k.tx_hash = c.tx_hash LEFT JOIN g ON g.tx_hash = c.tx_hash LEFT JOIN k k2 ON k2.tx_hash = g.hop), m AS (SELECT block_number, count(*) FILTER (confirmed IS NULL OR confirmed >= block_number) AS pending, count(*) FILTER (reason = 'eligible' AND (confirmed IS NULL OR confirmed >= block_number)) AS skipped, CAST(coalesce(sum(wanted) FILTER (reason = 'eligible' AND (confirmed IS NULL OR confirmed >= block_number)), 0) AS BIGINT) AS skipped_items, max(tip) FILTER (reason = 'eligible' AND (confirmed IS NULL OR confirmed >= block_number)) AS max_tip, bool_or(confirmed < block_number) AS repaired FROM x GROUP BY 1) SELECT block_number, pending, skipped, skipped_items, max_tip FROM m WHERE repaired")
def mnt15(spark, d):
    """Rows of items that had been confirmed in a lower block, themselves or where their chain of replacements
    ends, are no misses: they go, and the aggregates of the blocks that they stood in are computed anew."""
    k = _confirmed(spark, d)
    through = chain_ends(t4(spark, d).select("replaced", "replacement")).join(k.withColumnRenamed("tx_hash", "end"), "end").select("tx_hash", "confirmed")
    first = k.union(through).groupBy("tx_hash").agg(F.min("confirmed").alias("confirmed"))
    c = V.candidates(spark, d).join(first, "tx_hash", "left").withColumn("wrong", F.coalesce(F.col("confirmed") < F.col("block_number"), F.lit(False)))
    blocks = c.where("wrong").select("block_number").distinct()
    anew = misses(c.where("NOT wrong").join(blocks, "block_number", "left_semi"))
    zero = {x: F.coalesce(x, F.lit(0)) for x in ("pending", "skipped", "skipped_items")}
    return blocks.join(anew, "block_number", "left").withColumns(zero)


@query("j9_semi_exists", REPLACED + f", {_CONFIRMED} SELECT tx_hash, actor FROM pending p WHERE EXISTS (SELECT 1 FROM k WHERE k.tx_hash = p.tx_hash) OR EXISTS (SELECT 1 FROM r WHERE r.replacement IS NOT NULL AND r.replaced = p.tx_hash)")
def j9(spark, d):
    """Pending items that may not come back: confirmed, or replaced and so remembered by a tombstone."""
    closed = _confirmed(spark, d).select("tx_hash").union(t4(spark, d).select("replaced"))
    return V.pending(spark, d).select("tx_hash", "actor").join(closed, "tx_hash", "left_semi")


@query("j10_anti_missing", "SELECT b.block_number FROM blocks b WHERE b.block_number NOT IN (SELECT block_number FROM producers WHERE block_number % 23 <> 5)")
def j10(spark, d):
    """Blocks without a row about their producer."""
    return V.blocks(spark, d).select("block_number").join(V.producers(spark, d).where("block_number % 23 <> 5").select("block_number"), "block_number", "left_anti")


@query("mnt16_range_replace", "SELECT block_number, item_index, actor FROM facts WHERE block_number < 500 OR block_number > 700 UNION ALL SELECT block_number, item_index, upper(actor) AS actor FROM facts WHERE block_number BETWEEN 500 AND 700 AND item_index % 2 = 0")
def mnt16(spark, d):
    """All rows of a range of blocks go, and what was loaded anew takes their place."""
    f = V.facts(spark, d).select("block_number", "item_index", "actor")
    loaded = f.where("block_number BETWEEN 500 AND 700 AND item_index % 2 = 0").withColumn("actor", F.upper("actor"))
    return f.where("NOT (block_number BETWEEN 500 AND 700)").unionByName(loaded)


KEEP = {"candidates": 7 * DAY, "replacements": 14 * DAY, "pending": DAY}


@query("mnt21_retention_prune", REPLACED + f" SELECT 'candidates' AS kind, count(*) FILTER (t >= {V.AS_OF - KEEP['candidates']}) AS kept, count(*) FILTER (t < {V.AS_OF - KEEP['candidates']}) AS dropped FROM candidates UNION ALL SELECT 'replacements', count(*) FILTER (replaced_at >= {V.AS_OF - KEEP['replacements']}), count(*) FILTER (replaced_at < {V.AS_OF - KEEP['replacements']}) FROM r WHERE replacement IS NOT NULL UNION ALL SELECT 'pending', count(*) FILTER (seen >= {V.AS_OF - KEEP['pending']}), count(*) FILTER (seen < {V.AS_OF - KEEP['pending']}) FROM pending")
def mnt21(spark, d):
    """What stays and what goes of each table past its cutoff."""
    parts = [(V.candidates(spark, d), "candidates", "t"), (t4(spark, d), "replacements", "replaced_at"), (V.pending(spark, d), "pending", "seen")]
    counts = [rows.agg(F.count_if(F.col(c) >= V.AS_OF - KEEP[kind]).alias("kept"), F.count_if(F.col(c) < V.AS_OF - KEEP[kind]).alias("dropped")).withColumn("kind", F.lit(kind)) for rows, kind, c in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("mnt22_guard_noop_update", "SELECT DISTINCT t - t % 3600 AS bucket, actor FROM facts WHERE item_index = 0 AND block_number % 50 = 1")
def mnt22(spark, d):
    """Keys that an update makes stale: rows of which only columns that no rollup reads have changed (a tip, in
    blocks ending in 2) make none."""
    old = V.facts(spark, d).withColumn("bucket", bucket(F.col("t"), 3600))
    changed = F.col("item_index") == 0
    new = old.withColumns({"cost": F.when(changed & (F.col("block_number") % 50 == 1), F.col("cost") + 1).otherwise(F.col("cost")), "tip": F.when(changed & (F.col("block_number") % 50 == 2), F.lit(1)).otherwise(F.col("tip"))})
    read = lambda rows, name: rows.select("block_number", "item_index", F.struct("bucket", "actor", "cost").alias(name))
    both = read(old, "o").join(read(new, "n"), ["block_number", "item_index"], "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    keys = both.select(F.explode(F.array("o", "n")).alias("k")).where("k IS NOT NULL")
    return keys.select("k.bucket", "k.actor").distinct()


@query("mnt24_last_seen_touch", f"WITH a AS (SELECT lower(actor) AS address, max(t) AS t FROM facts WHERE t >= {V.AS_OF - DAY} GROUP BY 1) SELECT r.address, r.name, greatest(1000, coalesce(a.t, 1000)) AS last_seen FROM registry r LEFT JOIN a USING (address)")
def mnt24(spark, d):
    """The registry's last sight moves up to that of the last day's items; others keep theirs."""
    active = V.facts(spark, d, V.AS_OF - DAY).groupBy(F.lower("actor").alias("address")).agg(F.max("t").alias("t"))
    rows = V.registry(spark, d).withColumn("stored", F.lit(1000).cast("long")).join(active, "address", "left")
    return rows.select("address", "name", F.greatest(F.col("stored"), F.coalesce("t", "stored")).alias("last_seen"))


@query("mnt25_registry_upsert", f"SELECT coalesce(b.address, r.address) AS address, coalesce(b.name, r.name) AS name, r.address IS NULL AS added FROM registry r FULL OUTER JOIN {_BEST.format(where='true')} b ON r.address = b.address")
def mnt25(spark, d):
    """Known actors put in or renamed by address."""
    new = best_claims(V.claims(spark, d)).select("address", F.col("name").alias("new"))
    rows = V.registry(spark, d).select("address", "name", F.lit(False).alias("added")).join(new, "address", "full_outer")
    return rows.select("address", F.coalesce("new", "name").alias("name"), F.coalesce("added", F.lit(True)).alias("added"))


_HASHES = "h AS (SELECT block_number AS n, md5(CAST(block_number AS VARCHAR)) AS parent_view, CASE WHEN block_number % 500 >= 500 - block_number // 500 - 1 THEN md5('fork' || block_number) ELSE md5(CAST(block_number AS VARCHAR)) END AS stored FROM blocks)"


def reorgs(chain: DataFrame, depth: int = 32) -> DataFrame:
    """``chain`` (n, stored, current): blocks whose stored hash isn't the current one, with the fork: the last block
    below, at most ``depth`` blocks back, on which both agree; what lies above it is void. Null beyond that depth.
    Agreeing blocks are sent to the numbers above them that don't agree, by equality."""
    wrong = chain.where("stored <> current").select("n")
    tops = wrong.join(wrong.select((F.col("n") - 1).alias("n"), F.lit(True).alias("above")), "n", "left").where("above IS NULL").select("n")
    below = tops.select(F.col("n").alias("top"), F.explode(F.sequence(F.col("n") - depth, F.col("n") - 1)).alias("n"))
    agreed = below.join(chain.where("stored = current").select("n"), "n").groupBy("top").agg(F.max("n").alias("fork"))
    return tops.select(F.col("n").alias("top")).join(agreed, "top", "left")


@query("t8_reorg_detect", f"WITH {_HASHES}, w AS (SELECT n FROM h WHERE stored <> parent_view), tops AS (SELECT n FROM w WHERE n + 1 NOT IN (SELECT n FROM w)) SELECT n AS top, (SELECT max(g.n) FROM h g WHERE g.n < tops.n AND g.n >= tops.n - 32 AND g.stored = g.parent_view) AS fork FROM tops")
def t8(spark, d):
    """The stored chain differs from the current one in the last blocks of every five hundred."""
    n = F.col("block_number")
    own = F.md5(n.cast("string"))
    stale = n % 500 >= F.lit(500) - F.floor(n / 500) - 1
    chain = V.blocks(spark, d).select(n.alias("n"), own.alias("current"), F.when(stale, F.md5(F.concat(F.lit("fork"), n))).otherwise(own).alias("stored"))
    return reorgs(chain)

