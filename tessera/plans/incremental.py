"""Ingest of nested blocks, and stored tables that follow changes: each query's SQL computes the outcome from scratch."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import present, wei_text
from tessera.operators import core
from tessera.plans.maintenance import _BEST, _BLOCK_ROLLUP, best_claims, block_rollup, grained
from tessera.plans.records import VC
from tessera.plans.registrar import registrar
from tessera.sources import nested
from tessera.sources import views as V

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)


def block_lines(spark, d) -> DataFrame:
    """The given events as lines of nested blocks: a transaction for each sender of a block, in the order of their
    first events, whose items are the events that are no errors (so some transactions have none)."""
    e = V._events(spark, d)
    tx = e.groupBy("b", "user_id").agg(F.min("event_id").alias("first"), F.array_sort(F.collect_list(F.when(F.col("event_type") != "error", F.col("event_id")))).alias("ids"))
    u, b = F.col("user_id"), F.col("b")
    made = F.struct(F.concat(F.lit("tx-"), u, F.lit("-"), b).alias("hash"), F.concat(F.lit("0xS"), u).alias("sender"), F.col("first").cast("long").alias("nonce"), F.when(b % 8 != 0, 500000000 + (u % 17) * 250000000).alias("tip"), F.transform("ids", lambda i: F.concat(F.lit("vh-"), i)).alias("item_hashes"))
    blocks = tx.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("first", made.alias("tx")))).alias("x"))
    block = F.struct(b.alias("number"), V.block_time(b).alias("time"), (F.lit(1000000007) * (1 + b % 97)).alias("fee"), F.col("x.tx").alias("transactions"))
    return blocks.select(F.when(b % 101 == 7, F.concat(F.lit("{broken "), b)).otherwise(F.to_json(block)).alias("value"))


_TX = "x AS (SELECT b, user_id, min(event_id) AS first, count(*) FILTER (event_type <> 'error') AS n FROM ev WHERE b % 101 <> 7 GROUP BY 1, 2), y AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY first) - 1 AS tx_index FROM x)"


@query("src1_nested_blocks", f"""WITH {_TX} SELECT e.b AS block_number, row_number() OVER (PARTITION BY e.b ORDER BY tx_index, event_id) - 1 AS item_index, tx_index, row_number() OVER (PARTITION BY e.b, tx_index ORDER BY event_id) - 1 AS ordinal,
'tx-' || e.user_id || '-' || e.b AS tx_hash, '0xS' || e.user_id AS actor, y.first AS nonce, CASE WHEN e.b % 8 <> 0 THEN 500000000 + (e.user_id % 17) * 250000000 END AS tip, 'vh-' || event_id AS content_hash, 1704067200 + (e.b + 1) * 720 AS t, 1000000007 * (1 + e.b % 97) AS fee
FROM ev e JOIN y ON y.b = e.b AND y.user_id = e.user_id WHERE event_type <> 'error'""")
def src1(spark, d):
    """Nested JSON blocks taken apart into items; broken lines (every hundredth or so) give none."""
    return nested.items(nested.parse(block_lines(spark, d)))


@query("src1_block_counts", f"WITH {_TX} SELECT b AS block_number, 1704067200 + (b + 1) * 720 AS t, count(*) AS transactions, CAST(sum(n) AS BIGINT) AS items FROM y GROUP BY b")
def src1_counts(spark, d):
    return nested.counts(nested.parse(block_lines(spark, d)))


def totals(rows: DataFrame) -> DataFrame:
    """Per actor: items, cost, the last time, and the label of the newest row that has one, with its place."""
    place = F.struct("t", "block_number", "item_index")
    label = present(F.col("label"))
    newest = F.max(F.when(label.isNotNull(), F.struct(place.alias("at"), label.alias("label"))))
    return rows.groupBy("actor").agg(F.count(F.lit(1)).alias("items"), F.sum("cost").cast(V.WEI).alias("cost"), F.max("t").alias("last_t"), newest.alias("named"))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ, as (old, new); null where a row came or went. Rows that share a key are paired in the order of
    their values, one to one, so what repeats is neither lost nor multiplied."""
    rest = [c for c in old.columns if c not in keys]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*(rest or keys)))
    image = lambda rows, name: rows.select(*keys, nth.alias("_nth"), F.struct(*keys, *rest).alias(name))
    return image(old, "old").join(image(new, "new"), [*keys, "_nth"], "full_outer").where("NOT (old <=> new)").select("old", "new")


def follow(stored: DataFrame, images: DataFrame, table: DataFrame) -> DataFrame:
    """``totals`` after changes given as (old, new) rows; ``table`` is the table after them. Counts and sums follow by signed deltas. An
    actor who lost the row of the last time or of the label has no other way than the rows that are left: those, and only those, are read again."""
    side = lambda name, sign: images.where(f"{name} IS NOT NULL").select(f"{name}.*", F.lit(sign).alias("sign"))
    moved = side("old", -1).unionByName(side("new", 1))
    place = F.struct("t", "block_number", "item_index")
    label = present(F.col("label"))
    came = F.col("sign") > 0
    delta = moved.groupBy("actor").agg(
        F.sum("sign").alias("d_items"), F.sum(F.col("sign") * F.col("cost")).cast(V.WEI).alias("d_cost"), F.max(F.when(came, F.col("t"))).alias("d_last"),
        F.max(F.when(came & label.isNotNull(), F.struct(place.alias("at"), label.alias("label")))).alias("d_named"),
        F.max(F.when(~came, F.col("t"))).alias("lost_t"), F.max(F.when(~came & label.isNotNull(), place)).alias("lost_at"),
    )
    both = stored.join(delta, "actor", "full_outer")
    stale = both.where("(lost_t >= last_t OR lost_at >= named.at) AND coalesce(items, 0) + d_items > 0").select("actor")
    anew = totals(table.join(stale, "actor", "left_semi"))
    merged = both.select("actor", (F.coalesce("items", F.lit(0)) + F.coalesce("d_items", F.lit(0))).alias("items"), (F.coalesce("cost", F.lit(0)) + F.coalesce("d_cost", F.lit(0))).cast(V.WEI).alias("cost"), F.greatest("last_t", "d_last").alias("last_t"), F.greatest("named", "d_named").alias("named"))
    return core.upsert(merged.where("items > 0"), anew, ["actor"])


_AFTER = """a AS (SELECT block_number, item_index, CASE WHEN block_number % 19 = 4 THEN actor || 'x' ELSE actor END AS actor, CASE WHEN block_number % 3 = 1 THEN '' WHEN block_number % 29 = 5 THEN 'New ' || (block_number % 4) ELSE label END AS label,
    CASE WHEN block_number % 5 = 2 THEN cost + 1 ELSE cost END AS cost, t FROM facts WHERE NOT (block_number % 7 = 3 AND item_index % 2 = 1) AND actor <> '0xS11'
    UNION ALL SELECT block_number, item_index + 1000, '0xS11y', label, cost, t FROM facts WHERE block_number % 31 = 6)"""


def changed_facts(rows: DataFrame) -> DataFrame:
    """The table after rows came, went and changed: other actors, labels cleared and set, other costs."""
    b = F.col("block_number")
    kept = rows.where("NOT (block_number % 7 = 3 AND item_index % 2 = 1) AND actor <> '0xS11'")
    actor: Column = F.when(b % 19 == 4, F.concat("actor", F.lit("x"))).otherwise(F.col("actor"))
    label = F.when(b % 3 == 1, "").when(b % 29 == 5, F.concat(F.lit("New "), b % 4)).otherwise(F.col("label"))
    kept = kept.select("block_number", "item_index", actor.alias("actor"), label.alias("label"), F.when(b % 5 == 2, F.col("cost") + 1).otherwise(F.col("cost")).cast(V.WEI).alias("cost"), "t")
    came = rows.where("block_number % 31 = 6").select("block_number", F.col("item_index") + 1000, F.lit("0xS11y"), "label", "cost", "t")
    return kept.union(came)


@query("mnt3_totals_from_images", f"""WITH {_AFTER}, l AS (SELECT actor, trim(label) AS label, row_number() OVER (PARTITION BY actor ORDER BY t DESC, block_number DESC, item_index DESC) AS r FROM a WHERE trim(label) <> '')
SELECT actor, count(*) AS items, {VC.format('sum(cost)')} AS cost, max(t) AS last_t, any_value(l.label) AS label FROM a LEFT JOIN l USING (actor) WHERE r IS NULL OR r = 1 GROUP BY actor""")
def mnt3_images(spark, d):
    """Totals per actor, brought up to date from the changed rows' two images."""
    before = V.facts(spark, d).select("block_number", "item_index", "actor", "label", "cost", "t")
    after = changed_facts(before)
    rows = follow(core.cut(totals(before)), core.cut(changes(before, after, ["block_number", "item_index"])), after)
    return rows.select("actor", "items", wei_text(F.col("cost")).alias("cost"), "last_t", F.col("named.label").alias("label"))


def kinds_of(blocks: DataFrame) -> DataFrame:
    """Blocks by kind: full, above target, without items, below target."""
    i = F.col("items")
    of = F.when(i >= V.MAX, F.array(F.lit("full"), F.lit("above_target"))).when(i > V.TARGET, F.array(F.lit("above_target"))).when(i == 0, F.array(F.lit("drought"), F.lit("below_target"))).when(i < V.TARGET, F.array(F.lit("below_target")))
    return blocks.select(F.col("block_number").alias("n"), F.explode(of).alias("kind"))


def follow_runs(stored: DataFrame, changed: list[tuple[int, int]], rows_of) -> DataFrame:
    """Stored runs (kind, first, last, length) after the blocks of some ranges have changed. A range is widened to the
    stored runs that it meets or adjoins; what lies inside is rebuilt, and no other row is read: ``rows_of(lo, hi)`` gives kinds
    of blocks lo to hi. Runs and kinds that a range meets are few, two a kind besides those inside it, so their outer ends come to the driver."""
    meets = lambda a, b: stored.where((F.col("last") >= a - 1) & (F.col("first") <= b + 1))
    wide: list[tuple[int, int, int, int]] = []
    for a, b in sorted(changed):
        while True:
            ends = meets(a, b).agg(F.min("first").alias("lo"), F.max("last").alias("hi")).first()
            lo, hi = min(a, ends.lo if ends.lo is not None else a), max(b, ends.hi if ends.hi is not None else b)
            if not wide or wide[-1][3] < lo - 1:
                break
            a, b = wide[-1][0], max(b, wide[-1][1])  # both changes touch one run, or adjoin
            wide.pop()
        wide.append((a, b, lo, hi))
    out, gone = None, F.lit(False)
    for a, b, lo, hi in wide:
        met = meets(a, b)
        own = met.groupBy("kind").agg(F.least(F.min("first"), F.lit(a)).alias("lo"), F.greatest(F.max("last"), F.lit(b)).alias("hi"))
        near = rows_of(lo, hi).join(own, "kind", "left").where((F.col("n") >= F.coalesce("lo", F.lit(a))) & (F.col("n") <= F.coalesce("hi", F.lit(b)))).select("kind", "n")
        built = core.islands(near, ["kind"], "n", span=1000)
        gone = gone | (F.col("last") >= a - 1) & (F.col("first") <= b + 1)
        out = built if out is None else out.unionByName(built)
    kept = stored.where(~gone)
    return (kept if out is None else kept.unionByName(out)).select("kind", "first", "last", "length")


#: Ranges of blocks that change in the middle of history, and how: items fall to none, or rise.
CHANGED = [(300, 340), (1000, 1100), (1700, 1701)]
_NEW_ITEMS = "CASE WHEN {} THEN CASE WHEN block_number % 3 = 0 THEN 0 ELSE items + 3 END ELSE items END".format(" OR ".join(f"block_number BETWEEN {a} AND {b}" for a, b in CHANGED))


@query("mnt6_streaks_middle", f"""WITH b2 AS (SELECT block_number, {_NEW_ITEMS} AS items FROM blocks),
k AS (SELECT block_number AS n, unnest(CASE WHEN items >= 6 THEN ['full', 'above_target'] WHEN items > 3 THEN ['above_target'] WHEN items = 0 THEN ['drought', 'below_target'] WHEN items < 3 THEN ['below_target'] ELSE [] END) AS kind FROM b2),
g AS (SELECT kind, n, n - row_number() OVER (PARTITION BY kind ORDER BY n) AS grp FROM k) SELECT kind, min(n) AS first, max(n) AS last, count(*) AS length FROM g GROUP BY kind, grp""")
def mnt6_middle(spark, d):
    """Runs after changes in the middle: the scans for the rebuilt parts are bounded by the widened ranges."""
    stored = core.cut(core.islands(kinds_of(V.blocks(spark, d)), ["kind"], "n", span=1000))

    def rows_of(lo: int, hi: int) -> DataFrame:
        at = lambda n: V.START + (n + 1) * V.STEP
        near = V.blocks(spark, d, at(lo), at(hi + 1)).where(f"block_number BETWEEN {lo} AND {hi}")
        return kinds_of(near.withColumn("items", F.expr(_NEW_ITEMS)))

    return follow_runs(stored, CHANGED, rows_of)


_SUMS = ("items", "cost", "size_fee")


def item_sums(rows: DataFrame) -> DataFrame:
    """Additive sums per hour and actor."""
    size_fee = F.sum(F.col("fee").cast("decimal(18,0)") * F.lit(V.ITEM).cast("decimal(6,0)")).cast(V.WEI)
    return rows.groupBy((F.col("t") - F.pmod("t", F.lit(3600))).alias("bucket"), "actor").agg(F.count(F.lit(1)).alias("items"), F.sum("cost").cast(V.WEI).alias("cost"), size_fee.alias("size_fee"))


@query("mnt5_rollup_from_images", f"""WITH a AS (SELECT CASE WHEN block_number % 19 = 4 THEN actor || 'x' ELSE actor END AS actor, CASE WHEN block_number % 5 = 2 THEN cost + 1 ELSE cost END AS cost, fee, t FROM facts WHERE NOT (block_number % 7 = 3 AND item_index % 2 = 1) AND block_number % 43 <> 9)
SELECT t - t % 3600 AS bucket, actor, count(*) AS items, {VC.format('sum(cost)')} AS cost, {VC.format('sum(CAST(fee AS HUGEINT) * 131072)')} AS size_fee FROM a GROUP BY 1, 2""")
def mnt5_images(spark, d):
    """Sums per hour and actor after rows went and changed: what the old images held is taken away, what the new
    ones hold is added, and sums that fall to 0 go."""
    columns = ("block_number", "item_index", "actor", "cost", "fee", "t")
    before, b = V.facts(spark, d).select(*columns), F.col("block_number")
    after = before.where("NOT (block_number % 7 = 3 AND item_index % 2 = 1) AND block_number % 43 <> 9").withColumns({"actor": F.when(b % 19 == 4, F.concat("actor", F.lit("x"))).otherwise(F.col("actor")), "cost": F.when(b % 5 == 2, F.col("cost") + 1).otherwise(F.col("cost")).cast(V.WEI)})
    moved = core.cut(changes(before, after, ["block_number", "item_index"]))
    gone, came = (item_sums(moved.where(f"{x} IS NOT NULL").select(f"{x}.*")) for x in ("old", "new"))
    delta = core.merge(came, gone.withColumns({c: -F.col(c) for c in _SUMS}), ["bucket", "actor"], list(_SUMS))
    rows = core.merge(item_sums(before), delta, ["bucket", "actor"], list(_SUMS))
    return rows.select("bucket", "actor", F.col("items").cast("long").alias("items"), wei_text(F.col("cost")).alias("cost"), wei_text(F.col("size_fee")).alias("size_fee"))


_LOST = "block_number % 150 BETWEEN 40 AND 62"


@query("mnt4_rollup_after_deletes", f"WITH b2 AS (SELECT * REPLACE (CASE WHEN block_number % 37 = 5 THEN fee + 9 ELSE fee END AS fee) FROM blocks WHERE NOT ({_LOST})) " + _BLOCK_ROLLUP.replace("FROM blocks", "FROM b2"))
def mnt4_deletes(spark, d):
    """Rollups of blocks after some went and some changed: buckets that either image touches are computed anew from
    the blocks that are left; a bucket that lost its last block goes."""
    keys = ["seconds", "bucket"]
    before = core.cut(V.blocks(spark, d))
    after = before.where(f"NOT ({_LOST})").withColumn("fee", F.when(F.col("block_number") % 37 == 5, F.col("fee") + 9).otherwise(F.col("fee")))
    moved = core.cut(changes(before, after, ["block_number"]))
    images = moved.select("old.*").unionByName(moved.select("new.*")).where("t IS NOT NULL")
    touched = core.cut(grained(images).select(*keys).distinct())
    near = after.join(touched.where("seconds = 86400").select(F.col("bucket").alias("day")), F.col("t") - F.col("t") % 86400 == F.col("day"), "left_semi")
    anew = block_rollup(near).join(touched, keys, "left_semi")
    return block_rollup(before).join(touched, keys, "left_anti").unionByName(anew)


def fingerprint(definition: DataFrame) -> str:
    """A text that says which rows a definition has, in any order."""
    h = [F.xxhash64(F.lit(seed), *definition.columns) for seed in (1, 2)]
    r = definition.agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(x).alias(f"x{i}") for i, x in enumerate(h)), *(F.sum(x.cast("decimal(38,0)")).alias(f"s{i}") for i, x in enumerate(h))).first()
    return ":".join(map(str, r))


def rewrite(spark, path: str, part: str, key: str, changed: DataFrame, definition: DataFrame, relabel) -> list:
    """Brings a stored table (partitioned by ``part``) in line with a new definition of its labels: partitions that hold a
    changed ``key`` are put in place anew through ``relabel``, others keep their files. Nothing is read if the definition
    that the table was made by is the same. The parts that were rewritten; the definition's fingerprint is stored last, so a
    run that fails is repeated."""
    mark = fingerprint(definition)
    try:
        known = spark.read.schema("mark string").parquet(f"{path}-definition").first().mark
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known == mark:
        return []
    table = spark.read.parquet(path)
    hit = sorted(r[0] for r in table.select(part, key).join(changed.select(key), key, "left_semi").select(part).distinct().collect())
    if hit:
        staging = f"{path}-staging-{uuid.uuid4().hex}"
        relabel(table.where(F.col(part).isin(hit))).select(table.columns).write.parquet(staging)
        spark.read.schema(table.schema).parquet(staging).hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").parquet(f"{path}-definition")
    return hit


def labelled(rows: DataFrame, claims: DataFrame) -> DataFrame:
    names = best_claims(claims).select("address", F.col("name").alias("claimed"))
    return rows.withColumn("address", F.lower("actor")).join(names, "address", "left").withColumn("label", F.coalesce("claimed", F.lit(""))).drop("claimed")


@query("mnt10_labels_rewritten", f"SELECT f.block_number, f.item_index, f.actor, coalesce(b.name, '') AS label FROM facts f LEFT JOIN {_BEST.format(where='claim % 10 <> 7')} b ON lower(f.actor) = b.address")
def mnt10_rewritten(spark, d):
    """Items stored with the labels of one claims file, brought in line with the next one."""
    c = V.claims(spark, d)
    old, new = c.where("claim % 10 <> 3"), c.where("claim % 10 <> 7")
    path = f"{core.shared_dir(spark)}/labels-{uuid.uuid4().hex}"
    rows = V.facts(spark, d).select("block_number", "item_index", "actor", F.floor(F.col("block_number") / 1000).alias("part"))
    labelled(rows, old).hint("rebalance", "part").write.partitionBy("part").parquet(path)
    a, b = (best_claims(x).select("address", F.col("name").alias(n)) for x, n in ((old, "was"), (new, "is")))
    changed = a.join(b, "address", "full_outer").where("NOT (was <=> is)")
    rewrite(spark, path, "part", "address", changed, new.select("address", "name", "status", "confidence", "valid_from", "valid_to"), lambda t: labelled(t.drop("label"), new))
    return spark.read.parquet(path).select("block_number", "item_index", "actor", "label")
