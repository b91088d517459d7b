"""Look-ups across confirmed and pending rows, search, derived columns, set operations and primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions.exprs import bucket, wei_text
from tessera.operators import core
from tessera.plans.charts import SLUG
from tessera.plans.records import KINDS
from tessera.sources import views as V

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = V.sql(sql)
        return f

    return add


EVERY = "WITH every AS (SELECT tx_hash, content_hash, block_number, item_index, t, actor, true AS confirmed FROM facts UNION ALL SELECT tx_hash, content_hash, -1 AS block_number, unnest(range(0, items)) AS item_index, seen AS t, actor, false AS confirmed FROM pending)"
SHAPE = ["tx_hash", "content_hash", "block_number", "item_index", "t", "actor", "confirmed"]


def every(spark, d) -> DataFrame:
    """Confirmed and pending items in one shape; a pending one has block -1 and its place in its transaction."""
    p = V.pending(spark, d).select("tx_hash", "content_hash", F.lit(-1).cast("long").alias("block_number"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("items") - 1)).alias("item_index"), F.col("seen").alias("t"), "actor", F.lit(False).alias("confirmed"))
    return V.facts(spark, d).withColumn("confirmed", F.lit(True)).select(*SHAPE).unionByName(p)


def best(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The best row of each key: an aggregate with map-side parts, not a sort."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in SHAPE if c != key)), F.struct(*order)).alias("b")).select(key, "b.*")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block_number", F.when(F.col("confirmed"), F.col("block_number")))


@query("u1_union_confirmed_pending", EVERY + " SELECT tx_hash, content_hash, CASE WHEN confirmed THEN block_number END AS block_number, item_index, t, actor, confirmed FROM every")
def u1(spark, d):
    return _shown(every(spark, d))


_PICK = " SELECT * EXCLUDE (rn, block_number), CASE WHEN confirmed THEN block_number END AS block_number FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM every) WHERE rn = 1"


def by_tx(rows: DataFrame) -> DataFrame:
    return best(rows, "tx_hash", [~F.col("confirmed"), F.col("item_index"), -F.col("block_number")])


@query("q5_item_by_tx", EVERY + _PICK.format(key="tx_hash", order="confirmed DESC, item_index, block_number DESC"))
def q5(spark, d):
    """Confirmed before pending, then the first item."""
    return _shown(by_tx(every(spark, d)))


@query("q6_item_by_content_hash", EVERY + _PICK.format(key="content_hash", order="confirmed DESC, block_number DESC, t DESC, tx_hash, item_index"))
def q6(spark, d):
    """Confirmed before pending, then the newest inclusion."""
    return _shown(best(every(spark, d), "content_hash", [~F.col("confirmed"), -F.col("block_number"), -F.col("t"), F.col("tx_hash"), F.col("item_index")]))


@query("j16_batch_lookup", EVERY + ", k AS (SELECT DISTINCT 'tx-' || user_id || '-' || b AS tx_hash FROM ev), x AS (" + _PICK.format(key="tx_hash", order="confirmed DESC, item_index, block_number DESC") + ") SELECT k.tx_hash, x.tx_hash IS NOT NULL AS found, x.block_number, x.item_index FROM k LEFT JOIN x ON k.tx_hash = x.tx_hash")
def j16(spark, d):
    """A table of asked hashes against both kinds of rows; hashes that nobody has stay, unfound."""
    asked = V._events(spark, d).select(F.concat(F.lit("tx-"), "user_id", F.lit("-"), "b").alias("tx_hash")).distinct()
    found = _shown(by_tx(every(spark, d).join(asked, "tx_hash", "left_semi"))).select("tx_hash", F.lit(True).alias("found"), "block_number", "item_index")
    return asked.join(found, "tx_hash", "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("q65_latest_pending_rows", EVERY + f" SELECT tx_hash, actor, t, item_index FROM (SELECT *, row_number() OVER (PARTITION BY tx_hash ORDER BY t DESC, item_index) AS rn FROM every WHERE NOT confirmed AND t >= {V.AS_OF - 86400}) WHERE rn = 1")
def q65(spark, d):
    """The first row of each transaction that is new since the last look."""
    new = every(spark, d).where(f"NOT confirmed AND t >= {V.AS_OF - 86400}")
    return best(new, "tx_hash", [-F.col("t"), F.col("item_index")]).select("tx_hash", "actor", "t", "item_index")


@query("l4_missed_by_tip", "SELECT block_number, tx_hash, tip, rank FROM (SELECT *, row_number() OVER (PARTITION BY block_number ORDER BY tip DESC NULLS LAST, tx_hash) AS rank FROM candidates) WHERE rank <= 3")
def l4(spark, d):
    return core.top_k(V.candidates(spark, d), ["block_number"], [F.desc_nulls_last("tip"), F.col("tx_hash")], 3).select("block_number", "tx_hash", "tip", "rank")


SAMPLE = 500


@query("l5_sample_cap", f"WITH s AS (SELECT *, row_number() OVER (ORDER BY seen DESC, tx_hash) AS rn FROM pending) SELECT count(*) FILTER (rn <= {SAMPLE}) AS txs, CAST(sum(items) FILTER (rn <= {SAMPLE}) AS BIGINT) AS items, max(rn) > {SAMPLE} AS truncated FROM s WHERE rn <= {SAMPLE} + 1")
def l5(spark, d):
    """One row beyond the cap tells whether the sample, which is the feature, is all."""
    newest = V.pending(spark, d).orderBy(F.desc("seen"), "tx_hash").limit(SAMPLE + 1).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("seen"), "tx_hash")))
    inside = F.col("rn") <= SAMPLE
    return newest.agg(F.count_if(inside).alias("txs"), F.sum(F.when(inside, F.col("items"))).alias("items"), (F.max("rn") > SAMPLE).alias("truncated"))


@query("prj3_cost_headroom", """WITH x AS (SELECT p.tx_hash, CAST(b.fee AS HUGEINT) * 131072 AS realized, CAST(p.max_fee AS HUGEINT) * 131072 AS most FROM pending p LEFT JOIN blocks b ON b.block_number = (p.seen - 1704067200) // 720),
    y AS (SELECT *, most - realized AS headroom, (abs(most - realized) * 200000000 + most) // (2 * most) AS q FROM x)
    SELECT tx_hash, CAST(realized AS VARCHAR) AS realized, CAST(most AS VARCHAR) AS most, CAST(headroom AS VARCHAR) AS headroom, CASE WHEN headroom < 0 THEN '-' ELSE '' END || CAST(q // 1000000 AS VARCHAR) || '.' || lpad(CAST(q % 1000000 AS VARCHAR), 6, '0') AS headroom_percent FROM y""")
def prj3(spark, d):
    """What a transaction would have paid in the block under way, what it was ready to pay, and what that leaves.
    Each is null if an input is missing."""
    b = V.blocks(spark, d).select("block_number", "fee")
    p = V.pending(spark, d).withColumn("block_number", F.floor((F.col("seen") - V.START) / V.STEP)).join(b, "block_number", "left")
    cost = lambda c: F.when(F.col(c) >= 0, F.col(c).cast("decimal(18,0)") * F.lit(V.ITEM).cast("decimal(18,0)")).cast(V.WEI)
    rows = p.select("tx_hash", cost("fee").alias("r"), cost("max_fee").alias("m")).withColumn("h", F.col("m") - F.col("r"))
    return rows.select("tx_hash", wei_text(F.col("r")).alias("realized"), wei_text(F.col("m")).alias("most"), wei_text(F.col("h")).alias("headroom"), X.percent_text(F.col("h"), F.col("m")).alias("headroom_percent"))


_LIMITS = "SELECT block_number, items * 131072 AS used, CASE WHEN target_gas > 0 THEN target_gas WHEN params_target > 0 THEN params_target * 131072 ELSE 0 END AS target, CASE WHEN limit_gas > 0 THEN limit_gas WHEN params_max > 0 THEN params_max * 131072 ELSE 0 END AS cap FROM blocks"


def _limits(spark, d) -> DataFrame:
    gas = lambda g, p: X.first_positive(F.col(g), F.col(p) * V.ITEM)
    return V.blocks(spark, d).select("block_number", (F.col("items") * V.ITEM).alias("used"), gas("target_gas", "params_target").alias("target"), gas("limit_gas", "params_max").alias("cap"))


@query("prj7_effective_limits", _LIMITS)
def prj7(spark, d):
    """Gas columns where they are set, else parameters times the gas of an item, else 0."""
    return _limits(spark, d)


@query("prj8_utilization_ratio", f"SELECT block_number, CASE WHEN target > 0 THEN round(CAST(used AS DOUBLE) / target, 6) ELSE 0.0 END AS ratio FROM ({_LIMITS})")
def prj8(spark, d):
    return _limits(spark, d).select("block_number", F.coalesce(F.round(F.try_divide(F.col("used").cast("double"), F.col("target").cast("double")), 6), F.lit(0.0)).alias("ratio"))


@query("prj10_hash_list", "SELECT f.block_number, f.item_index, l.hashes FROM facts f JOIN (SELECT block_number, tx_hash, string_agg(content_hash, ',' ORDER BY item_index) AS hashes FROM facts GROUP BY 1, 2) l USING (block_number, tx_hash)")
def prj10(spark, d):
    """The hashes of all items of the row's transaction, in order; a transaction holds few. A window over
    block and transaction gives them without a join."""
    whole = F.array_sort(F.collect_list(F.struct("item_index", "content_hash")).over(Window.partitionBy("block_number", "tx_hash")))
    return V.facts(spark, d).select("block_number", "item_index", F.array_join(F.transform(whole, lambda x: x["content_hash"]), ",").alias("hashes"))


#: Public explorers by chain.
EXPLORERS = {1: "https://etherscan.io", 11155111: "https://sepolia.etherscan.io"}


@query("prj12_explorer_urls", EVERY + f", u AS (SELECT DISTINCT '0x' || sha256(tx_hash) AS h, '0x' || left(sha256(actor), 40) AS a, confirmed, block_number FROM every) SELECT '{EXPLORERS[1]}/tx/' || h AS tx_url, '{EXPLORERS[1]}/address/' || a AS address_url, CASE WHEN confirmed AND block_number > 0 THEN '{EXPLORERS[1]}/block/' || block_number ELSE '' END AS block_url FROM u")
def prj12(spark, d, chain: int = 1):
    """Addresses of pages about a transaction, its sender and, once confirmed, its block; none for chains
    without a known explorer or malformed hashes."""
    base = F.lit(EXPLORERS.get(chain, ""))
    h, a = F.concat(F.lit("0x"), F.sha2(F.col("tx_hash").cast("binary"), 256)), F.concat(F.lit("0x"), F.left(F.sha2(F.col("actor").cast("binary"), 256), F.lit(40)))
    rows = every(spark, d).select(h.alias("h"), a.alias("a"), "confirmed", "block_number").distinct()
    link = lambda fine, kind, x: F.when((base != "") & fine, F.concat(base, F.lit(f"/{kind}/"), x)).otherwise("")
    return rows.select(link(F.rlike("h", F.lit("^0x[0-9a-fA-F]{64}$")), "tx", F.col("h")).alias("tx_url"), link(F.rlike("a", F.lit("^0x[0-9a-fA-F]{40}$")), "address", F.col("a")).alias("address_url"), link(F.col("confirmed") & (F.col("block_number") > 0), "block", F.col("block_number").cast("string")).alias("block_url"))


@query("prj13_producer_payment", "WITH l AS (SELECT block_number, arg_max(actor, item_index) AS sender, arg_max(cost, item_index) AS cost, upper(arg_min(actor, item_index)) AS recipient FROM facts GROUP BY 1) SELECT block_number, recipient, CASE WHEN lower(sender) = lower(recipient) THEN CAST(CAST(cost AS DECIMAL(38,0)) AS VARCHAR) END AS payment FROM l")
def prj13(spark, d):
    """The value of a block's last transaction if its sender is the fee recipient, whatever the case of letters.
    The sender of the first item stands for the recipient."""
    last = V.facts(spark, d).groupBy("block_number").agg(F.max_by(F.struct("actor", "cost"), "item_index").alias("l"), F.upper(F.min_by("actor", "item_index")).alias("recipient"))
    return last.select("block_number", "recipient", F.when(F.lower("l.actor") == F.lower("recipient"), wei_text(F.col("l.cost"))).alias("payment"))


#: Known producers in order: text to find, key, name.
KNOWN = [("supplier#00000000", "zero", "Group Zero"), ("000001", "one", "Group One"), ("supplier#00000001", "late", "Never reached")]
_RAW = "SELECT s_suppkey, '0xP' || lpad(CAST(s_suppkey AS VARCHAR), CAST(s_suppkey % 20 AS INTEGER), 'A') AS recipient, CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN chr(255) || s_name WHEN 2 THEN '' WHEN 3 THEN '  ab ' ELSE ' My (' || s_suppkey || ') Builder.x  ' END AS raw FROM supplier"


def _raw(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    raw = F.when(k % 5 == 0, F.col("s_name")).when(k % 5 == 1, F.concat(F.lit("ÿ"), "s_name")).when(k % 5 == 2, "").when(k % 5 == 3, "  ab ").otherwise(F.concat(F.lit(" My ("), k, F.lit(") Builder.x  ")))
    return V.read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("0xP"), F.lpad(k.cast("string"), (k % 20).cast("int"), F.lit("A"))).alias("recipient"), F.concat(F.lit("0x"), F.hex(F.encode(raw, "ISO-8859-1"))).alias("extra"))


@query("prj14_producer_label", f"""WITH x AS ({_RAW}), y AS (SELECT *, trim(raw) AS label, lower(recipient) AS a FROM x), z AS (SELECT *, CASE WHEN label ~ '^[ -~]{{3,}}$' THEN label ELSE '' END AS l FROM y)
    SELECT s_suppkey, CASE WHEN contains(lower(raw), '{KNOWN[0][0]}') THEN '{KNOWN[0][1]}' WHEN contains(lower(raw), '{KNOWN[1][0]}') THEN '{KNOWN[1][1]}' WHEN l <> '' THEN 'extra:' || trim(regexp_replace(lower(l), '[^a-z0-9]+', '-', 'g'), '-') ELSE 'addr:' || a END AS key,
    CASE WHEN contains(lower(raw), '{KNOWN[0][0]}') THEN '{KNOWN[0][2]}' WHEN contains(lower(raw), '{KNOWN[1][0]}') THEN '{KNOWN[1][2]}' WHEN l <> '' THEN l WHEN length(a) < 12 THEN a ELSE left(a, 6) || '…' || right(a, 4) END AS name FROM z""")
def prj14(spark, d):
    return _raw(spark, d).select("s_suppkey", X.producer_label(F.col("extra"), F.col("recipient"), KNOWN).alias("l")).select("s_suppkey", "l.key", "l.name")


@query("prj15_extra_text", f"SELECT s_suppkey, CASE WHEN raw ~ '^[ -~]+$' THEN trim(raw) ELSE '' END AS text FROM ({_RAW})")
def prj15(spark, d):
    return _raw(spark, d).select("s_suppkey", X.extra_text(F.col("extra")).alias("text"))


_NAMES = "(SELECT name, address FROM registry UNION SELECT name, address FROM claims WHERE status <> 'disputed')"


def names(spark, d) -> DataFrame:
    return V.registry(spark, d).select("name", "address").union(V.claims(spark, d).where("status <> 'disputed'").select("name", "address")).distinct()


@query("f5_prefix_search", f"WITH n AS (SELECT DISTINCT name FROM {_NAMES}), k AS (SELECT DISTINCT left(lower(n_name), 1 + n_nationkey % 7) AS prefix FROM nation UNION SELECT 'rollup nation_1' UNION SELECT 'claim' UNION SELECT 'r_' UNION SELECT '%') SELECT prefix, name, rank FROM (SELECT prefix, name, row_number() OVER (PARTITION BY prefix ORDER BY name) AS rank FROM k JOIN n ON starts_with(lower(name), prefix)) WHERE rank <= 10")
def f5(spark, d):
    """At most ten names by prefix; nothing in a prefix is a pattern. Names are opened into their prefixes, so
    the join is one of equality."""
    asked = V.read(spark, d, "nation").select(F.expr("left(lower(n_name), 1 + n_nationkey % 7)").alias("prefix")).union(spark.createDataFrame([("rollup nation_1",), ("claim",), ("r_",), ("%",)], "prefix string")).distinct()
    opened = names(spark, d).select("name").distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.lower("name"), F.lit(1), i))))
    return core.top_k(opened.join(asked, "prefix"), ["prefix"], [F.col("name")], 10).select("prefix", "name", "rank")


_KEYS = """WITH k AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN CASE WHEN c_custkey >= 1000 THEN (c_custkey // 1000) || ',' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END
    WHEN 1 THEN upper('0x' || sha256('tx-' || (c_custkey % 100) || '-' || c_custkey)) WHEN 2 THEN '0x' || sha256('vh-' || (c_custkey - c_custkey % 3)) WHEN 3 THEN '0x' || left(sha256('0xS' || c_custkey), 40)
    WHEN 4 THEN 'Rollup NATION_' || (c_custkey % 40) ELSE '0x' || c_custkey END AS text FROM customer)"""


@query("q58_classify_lookup", EVERY.replace("WITH every", _KEYS + ", every") + f""", bl AS (SELECT id, 'block' AS kind, CAST(b.block_number AS VARCHAR) AS found FROM k JOIN blocks b ON k.text ~ '^[0-9,]*[0-9][0-9,]*$' AND TRY_CAST(replace(k.text, ',', '') AS BIGINT) = b.block_number),
    tx AS (SELECT DISTINCT id, 'transaction' AS kind, e.tx_hash AS found FROM k JOIN every e ON lower(k.text) = '0x' || sha256(e.tx_hash)), ch AS (SELECT DISTINCT id, 'content' AS kind, e.content_hash AS found FROM k JOIN every e ON lower(k.text) = '0x' || sha256(e.content_hash)),
    ad AS (SELECT DISTINCT id, 'actor' AS kind, f.actor AS found FROM k JOIN facts f ON lower(k.text) = '0x' || left(sha256(f.actor), 40)),
    nm AS (SELECT id, 'name' AS kind, name AS found FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY name) AS rank FROM k JOIN (SELECT DISTINCT name FROM {_NAMES}) n ON k.text !~ '^0[xX]' AND k.text !~ '^[0-9,]*[0-9][0-9,]*$' AND length(k.text) <= 128 AND starts_with(lower(n.name), lower(k.text))) WHERE rank <= 10)
    SELECT * FROM bl UNION ALL SELECT * FROM tx UNION ALL SELECT * FROM ch UNION ALL SELECT * FROM ad UNION ALL SELECT * FROM nm""")
def q58(spark, d):
    """A table of free texts, told apart by their form: block numbers (commas allowed), 32-byte hashes of a
    transaction or content, 20-byte addresses, else the start of a name. Every join is one of equality."""
    c = F.col("c_custkey")
    digest = lambda x: F.concat(F.lit("0x"), F.sha2(x.cast("binary"), 256))
    short = lambda x: F.concat(F.lit("0x"), F.left(F.sha2(x.cast("binary"), 256), F.lit(40)))
    whole = F.when(c >= 1000, F.concat(F.floor(c / 1000), F.lit(","), F.lpad((c % 1000).cast("string"), 3, "0"))).otherwise(c.cast("string"))
    text = F.when(c % 6 == 0, whole).when(c % 6 == 1, F.upper(digest(F.concat(F.lit("tx-"), c % 100, F.lit("-"), c)))).when(c % 6 == 2, digest(F.concat(F.lit("vh-"), c - c % 3)))
    text = text.when(c % 6 == 3, short(F.concat(F.lit("0xS"), c))).when(c % 6 == 4, F.concat(F.lit("Rollup NATION_"), c % 40)).otherwise(F.concat(F.lit("0x"), c))
    keys = V.read(spark, d, "customer").select(c.alias("id"), text.alias("text")).where(F.length("text") <= 128)
    is_number, is_hex = F.rlike("text", F.lit("^[0-9,]*[0-9][0-9,]*$")), F.rlike("text", F.lit("^0[xX]"))
    row = lambda kind, found: ("id", F.lit(kind).alias("kind"), found.alias("found"))
    numbers = keys.where(is_number).withColumn("block_number", F.expr("try_cast(replace(text, ',', '') AS bigint)"))
    bl = numbers.join(V.blocks(spark, d).select("block_number"), "block_number").select(*row("block", F.col("block_number").cast("string")))
    lower = keys.where(is_hex).withColumn("key", F.lower("text"))
    hashes, addresses = lower.where(F.length("key") == 66), lower.where(F.length("key") == 42)
    rows = every(spark, d)
    tx = hashes.join(rows.select("tx_hash").distinct().withColumn("key", digest(F.col("tx_hash"))), "key").select(*row("transaction", F.col("tx_hash")))
    ch = hashes.join(rows.select("content_hash").distinct().withColumn("key", digest(F.col("content_hash"))), "key").select(*row("content", F.col("content_hash")))
    ad = addresses.join(V.facts(spark, d).select("actor").distinct().withColumn("key", short(F.col("actor"))), "key").select(*row("actor", F.col("actor")))
    opened = names(spark, d).select("name").distinct().withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.lower("name"), F.lit(1), i))))
    nm = core.top_k(keys.where(~is_hex & ~is_number).withColumn("key", F.lower("text")).join(opened, "key"), ["id"], [F.col("name")], 10).select(*row("name", F.col("name")))
    return bl.unionByName(tx).unionByName(ch).unionByName(ad).unionByName(nm)


@query("f6_null_safe_diff", "SELECT tx_hash, tip, new_tip FROM (SELECT tx_hash, tip, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN coalesce(tip, 7) ELSE tip END AS new_tip, nonce FROM pending) WHERE (tip, nonce) IS DISTINCT FROM (new_tip, nonce)")
def f6(spark, d):
    """Rows whose listed columns differ between two images, nulls being equal."""
    e = F.col("event_id") % 5
    rows = V.pending(spark, d).withColumn("new_tip", F.when(e == 1, F.coalesce("tip", F.lit(7))).when(e != 0, F.col("tip")))
    return rows.where(~F.struct("tip", "nonce").eqNullSafe(F.struct(F.col("new_tip").alias("tip"), "nonce"))).select("tx_hash", "tip", "new_tip")


_CLAIMED = "SELECT DISTINCT address FROM claims WHERE status = 'active' AND valid_from <= {n} AND (valid_to IS NULL OR valid_to >= {n})"


@query("u3_set_diff_both", f"WITH a AS ({_CLAIMED.format(n=1000)}), b AS ({_CLAIMED.format(n=2000)}) SELECT coalesce(a.address, b.address) AS address, CASE WHEN a.address IS NULL THEN 'added' ELSE 'removed' END AS action FROM a FULL OUTER JOIN b ON a.address = b.address WHERE a.address IS NULL OR b.address IS NULL")
def u3(spark, d):
    """What came and what went between two sets, by one full outer join."""
    at = lambda n: V.claims(spark, d).where(f"status = 'active' AND valid_from <= {n} AND (valid_to IS NULL OR valid_to >= {n})").select("address").distinct()
    return core.set_diff(at(1000), at(2000), ["address"])


@query("t11_pending_diff", f"WITH a AS (SELECT DISTINCT tx_hash FROM pending WHERE seen <= {V.AS_OF - 90000} AND seen + 3600 > {V.AS_OF - 90000}), b AS (SELECT DISTINCT tx_hash FROM pending WHERE seen <= {V.AS_OF - 88200} AND seen + 3600 > {V.AS_OF - 88200}) SELECT coalesce(a.tx_hash, b.tx_hash) AS tx_hash, CASE WHEN a.tx_hash IS NULL THEN 'added' ELSE 'removed' END AS action FROM a FULL OUTER JOIN b ON a.tx_hash = b.tx_hash WHERE a.tx_hash IS NULL OR b.tx_hash IS NULL")
def t11(spark, d):
    """Transactions that came and went between two looks at the pending table."""
    alive = lambda t: V.pending(spark, d).where(f"seen <= {t} AND seen + 3600 > {t}").select("tx_hash").distinct()
    return core.set_diff(alive(V.AS_OF - 90000), alive(V.AS_OF - 88200), ["tx_hash"])


@query("u4_union_old_new_keys", "SELECT t - t % 3600 AS bucket, actor FROM facts WHERE block_number % 20 < 12 UNION SELECT t - t % 3600, actor FROM facts WHERE block_number % 20 >= 8")
def u4(spark, d):
    """Rollup keys that either image of a change touches."""
    f = V.facts(spark, d).select(bucket(F.col("t"), 3600).alias("bucket"), "actor", "block_number")
    old, new = f.where("block_number % 20 < 12"), f.where("block_number % 20 >= 8")
    return old.union(new).select("bucket", "actor").distinct()


_NAMED = "n AS (SELECT f.block_number, f.actor, coalesce(nullif(trim(f.label), ''), r.name, '') AS name FROM facts f LEFT JOIN registry r ON lower(f.actor) = r.address)"


@query("a10_bool_or", f"WITH {_NAMED} SELECT block_number, bool_or(name <> '') AS any_named, bool_and(name <> '') AS all_named FROM n GROUP BY 1")
def a10(spark, d):
    n = core.enrich(V.facts(spark, d), V.registry(spark, d))
    return n.groupBy("block_number").agg(F.bool_or(F.col("name") != "").alias("any_named"), F.bool_and(F.col("name") != "").alias("all_named"))


@query("a13_single_member_value", f"WITH {_NAMED}, e AS (SELECT coalesce(nullif({SLUG.format('name')}, ''), lower(actor)) AS entity, actor FROM n) SELECT entity, count(DISTINCT actor) AS members, CASE WHEN count(DISTINCT actor) = 1 THEN min(actor) END AS only_member FROM e GROUP BY 1")
def a13(spark, d):
    """The member of an entity that has but one: its least and its greatest are the same."""
    n = core.enrich(V.facts(spark, d).select("actor", "label").distinct(), V.registry(spark, d)).select(core.entity_key(F.col("name"), F.col("actor")).alias("entity"), "actor").distinct()
    return n.groupBy("entity").agg(F.count(F.lit(1)).alias("members"), F.when(F.min("actor") == F.max("actor"), F.min("actor")).alias("only_member"))


@query("a14_sorted_string_agg", f"SELECT n AS block_number, string_agg(kind, ',' ORDER BY kind) AS kinds FROM ({KINDS}) GROUP BY 1")
def a14(spark, d):
    i = F.col("items")
    named = {"full": i >= V.MAX, "above_target": i > V.TARGET, "drought": i == 0, "below_target": i < V.TARGET}
    kinds = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())), lambda x: x.isNotNull())
    return V.blocks(spark, d).select("block_number", F.explode(kinds).alias("kind")).groupBy("block_number").agg(F.expr("listagg(kind, ',') WITHIN GROUP (ORDER BY kind)").alias("kinds"))


@query("x_trunc_align", "SELECT t, CAST(epoch(date_trunc('minute', make_timestamp(t * 1000000))) AS BIGINT) AS minute, CAST(epoch(date_trunc('hour', make_timestamp(t * 1000000))) AS BIGINT) AS hour, CAST(epoch(date_trunc('day', make_timestamp(t * 1000000))) AS BIGINT) AS day, t - t % 300 + 300 AS end_300, t - t % 21600 + 21600 AS end_21600 FROM (SELECT DISTINCT t + 17 AS t FROM blocks)")
def x_trunc(spark, d):
    """Times cut to minute, hour and day; range ends moved up to the next bucket."""
    t = F.col("t")
    rows = V.blocks(spark, d).select((t + 17).alias("t"))
    cut = {n: F.unix_seconds(F.date_trunc(n, F.timestamp_seconds(t))).alias(n) for n in ("minute", "hour", "day")}
    return rows.select("t", *cut.values(), *((bucket(t, s) + s).alias(f"end_{s}") for s in (300, 21600)))


@query("x_hex", "SELECT c_custkey, hex(c_name) AS coded, c_name AS decoded, left(a, 6) || '…' || right(a, 4) AS short FROM (SELECT *, '0x' || left(sha256(c_name), 40) AS a FROM customer)")
def x_hex(spark, d):
    a = F.concat(F.lit("0x"), F.left(F.sha2(F.col("c_name").cast("binary"), 256), F.lit(40)))
    coded = V.read(spark, d, "customer").select("c_custkey", F.hex("c_name").alias("coded"), a.alias("a"))
    return coded.select("c_custkey", "coded", F.decode(F.unhex("coded"), "UTF-8").alias("decoded"), X.short_address(F.col("a")).alias("short"))


@query("x_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_object('event_id', event_id, 'type', event_type, 'k', CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS note FROM events")
def x_json(spark, d):
    """Texts read by an explicit schema, and rows written as texts."""
    rows = V.read(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.select("event_id", "k", F.to_json(F.struct("event_id", F.col("event_type").alias("type"), "k")).alias("note"))


@query("x_duration", "WITH x AS (SELECT DISTINCT (event_id % 45) || CASE event_id % 7 WHEN 0 THEN 'm' WHEN 1 THEN 'h' WHEN 2 THEN 'D ' WHEN 3 THEN 's' WHEN 4 THEN '' WHEN 5 THEN 'dd' ELSE ' h' END AS text FROM events), y AS (SELECT text, lower(trim(text)) AS t FROM x), z AS (SELECT text, CASE WHEN t ~ '^[0-9]{1,9}[mhd]$' THEN CAST(left(t, length(t) - 1) AS BIGINT) * CASE right(t, 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END END AS s FROM y) SELECT text, CASE WHEN s BETWEEN 60 AND 2592000 THEN s END AS seconds FROM z")
def x_duration(spark, d):
    e = F.col("event_id")
    unit = F.when(e % 7 == 0, "m").when(e % 7 == 1, "h").when(e % 7 == 2, "D ").when(e % 7 == 3, "s").when(e % 7 == 4, "").when(e % 7 == 5, "dd").otherwise(" h")
    rows = V.read(spark, d, "events").select(F.concat((e % 45).cast("string"), unit).alias("text")).distinct()
    return rows.select("text", X.duration(F.col("text")).alias("seconds"))


ARTIFACT = "schema_version int, submission_chain string, addresses map<string, array<struct<entity_id: string, name: string, status: string>>>"


def read_claims(texts: DataFrame, column: str, version: int, chain: str) -> DataFrame:
    """Claims of label files: one row per address and claim. Files of another version or chain give none, nor do
    claims without name or id; addresses are lower-cased."""
    a = texts.select(F.from_json(column, ARTIFACT).alias("a")).where((F.col("a.schema_version") == version) & (F.col("a.submission_chain") == chain))
    rows = a.select(F.explode("a.addresses").alias("address", "claims")).select(F.lower("address").alias("address"), F.explode("claims").alias("c"))
    return rows.select("address", "c.*").where("coalesce(trim(name), '') <> '' AND coalesce(trim(entity_id), '') <> ''")


@query("src4_read_claims", "SELECT lower('0xS' || c_custkey) AS address, 'e' || (c_custkey % 50) AS entity_id, 'Name ' || (c_custkey % 50) AS name, CASE WHEN c_custkey % 5 = 0 THEN 'disputed' ELSE 'active' END AS status FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_nationkey % 6 <> 1 AND c_nationkey % 9 <> 2")
def src4(spark, d):
    """The customers of each nation, written as one label file, read back."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    claim = F.struct(F.when(k % 11 != 0, F.concat(F.lit("e"), k % 50)).alias("entity_id"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("Name "), k % 50)).alias("name"), F.when(k % 5 == 0, "disputed").otherwise("active").alias("status"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("0xS"), k), F.array(claim))))
    files = V.read(spark, d, "customer").groupBy("c_nationkey", F.floor(k / 1000)).agg(entries.alias("addresses"))
    text = F.to_json(F.struct(F.when(n % 6 == 1, 2).otherwise(1).alias("schema_version"), F.when(n % 9 == 2, "eip155:5").otherwise("eip155:1").alias("submission_chain"), "addresses"))
    return read_claims(files.select(text.alias("text")), "text", 1, "eip155:1")
