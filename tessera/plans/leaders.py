"""Leaderboards of actors, entities and categories, and whole-history figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import present, share, wei_text
from tessera.operators import core
from tessera.plans import tiers
from tessera.sources import views as V

SINCE = V.AS_OF - 7 * 86400
LIMIT = 25
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = V.sql(sql)
        return f

    return add


def _actors(spark, d, since: int | None, store: str | None = None) -> DataFrame:
    """Per actor: items, cost, last time and label: the greatest one of a window, the newest one of all history. From
    stored rollups where a ``store`` is given (a window then begins with a minute), else from rows."""
    if store:
        rows = tiers.stored(spark, store, "items", tiers.widest(since), since, None)
        items, last, place = F.sum("items"), F.max("last_t"), F.col("newest")
    else:
        rows = V.facts(spark, d, since).withColumn("label", present(F.col("label")))
        items, last, place = F.count(F.lit(1)), F.max("t"), F.struct("block_number", "item_index")
    label = F.max_by("label", F.when(F.col("label").isNotNull(), place)) if since is None else F.max("label")
    return rows.groupBy("actor").agg(items.alias("items"), F.sum("cost").cast(V.WEI).alias("cost"), label.alias("label"), last.alias("last_t"))


def _pending(spark, d) -> DataFrame:
    """One row: items and cost that are pending; whole-history shares count them in."""
    return V.pending(spark, d).agg(F.coalesce(F.sum("items"), F.lit(0)).alias("more_items"), F.coalesce(F.sum("cost"), F.lit(0)).cast(V.WEI).alias("more_cost")).withColumn("_one", F.lit(1))


_ACTORS = """WITH a AS (SELECT actor, count(*) AS items, sum(cost) AS cost, max(t) AS last_t, {label} AS label FROM facts {where} GROUP BY actor),
n AS (SELECT a.*, coalesce(nullif(trim(a.label), ''), nullif(trim(r.name), ''), '') AS name, coalesce(r.category, 'unknown') AS category FROM a LEFT JOIN registry r ON lower(a.actor) = r.address),
more AS (SELECT {more_items} AS items, {more_cost} AS cost)"""
_WINDOW = _ACTORS.format(where=f"WHERE t >= {SINCE}", label="nullif(max(trim(label)), '')", more_items="0", more_cost="0")
_NEWEST = "arg_max(nullif(trim(label), ''), block_number * 1000000 + item_index) FILTER (nullif(trim(label), '') IS NOT NULL)"
_ALL = _ACTORS.format(where="", label=_NEWEST, more_items="(SELECT coalesce(sum(items), 0) FROM pending)", more_cost="(SELECT coalesce(sum(cost), 0) FROM pending)")


def _share_sql(part: str, whole: str) -> str:
    return f"round(CAST({part} AS DOUBLE) * 100 / CAST({whole} + (SELECT {part} FROM more) AS DOUBLE), 6) AS {'item' if part == 'items' else 'cost'}_share"


_SHARES = _share_sql("items", "sum(items) OVER ()") + ", " + _share_sql("cost", "sum(cost) OVER ()")
_OWN_SHARES = _SHARES.replace(" + (SELECT items FROM more)", "").replace(" + (SELECT cost FROM more)", "")


def _shares(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Shares of items and cost in the sum of ``rows`` and of ``more``."""
    both = core.with_totals(rows, all_items=F.sum("items"), all_cost=F.sum("cost"))
    if more is not None:
        both = both.withColumn("_one", F.lit(1)).join(F.broadcast(more), "_one").withColumns({"all_items": F.col("all_items") + F.col("more_items"), "all_cost": F.col("all_cost") + F.col("more_cost")})
    return both.withColumn("item_share", share(F.col("items"), F.col("all_items"))).withColumn("cost_share", share(F.col("cost"), F.col("all_cost")))


def top_actors(actors: DataFrame, registry: DataFrame, by: str = "items", limit: int = LIMIT, more: DataFrame | None = None) -> DataFrame:
    order = [F.desc(by), F.desc("cost" if by == "items" else "items"), F.col("actor")]
    rows = _shares(core.enrich(actors, registry), more).orderBy(*order).limit(limit)
    return rows.select("actor", "name", "category", "items", wei_text(F.col("cost")).alias("cost"), "last_t", "item_share", "cost_share")


def _top_sql(with_: str, order: str, where: str = "") -> str:
    return f"{with_} SELECT actor, name, category, items, CAST(CAST(cost AS DECIMAL(38,0)) AS VARCHAR) AS cost, last_t, {_OWN_SHARES if where else _SHARES} FROM n {where} ORDER BY {order} LIMIT {LIMIT}"


@query("q12_top_actors_windowed", _top_sql(_WINDOW, "items DESC, n.cost DESC, actor"))
def q12(spark, d, store: str | None = None):
    return top_actors(_actors(spark, d, SINCE, store), V.registry(spark, d))


@query("q12_top_actors_windowed_by_spend", _top_sql(_WINDOW, "n.cost DESC, items DESC, actor"))
def q12_spend(spark, d, store: str | None = None):
    return top_actors(_actors(spark, d, SINCE, store), V.registry(spark, d), by="cost")


@query("q13_top_actors_all", _top_sql(_ALL, "items DESC, n.cost DESC, actor"))
def q13(spark, d, store: str | None = None):
    return top_actors(_actors(spark, d, None, store), V.registry(spark, d), more=_pending(spark, d))


@query("q14_top_unlabelled_windowed", _top_sql(_WINDOW, "items DESC, n.cost DESC, actor", "WHERE name = ''"))
def q14(spark, d, store: str | None = None):
    return _unlabelled(spark, d, SINCE, store)


@query("q15_top_unlabelled_all", _top_sql(_ALL, "items DESC, n.cost DESC, actor", "WHERE name = ''"))
def q15(spark, d, store: str | None = None):
    return _unlabelled(spark, d, None, store)


def _unlabelled(spark, d, since, store=None):
    rows = _shares(core.enrich(_actors(spark, d, since, store), V.registry(spark, d)).where("name = ''"))
    return rows.orderBy(F.desc("items"), F.desc("cost"), "actor").limit(LIMIT).select("actor", "name", "category", "items", wei_text(F.col("cost")).alias("cost"), "last_t", "item_share", "cost_share")


def keyed(actors: DataFrame, registry: DataFrame) -> DataFrame:
    """Actors with their entity."""
    return core.enrich(actors, registry).withColumn("entity", core.entity_key(F.col("name"), F.col("actor")))


def entities(actors: DataFrame, registry: DataFrame) -> DataFrame:
    """Actors collapsed by entity before any ranking: sums, and name and address of the busiest member."""
    busiest = F.min_by(F.struct("name", "actor"), F.struct(-F.col("items"), -F.col("cost"), "actor"))
    category = F.coalesce(F.min(F.nullif(F.col("category"), F.lit("unknown"))), F.lit("unknown"))
    out = keyed(actors, registry).groupBy("entity").agg(F.sum("items").alias("items"), F.sum("cost").cast(V.WEI).alias("cost"), busiest.alias("b"), category.alias("category"), F.count(F.lit(1)).alias("members"))
    return out.select("entity", F.col("b.name").alias("name"), "category", "items", "cost", "members", F.col("b.actor").alias("busiest"))


_KEYED = ", g AS (SELECT coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), ''), lower(actor)) AS entity, * FROM n)"
_ENTITY = _KEYED + """,
e AS (SELECT entity, sum(items) AS items, sum(cost) AS cost, first(name ORDER BY items DESC, g.cost DESC, actor) AS name, coalesce(min(nullif(category, 'unknown')), 'unknown') AS category, count(*) AS members, first(actor ORDER BY items DESC, g.cost DESC, actor) AS busiest FROM g GROUP BY entity)"""
_TOP_ENTITY = _ENTITY + " SELECT entity, name, category, CAST(items AS BIGINT) AS items, CAST(CAST(cost AS DECIMAL(38,0)) AS VARCHAR) AS cost, members, busiest, " + _SHARES + " FROM e ORDER BY e.items DESC, e.cost DESC, entity LIMIT " + str(LIMIT)


def _top_entities(spark, d, since, more=None, store=None):
    rows = _shares(entities(_actors(spark, d, since, store), V.registry(spark, d)), more).orderBy(F.desc("items"), F.desc("cost"), "entity").limit(LIMIT)
    return rows.select("entity", "name", "category", "items", wei_text(F.col("cost")).alias("cost"), "members", "busiest", "item_share", "cost_share")


@query("a7_entity_members_busiest_first", _WINDOW + _ENTITY + f", top AS (SELECT entity FROM e ORDER BY e.items DESC, e.cost DESC, entity LIMIT {LIMIT}) SELECT entity, actor, items, row_number() OVER (PARTITION BY entity ORDER BY items DESC, g.cost DESC, actor) AS place FROM g WHERE entity IN (SELECT entity FROM top)")
def a7(spark, d, store: str | None = None):
    """The members of the largest entities in order, as rows: no entity is one list."""
    actors, registry = _actors(spark, d, SINCE, store), V.registry(spark, d)
    top = entities(actors, registry).orderBy(F.desc("items"), F.desc("cost"), "entity").limit(LIMIT).select("entity")
    rows = keyed(actors, registry).join(F.broadcast(top), "entity", "left_semi")
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("items"), F.desc("cost"), "actor"))
    return rows.select("entity", "actor", "items", place.alias("place"))


@query("q16_top_entities_windowed", _WINDOW + _TOP_ENTITY)
def q16(spark, d, store: str | None = None):
    return _top_entities(spark, d, SINCE, store=store)


@query("q17_top_entities_all", _ALL + _TOP_ENTITY)
def q17(spark, d, store: str | None = None):
    return _top_entities(spark, d, None, _pending(spark, d), store)


_CATEGORY = ", k AS (SELECT category, sum(items) AS items, sum(cost) AS cost FROM n GROUP BY category) SELECT category, CAST(items AS BIGINT) AS items, CAST(CAST(cost AS DECIMAL(38,0)) AS VARCHAR) AS cost, " + _SHARES + " FROM k"


def _categories(spark, d, since, more=None, store=None):
    rows = core.enrich(_actors(spark, d, since, store), V.registry(spark, d)).groupBy("category").agg(F.sum("items").alias("items"), F.sum("cost").cast(V.WEI).alias("cost"))
    return _shares(rows, more).select("category", "items", wei_text(F.col("cost")).alias("cost"), "item_share", "cost_share")


@query("q18_category_breakdown_windowed", _WINDOW + _CATEGORY)
def q18(spark, d, store: str | None = None):
    return _categories(spark, d, SINCE, store=store)


@query("q19_category_breakdown_all", _ALL + _CATEGORY)
def q19(spark, d, store: str | None = None):
    return _categories(spark, d, None, _pending(spark, d), store)


@query("q20_actor_detail", _ALL + f" SELECT actor, name, category, items, CAST(CAST(cost AS DECIMAL(38,0)) AS VARCHAR) AS cost, last_t, item_share, cost_share FROM (SELECT *, {_SHARES} FROM n) WHERE lower(actor) = '0xs7'")
def q20(spark, d, store: str | None = None):
    rows = _shares(core.enrich(_actors(spark, d, None, store), V.registry(spark, d)), _pending(spark, d)).where(F.lower("actor") == "0xs7")
    return rows.select("actor", "name", "category", "items", wei_text(F.col("cost")).alias("cost"), "last_t", "item_share", "cost_share")


@query("q21_entity_members", "WITH m AS (SELECT coalesce(r.address, lower(a.actor)) AS address, coalesce(r.name, '') AS name, r.address IS NOT NULL AS in_registry, a.actor IS NOT NULL AS active FROM registry r FULL OUTER JOIN (SELECT DISTINCT actor FROM facts) a ON r.address = lower(a.actor)) SELECT coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), ''), address) AS entity, address, in_registry, active FROM m")
def q21(spark, d):
    r, a = V.registry(spark, d), V.facts(spark, d).select(F.lower("actor").alias("a")).distinct()
    m = r.join(a, r.address == a.a, "full_outer").select(F.coalesce("address", "a").alias("address"), F.coalesce("name", F.lit("")).alias("name"), F.col("address").isNotNull().alias("in_registry"), F.col("a").isNotNull().alias("active"))
    return m.select(core.entity_key(F.col("name"), F.col("address")).alias("entity"), "address", "in_registry", "active")


@query("q24_network_stats", """SELECT count(*) AS items, CAST(CAST(sum(cost) AS DECIMAL(38,0)) AS VARCHAR) AS cost, count(DISTINCT actor) AS actors, count(DISTINCT block_number) AS blocks, (SELECT CAST(coalesce(sum(items), 0) AS BIGINT) FROM pending) AS pending_items,
    (SELECT CAST(CAST(coalesce(sum(cost), 0) AS DECIMAL(38,0)) AS VARCHAR) FROM pending) AS pending_cost, count(*) + (SELECT CAST(coalesce(sum(items), 0) AS BIGINT) FROM pending) AS all_items, max(block_number) AS last_block, max(t) AS last_t,
    round(avg(fee), 6) AS avg_fee, round(CAST(count(*) AS DOUBLE) / count(DISTINCT block_number), 6) AS avg_items, CAST((CAST(sum(cost) AS HUGEINT) + (SELECT CAST(coalesce(sum(cost), 0) AS HUGEINT) FROM pending)) // (count(*) + (SELECT CAST(coalesce(sum(items), 0) AS BIGINT) FROM pending)) AS VARCHAR) AS avg_cost FROM facts""")
def q24(spark, d):
    f = V.facts(spark, d).agg(F.count(F.lit(1)).alias("items"), F.sum("cost").cast(V.WEI).alias("c"), F.countDistinct("actor").alias("actors"), F.countDistinct("block_number").alias("blocks"), F.max("block_number").alias("last_block"), F.max("t").alias("last_t"), F.round(F.avg("fee"), 6).alias("avg_fee")).withColumn("_one", F.lit(1))
    rows = f.join(_pending(spark, d), "_one")
    more = {"all_items": F.col("items") + F.col("more_items"), "avg_items": F.round(F.try_divide(F.col("items").cast("double"), F.col("blocks")), 6), "avg_cost": F.expr("CAST((c + more_cost) div nullif(items + more_items, 0) AS string)"), "cost": wei_text(F.col("c")), "pending_items": F.col("more_items"), "pending_cost": wei_text(F.col("more_cost"))}
    return rows.withColumns(more).drop("_one", "c", "more_items", "more_cost")


@query("q55_records_top_spenders", _ALL + " SELECT actor, name, category, items, CAST(CAST(cost AS DECIMAL(38,0)) AS VARCHAR) AS cost FROM n ORDER BY n.cost DESC, items DESC, actor LIMIT 10")
def q55(spark, d, store: str | None = None):
    return core.enrich(_actors(spark, d, None, store), V.registry(spark, d)).orderBy(F.desc("cost"), F.desc("items"), "actor").limit(10).select("actor", "name", "category", "items", wei_text(F.col("cost")).alias("cost"))


@query("q61_top_actor_labels_raw", "SELECT actor, trim(label) AS label, count(*) AS items, CAST(CAST(sum(cost) AS DECIMAL(38,0)) AS VARCHAR) AS cost, max(t) AS last_t FROM facts WHERE trim(label) <> '' GROUP BY 1, 2 ORDER BY items DESC, actor, label LIMIT 50")
def q61(spark, d):
    rows = V.facts(spark, d).withColumn("label", F.btrim("label")).where("label <> ''").groupBy("actor", "label").agg(F.count(F.lit(1)).alias("items"), wei_text(F.sum("cost")).alias("cost"), F.max("t").alias("last_t"))
    return rows.orderBy(F.desc("items"), "actor", "label").limit(50)


@query("q64_registry_list", "SELECT address, name, category FROM registry")
def q64(spark, d):
    return V.registry(spark, d).select("address", "name", "category")
