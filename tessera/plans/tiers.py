"""Rollups by tier: stored ones, by grain and day, or made from rows where no store is given.

A store is a folder with ``blocks`` and ``items`` by grain; a day of a grain is a partition. ``build`` fills it,
and ``renew`` puts the days that a change touched in place, so it follows what maintenance does. A query that is given a
store reads the files of its own tier and range, and no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import bucket, present
from tessera.operators import core
from tessera.sources import views as V

DAY = 86400
#: Seconds of a bucket, and how far back from the present a tier reaches.
TIERS = {"raw": (1, 30 * DAY), "fine": (60, 2 * DAY), "minutes": (60, 30 * DAY), "hourly": (3600, 30 * DAY), "days": (DAY, 30 * DAY)}
STORED = ("minutes", "hourly", "days")
FOLDER = {"fine": "minutes"}


def of_blocks(blocks: DataFrame, seconds: int, percentiles: bool = True) -> DataFrame:
    """bucket, blocks, items, above_target, at_max, sums of base and item fees, and the exact median and p95 of the fee."""
    b = blocks.withColumn("bucket", bucket(F.col("t"), seconds))
    sums = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("blocks"), F.sum("items").alias("items"), F.count_if(F.col("items") > V.TARGET).alias("above_target"), F.count_if(F.col("items") >= V.MAX).alias("at_max"), F.sum("base_fee").alias("fee_sum"), F.count_if(F.col("base_fee") > 0).alias("fee_blocks"), F.sum("fee").alias("item_fee_sum"))
    return sums.join(core.disc_percentiles(b, ["bucket"], "fee", median="0.5", p95="0.95"), "bucket") if percentiles else sums


def of_items(items: DataFrame, seconds: int) -> DataFrame:
    """bucket, actor, label (null where there is none), items, cost, last time, and ``newest``: number and place of the last
    item. Labels are part of the key, so what a label names, and which label is the newest, can be told of any buckets."""
    keyed = items.withColumn("bucket", bucket(F.col("t"), seconds)).withColumn("label", present(F.col("label")))
    return keyed.groupBy("bucket", "actor", "label").agg(F.count(F.lit(1)).alias("items"), F.sum("cost").cast(V.WEI).alias("cost"), F.max("t").alias("last_t"), F.max(F.struct("block_number", "item_index")).alias("newest"))


def save(rows: DataFrame, store: str, name: str, tier: str) -> None:
    """Puts the days that ``rows`` has buckets of in place; other days keep their files."""
    dated = rows.withColumn("day", F.floor(F.col("bucket") / DAY))
    dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{store}/{name}/{tier}")


def renew(blocks: DataFrame, facts: DataFrame, store: str) -> None:
    """Stored rollups of whole days, from all rows of these days."""
    for tier in STORED:
        save(of_blocks(blocks, TIERS[tier][0]), store, "blocks", tier)
        save(of_items(facts, TIERS[tier][0]), store, "items", tier)


def build(spark, d, store: str) -> None:
    renew(V.blocks(spark, d), V.facts(spark, d), store)


def stored(spark, store: str, name: str, tier: str, first: int | None, last: int | None = V.AS_OF) -> DataFrame:
    """Stored rows of buckets in [first, last); only the files of their days are read."""
    rows = spark.read.parquet(f"{store}/{name}/{FOLDER.get(tier, tier)}")
    if first is not None:
        rows = rows.where(f"day >= {first // DAY} AND bucket >= {first}")
    if last is not None:
        rows = rows.where(f"day <= {last // DAY} AND bucket < {last}")
    return rows.drop("day")


def widest(first: int | None) -> str:
    """The tier with the fewest rows of which a bucket begins at ``first``."""
    return next((t for t in ("days", "hourly", "minutes") if first is None or first % TIERS[t][0] == 0), "minutes")


def block_tier(spark, d, tier: str, store: str | None = None, percentiles: bool = False) -> DataFrame:
    seconds, back = TIERS[tier]
    first = V.AS_OF - back
    if store and tier != "raw":
        return stored(spark, store, "blocks", tier, first)
    return of_blocks(V.blocks(spark, d, first, V.AS_OF), seconds, percentiles)


def item_tier(spark, d, tier: str, store: str | None = None) -> DataFrame:
    seconds, back = TIERS[tier]
    first = V.AS_OF - back
    return stored(spark, store, "items", tier, first) if store else core.rollup(V.facts(spark, d, first, V.AS_OF), seconds)


def counts(rows: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Blocks and items of the windows (name -> seconds back) that buckets lie in."""
    inside = F.filter(F.array(*(F.when((F.col("bucket") >= V.AS_OF - n) & (F.col("bucket") < V.AS_OF), F.lit(w)) for w, n in windows.items())), lambda x: x.isNotNull())
    return rows.withColumn("w", F.explode(inside)).groupBy("w").agg(F.sum("blocks").alias("blocks"), F.sum("items").alias("items"))
