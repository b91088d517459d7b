"""Operators that the queries are made of. Each takes DataFrames and returns one."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import present, slug

def enrich(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds name (row label, else registry name, else '') and category (else 'unknown') to rows with
    actor and label. The join is on the lower-cased address; Spark broadcasts the registry by size."""
    r = registry.select(F.col("address").alias("_a"), F.col("name").alias("_n"), F.col("category").alias("_c"))
    joined = items.join(r, F.lower("actor") == F.col("_a"), "left")
    return joined.withColumn("name", F.coalesce(present(F.col("label")), present(F.col("_n")), F.lit(""))).withColumn("category", F.coalesce("_c", F.lit("unknown"))).drop("_a", "_n", "_c")


def entity_key(name: Column, actor: Column) -> Column:
    """Slug of the name; names without one are keyed by address."""
    return F.coalesce(F.nullif(slug(name), F.lit("")), F.lower(actor))


def with_totals(rows: DataFrame, **totals: Column) -> DataFrame:
    """Each row with whole-table totals, from a one-row aggregate instead of a one-partition window."""
    one = rows.agg(*(c.alias(n) for n, c in totals.items())).withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key; Spark prunes before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def _counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))


def disc_percentiles(rows: DataFrame, keys: list[str], value: str, **ps: str) -> DataFrame:
    """Exact observed percentiles per key: the value at ceil(p * n). Values are counted first, so what
    is shuffled and ranked is distinct values, and no list is gathered. ``ps``: name -> p as text."""
    counts = _counted(rows, keys, value)
    by = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_c").over(by.orderBy(value))).withColumn("_n", F.sum("_c").over(by))
    at = {n: F.greatest(F.ceil(F.expr(f"{p}BD * _n")).cast("long"), F.lit(1)) for n, p in ps.items()}
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") >= c, F.col(value))).alias(n) for n, c in at.items()))


def cont_percentiles(rows: DataFrame, keys: list[str], value: str, **ps: str) -> DataFrame:
    """Interpolated percentiles (double) per key, from the two observed values around p * (n - 1)."""
    counts = _counted(rows, keys, value)
    by = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_c").over(by.orderBy(value))).withColumn("_n", F.sum("_c").over(by))
    place = {n: F.expr(f"{p}BD * (_n - 1)") for n, p in ps.items()}
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col(value))).cast("double")
    ends = {n: (at(F.floor(x) + 1).alias(f"_lo{n}"), at(F.ceil(x) + 1).alias(f"_hi{n}"), F.max(x - F.floor(x)).cast("double").alias(f"_p{n}")) for n, x in place.items()}
    both = ranked.groupBy(*keys).agg(*(c for e in ends.values() for c in e))
    return both.select(*keys, *((F.col(f"_lo{n}") + (F.col(f"_hi{n}") - F.col(f"_lo{n}")) * F.col(f"_p{n}")).alias(n) for n in ps))


def _at_ranks(counts: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Per key the values at ranks (of ``_n``, from 1), where keys are few: a histogram over leading digits
    tells in which slice a rank lies, and only these slices are ranked, each by itself."""
    coarse = F.when(F.col(value) > 0, F.floor(F.log2(F.col(value).cast("double")) * 64)).otherwise(F.lit(-1)).cast("long")
    counts = counts.where(F.col(value) >= 0).withColumn("_s", coarse)
    hist = counts.groupBy(*keys, "_s").agg(F.sum("_c").alias("_sc"))
    by = Window.partitionBy(*keys)  # slices: some thousands a key at most
    hist = hist.withColumn("_upto", F.sum("_sc").over(by.orderBy("_s"))).withColumn("_n", F.sum("_sc").over(by))
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), r.alias("rank")) for n, r in ranks.items())))
    picks = hist.withColumn("_p", asked).where("_upto >= _p.rank AND _upto - _sc < _p.rank").select(*keys, "_s", F.col("_p.name").alias("_name"), (F.col("_p.rank") - (F.col("_upto") - F.col("_sc"))).alias("_rank"), "_n")
    inside = counts.join(F.broadcast(picks), [*keys, "_s"])
    ranked = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy(value)))
    return ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *(F.min(F.when((F.col("_name") == n) & (F.col("_upto") >= F.col("_rank")), F.col(value))).alias(n) for n in ranks))


def few_disc_percentiles(rows: DataFrame, keys: list[str], value: str, counted: bool = False, **ps: str) -> DataFrame:
    """As ``disc_percentiles`` for few keys with very many distinct values of 0 or more. ``counted``: rows are
    distinct values already, with their count in ``_c``."""
    ranks = {n: F.greatest(F.ceil(F.expr(f"{p}BD * _n")).cast("long"), F.lit(1)) for n, p in ps.items()}
    return _at_ranks(rows if counted else _counted(rows, keys, value), keys, value, ranks).drop("_n")


def few_cont_percentiles(rows: DataFrame, keys: list[str], value: str, counted: bool = False, **ps: str) -> DataFrame:
    """Interpolated percentiles (double) for few keys, from the two observed values around p * (n - 1)."""
    place = {n: F.expr(f"{p}BD * (_n - 1)") for n, p in ps.items()}
    ranks = {f"_lo{n}": F.floor(x).cast("long") + 1 for n, x in place.items()} | {f"_hi{n}": F.ceil(x).cast("long") + 1 for n, x in place.items()}
    both = _at_ranks(rows if counted else _counted(rows, keys, value), keys, value, ranks)
    between = lambda n: F.col(f"_lo{n}").cast("double") + (F.col(f"_hi{n}").cast("double") - F.col(f"_lo{n}").cast("double")) * (place[n] - F.floor(place[n])).cast("double")
    return both.select(*keys, *(between(n).alias(n) for n in ps))


def spine(first: int, last: int, step: int, spark) -> DataFrame:
    """Bucket starts from ``first`` up to, not including, ``last``."""
    return spark.range(first, last, step).select(F.col("id").alias("bucket"))


def islands(rows: DataFrame, keys: list[str], n: str, span: int = 100_000) -> DataFrame:
    """Runs of consecutive ``n`` per key: first, last and length. Runs are found inside ranges of
    ``span`` numbers; only those that touch the border of a range (two a range and key) are stitched."""
    inner = Window.partitionBy(*keys, "_p").orderBy(n)
    runs = rows.withColumn("_p", F.floor(F.col(n) / span)).withColumn("_g", F.col(n) - F.row_number().over(inner)).groupBy(*keys, "_p", "_g").agg(F.min(n).alias("first"), F.max(n).alias("last"))
    touches = (F.pmod("first", F.lit(span)) == 0) | (F.pmod("last", F.lit(span)) == span - 1)
    inside, border = runs.where(~touches), runs.where(touches)
    order = Window.partitionBy(*keys).orderBy("first")
    new = (F.col("first") != F.coalesce(F.lag("last").over(order), F.lit(-2)) + 1).cast("int")
    stitched = border.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    both = inside.select(*keys, "first", "last").unionByName(stitched.select(*keys, "first", "last"))
    return both.withColumn("length", F.col("last") - F.col("first") + 1)


def rollup(items: DataFrame, seconds: int) -> DataFrame:
    """Additive sums per bucket and actor."""
    return items.groupBy((F.col("t") - F.pmod("t", F.lit(seconds))).alias("bucket"), "actor").agg(F.count(F.lit(1)).alias("items"), F.sum("cost").cast("decimal(38,0)").alias("cost"))


def merge(stored: DataFrame, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Stored sums with signed deltas added; keys whose sums are all 0 go."""
    s, d = stored.select(*keys, *(F.col(c).alias(f"_s{c}") for c in sums)), delta.select(*keys, *(F.col(c).alias(f"_d{c}") for c in sums))
    both = s.join(d, keys, "full_outer").select(*keys, *((F.coalesce(f"_s{c}", F.lit(0)) + F.coalesce(f"_d{c}", F.lit(0))).alias(c) for c in sums))
    return both.where(" OR ".join(f"{c} <> 0" for c in sums))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of stored rows of the same keys."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def shared_dir(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where none is named and all tasks run in this process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` without their lineage: a table in the shared folder, under a name of its own. Later steps read the
    columns they need of it, with the schema given, so no job looks for it."""
    path = f"{shared_dir(rows.sparkSession)}/tessera-cut-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def set_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one of two sets only, with ``action``: added or removed."""
    both = old.withColumn("_o", F.lit(True)).join(new.withColumn("_n", F.lit(True)), keys, "full_outer").where("_o IS NULL OR _n IS NULL")
    return both.select(*keys, F.when(F.col("_o").isNull(), "added").otherwise("removed").alias("action"))


def asof_intervals(bounds: DataFrame, at: str) -> DataFrame:
    """Boundaries as half-open intervals [at, until)."""
    return bounds.withColumn("until", F.coalesce(F.lead(at).over(Window.partitionBy(F.lit(1)).orderBy(at)), F.lit(1 << 62)))
