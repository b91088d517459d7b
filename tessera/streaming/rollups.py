"""Streaming rollups: event-time buckets with a watermark, and sinks that may see a batch twice.

Sinks keep tables as Parquet partitioned by a bucket. A batch rewrites only the partitions that it touches:
their new content is computed into a staging folder of the batch's number, and put in place by a dynamic
partition overwrite. A batch that is repeated after a failure computes the same content again, so nothing
is counted twice, and no more than the touched partitions is read or written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators import core

FINE = 60
COARSE = (3600, 21600, 86400)


def read_items(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A file stream of items with an explicit schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(items: DataFrame, time: str, key: str, seconds: int, late: str = "48 hours") -> DataFrame:
    """Counts per bucket and key; rows older than the watermark are ignored and state is dropped."""
    w = F.window(time, f"{seconds} seconds")
    return items.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("items")).select(F.col("window.start").alias("bucket"), key, "items")


def deltas(items: DataFrame, time: str, keys: list[str], sums: dict[str, Column], grains: tuple[int, ...] = COARSE) -> DataFrame:
    """What rows add to the buckets of all ``grains``: seconds, bucket, the keys and the sums. A bucket starts at
    a multiple of its grain since the epoch."""
    start = lambda g: F.timestamp_seconds(F.unix_seconds(F.col(time)) - F.pmod(F.unix_seconds(F.col(time)), F.lit(g)))
    rows = items.withColumn("g", F.explode(F.array(*(F.struct(F.lit(g).alias("seconds"), start(g).alias("bucket")) for g in grains))))
    return rows.groupBy(F.col("g.seconds").alias("seconds"), F.col("g.bucket").alias("bucket"), *keys).agg(*(c.alias(n) for n, c in sums.items()))


def live_rollups(items: DataFrame, time: str, key: str, path: str, late: str = "48 hours") -> dict[str, DataStreamWriter]:
    """The two queries that keep the rollups of a stream of items, not started. ``fine``: minutes, whose state ends
    ``late`` behind the newest row, and which leave older rows out. ``coarse``: hours and more, merged with what is
    stored at any age; nothing is kept in memory between batches."""
    day = F.floor(F.unix_seconds("bucket") / 86400)
    fine = tumbling(items, time, key, FINE, late).withColumn("seconds", F.lit(FINE))
    coarse = merge_sink(f"{path}/coarse", ["seconds", "bucket", key], ["items"], day)

    def merged(batch: DataFrame, batch_id: int) -> None:
        coarse(deltas(batch, time, [key], {"items": F.count(F.lit(1))}), batch_id)

    return {
        "fine": fine.writeStream.outputMode("update").foreachBatch(upsert_sink(f"{path}/fine", ["seconds", "bucket", key], day, newest="items")),
        "coarse": items.writeStream.foreachBatch(merged),
    }


def first_seen(items: DataFrame, time: str, keys: list[str], late: str = "48 hours") -> DataFrame:
    """Each key once, as long as the watermark remembers it: rows that a trailing scan reads again add nothing."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def touched(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``table`` in the partitions that ``rows`` has rows of; no others are read. The list is one of
    folders, of which the driver holds the table's whole listing anyway."""
    return table.where(F.col("part").isin([r.part for r in rows.select("part").distinct().collect()]))


def replace_partitions(new: DataFrame, path: str, part: str, batch_id: int) -> None:
    """Puts ``new`` in place of the partitions that it holds rows of. Large partitions are written by several tasks."""
    spark = new.sparkSession
    staging = f"{path}-staging/batch={batch_id}"
    new.write.mode("overwrite").parquet(staging)
    spark.read.schema(new.schema).parquet(staging).hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def upsert_sink(path: str, keys: list[str], part: Column, newest: str | None = None):
    """A foreachBatch function that puts rows in place of stored ones of the same keys. ``part`` gives the
    partition of a row, from its keys; of rows of one key in a batch the greatest by ``newest`` counts,
    else the greatest as a whole, so that the choice is the same when the batch is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        columns = batch.columns
        order = F.struct(*(c for c in ([newest] if newest else []) + columns))
        one = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")
        rows = one.withColumn("part", part.cast("long"))
        near = touched(stored(batch.sparkSession, path, rows.schema), rows).select(rows.columns)
        replace_partitions(core.upsert(near, rows, keys).select(rows.columns), path, "part", batch_id)

    return write


def merge_sink(path: str, keys: list[str], sums: list[str], part: Column):
    """A foreachBatch function that adds signed sums to stored ones. Each stored row knows the last batch that it
    took up and its sums before that, so a repeated batch starts from there again and adds nothing twice.
    ``merged`` reads the table."""
    before = [f"before_{c}" for c in sums]

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy(*keys).agg(*(F.sum(c).alias(f"new_{c}") for c in sums)).withColumn("part", part.cast("long"))
        kinds = {f.name: f.dataType for f in batch.schema.fields}
        fields = [T.StructField(k, kinds[k]) for k in keys] + [T.StructField(c, new.schema[f"new_{s}"].dataType) for s in sums for c in (s, f"before_{s}")] + [T.StructField("batch", T.LongType()), T.StructField("part", T.LongType())]
        table = T.StructType(fields)
        old = touched(stored(batch.sparkSession, path, table), new)
        base = {c: F.coalesce(F.when(F.col("batch") == batch_id, F.col(f"before_{c}")).otherwise(F.col(c)), F.lit(0)) for c in sums}
        both = old.join(new.withColumn("hit", F.lit(True)), [*keys, "part"], "full_outer")
        hit = F.col("hit").isNotNull()
        made = {c: F.when(hit, base[c] + F.col(f"new_{c}")).otherwise(F.col(c)) for c in sums}
        made |= {b: F.when(hit, base[c]).otherwise(F.col(b)) for c, b in zip(sums, before, strict=True)}
        made["batch"] = F.when(hit, F.lit(batch_id).cast("long")).otherwise(F.col("batch"))
        rows = both.select(*(made[f.name].cast(f.dataType).alias(f.name) if f.name in made else f.name for f in table))
        replace_partitions(rows.where(" OR ".join(f"{c} <> 0" for c in sums) + f" OR batch = {batch_id}"), path, "part", batch_id)

    return write


def merged(spark: SparkSession, path: str, sums: list[str]) -> DataFrame:
    """The sums that ``merge_sink`` holds; keys whose sums are all 0 are gone."""
    rows = spark.read.parquet(path)
    return rows.where(" OR ".join(f"{c} <> 0" for c in sums)).drop("batch", "part", *(f"before_{c}" for c in sums))


def change_feed(path: str, block: str = "block_number", item: str = "item_index", producers=None):
    """A foreachBatch function that writes one JSON event per block, with its items in order and, where ``producers(spark)``
    gives (block, producer), who built it. A repeated batch writes the same events over its own folder; the folder's number is the
    commit order, and inside it events are in the order of blocks."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in (block, item)]
        held = F.array_sort(F.collect_list(F.struct(item, *rest)))
        events = batch.groupBy(block).agg(held.alias("items"))
        fields = [block, "items"]
        if producers is not None:
            events = events.join(producers(batch.sparkSession).select(block, "producer"), block, "left")
            fields = [block, "producer", "items"]
        events.select(block, F.to_json(F.struct(*fields)).alias("event")).orderBy(block).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def diff_sink(path: str, keys: list[str]):
    """A foreachBatch function for snapshots: writes what came and went since the one before, one row a key; the
    first one is silent. Snapshots are kept by batch, so a repeated batch compares with the same one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        now = batch.select(*keys).distinct()
        now.write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
        now = batch.sparkSession.read.schema(now.schema).parquet(f"{path}/seen/batch={batch_id}")
        before = now if batch_id == 0 else stored(batch.sparkSession, f"{path}/seen/batch={batch_id - 1}", now.schema)
        core.set_diff(before, now, keys).write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")

    return write


def totals_sink(read, path: str, every: int = 1):
    """A foreachBatch function that recomputes figures after new rows: ``read(spark)`` gives name -> DataFrame;
    names that end in ``*`` are refreshed at every ``every``-th batch only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        for name, rows in read(batch.sparkSession).items():
            if not name.endswith("*") or batch_id % every == 0:
                rows.write.mode("overwrite").parquet(f"{path}/{name.rstrip('*')}/batch={batch_id}")

    return write
