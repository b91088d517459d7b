"""Several tables that change in one step.

Each table is a set of parts. A commit writes new content of the parts that it touches, for every table, into folders
of its own number, and last of all one small list that says in which commit's folder each part of each table
is to be read. Until that list is there, readers see the tables as they were; a commit that is repeated
after a failure writes the same folders again. A part that has become empty is left out of the list.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "name string, part long, held_by long"


def _lists(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the commits that are done."""
    try:
        files = spark.read.schema(LIST).parquet(f"{base}/commits").inputFiles()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted({int(n) for f in files for n in re.findall(r"/commits/commit=(\d+)/", f)})


def parts(spark: SparkSession, base: str, before: int | None = None) -> dict[tuple[str, int], int]:
    """(table, part) -> the commit that holds it: as many entries as there are folders to read."""
    done = [n for n in _lists(spark, base) if before is None or n < before]
    if not done:
        return {}
    return {(r.name, r.part): r.held_by for r in spark.read.schema(LIST).parquet(f"{base}/commits/commit={done[-1]}").collect()}


def current(spark: SparkSession, base: str, name: str, schema, only: set[int] | None = None, before: int | None = None) -> DataFrame:
    """A table as of the last commit (or the last one ``before`` a number); of its parts only those asked for."""
    held = {p: n for (table, p), n in parts(spark, base, before).items() if table == name and (only is None or p in only)}
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{base}/{name}/commit={n}/part={p}" for p, n in sorted(held.items())))


def commit(base: str, number: int, tables: dict[str, DataFrame], touched: set[int], spark: SparkSession) -> None:
    """Puts ``tables`` (rows with ``part``; all that the touched parts hold from now on) in place, all at once."""
    held = {k: n for k, n in parts(spark, base, number).items() if k[1] not in touched or k[0] not in tables}
    for name, rows in tables.items():
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{base}/{name}/commit={number}")
        found = [] if rows.isEmpty() else spark.read.parquet(f"{base}/{name}/commit={number}").select("part").distinct().collect()
        held |= {(name, int(r.part)): number for r in found}
    spark.createDataFrame([(name, p, n) for (name, p), n in held.items()], LIST).coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/commit={number}")


def block_sink(base: str, block: str = "block_number", chunk: int = 1000, others: dict | None = None):
    """A foreachBatch function for batches of items (all rows of their blocks). In the tables ``items`` and ``blocks``,
    and in ``others`` (name -> function of the batch that gives rows with the block), the rows of these blocks are replaced in one
    commit. A row without ``item_index`` says that its block is there and empty: its old items go and the block stays."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        listed = batch.select(block).distinct()
        tables = {"items": batch.where("item_index IS NOT NULL"), "blocks": batch.groupBy(block).agg(F.count("item_index").alias("n"))}
        tables |= {name: made(batch) for name, made in (others or {}).items()}
        part = F.floor(F.col(block) / chunk).cast("long")
        hit = {r.part for r in listed.select(part.alias("part")).distinct().collect()}
        whole = {}
        for name, rows in tables.items():
            rows = rows.distinct()
            kept = current(spark, base, name, rows.schema, hit, batch_id).join(listed, block, "left_anti").select(rows.columns)
            whole[name] = kept.unionByName(rows).withColumn("part", part)
        commit(base, batch_id, whole, hit, spark)

    return write
