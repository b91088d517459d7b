"""Helpers that several operators share: cutting lineage and streaming sorted Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a temporary one if all tasks run in
    this process (tests); a cluster must name one, since a machine's own folder would lose rows."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends here, and a
    lost executor costs no more than a new read. Each call takes a folder of its own.

    Rows of megabytes need row groups of so many bytes: Parquet else writes a hundred of them before it looks
    at their size, and a task that reads holds a group's rows, up to 4096, at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    groups = {} if group_bytes is None else {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1}
    df.write.options(compression="zstd", **groups).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of about ``most`` bytes of ``column`` (one row at least), so
    that memory follows bytes and not rows."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        lengths = [x or 0 for x in sizes.to_pylist()]
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # idle workers hold no more than they must


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroups batches that are sorted by ``key`` so that no key spans two tables."""
    import numpy as np

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        if last > 0:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = [batch.slice(last)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)
