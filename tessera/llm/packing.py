"""Packing of tokenised documents into fixed-length sequences by first-fit decreasing.

Each document is cut at multiples of the capacity, so only its last piece can leave room. Full pieces
are sequences as they stand and are only numbered. The last pieces, one a document at most, are dealt
into randomised groups of bounded size (repeated rows apart from one another), and each group is
packed by itself: pieces in falling length go to the first open sequence with room, which a
tournament tree over the remaining capacities finds in logarithmic time. Pieces are written before
they are counted, so texts are encoded once.

Defined results: strings of special tokens become their ids, as the library does by default; a null
or empty text is one piece that holds only the end id; a repeated row is
packed again as its own document; pieces of equal length are taken by document and place; an empty
table gives no rows. A null doc_id is packed like any other; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import encoder
from tessera.llm.shared import byte_slices, materialize

GROUP_PIECES = 16_384
#: Sequences that one full piece fills are numbered from here on.
FULL = 1 << 62


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    rows = docs.select("doc_id", "text")
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special=True)
        for batch in byte_slices(batches, "text"):
            at, out = [], []
            for i, ids in enumerate(enc.each(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), capacity):
                    cut = ids[s : s + capacity]
                    at.append(i)
                    out.append((s, len(cut), zlib.crc32(cut.tobytes()), len(ids), *([cut.astype(np.int32)] if keep_ids else [])))
            columns = [pa.array(c) for c in zip(*out, strict=True)] if not keep_ids else [*(pa.array(c) for c in list(zip(*out, strict=True))[:4]), pa.array([x[4] for x in out], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order.

    ``tree`` is a tournament over bins: a leaf holds what its bin has left, a node the larger of its
    two. Going to the left whenever that side has room finds the first fitting bin.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, need in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def assign(cut: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows of ``pieces``, a table that reads the same each time. Groups
    hold about ``group_pieces`` pieces that are not full, at any size of input."""
    place = F.monotonically_increasing_id()
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", place + FULL).withColumn("offset", F.lit(0).cast("long"))
    part = cut.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_pieces))
    dealt = part.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", place), F.lit(groups)))
    out = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fit(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]))
        bins, offsets = first_fit(group["length"].to_numpy(), capacity)
        first = group["pack_group"][0].as_py() << 32
        return group.drop_columns("pack_group").append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    return full.unionByName(dealt.groupBy("pack_group").applyInArrow(fit, out))


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return assign(materialize(pieces(docs, path, capacity, end_id, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in order and the offsets where documents begin. A sequence
    holds ``capacity`` ids at most, so the lists are bounded."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("held")).select("sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.offset").alias("offsets"), F.col("held.doc_id").alias("doc_ids"))
