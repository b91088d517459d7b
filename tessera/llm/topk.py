"""Exact top-k search by inner product, exhaustive and term at a time.

Vectors become integers, floor(scale * x). Candidates are dealt into blocks that hold, per term
(dimension), the postings of non-zero weights; queries are sparse rows of (term, weight). For each
query the postings of its terms are scattered, weighted, into a dense score array over the block; a
partition selection keeps the block's k best, and a window merges the blocks. Every query meets
every block, so nothing is missed; a block's memory is bounded by its rows, since equal rows are one
row with a number of times. Vectors travel as bytes; a task reads a block once and then streams the
queries, of which each block gets a copy.

Defined results: vectors that are null or hold a null or a non-finite component take no part; a
null id takes no part; equal scores go to the smaller id; with fewer than k candidates all are
returned; a vector shorter than another has zeros for its missing components; a repeated id is a
candidate as often as it appears, but never for the query of the same id; a query id that repeats
asks once, with its smallest vector; integers beyond 64 bits count as the nearest 64-bit one, inner
products are exact, and a score beyond 64 bits is written as the nearest; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
QUERY_ROWS = 512
LONG = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and integer components of the vectors that take part."""
    v = F.col(f"`{vec_col}`")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(f"`{id_col}`").isNotNull()).where(fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
    """Deals rows (id, times, v) at random into ``count`` blocks; one row per block: its number and its
    rows, the components as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).cast(pa.large_list(pa.int64()))
            offsets = (lists.offsets.to_numpy() - lists.offsets[0].as_py()) * 8
            raw = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(lists.flatten().to_numpy(zero_copy_only=False).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw.cast(pa.binary())], names=["id", "times", "raw"])

    packed = rows.select("id", "times", "v").mapInArrow(pack, "id long, times long, raw binary")
    return packed.groupBy(F.pmod(F.xxhash64("id", "raw"), F.lit(count)).alias(name)).agg(F.collect_list(F.struct("id", "times", "raw")).alias(f"{name}_rows"))


def matrix(raws: list[bytes]) -> np.ndarray:
    """Components by term and row; missing ones are 0."""
    sizes = np.array([len(r) // 8 for r in raws])
    out = np.zeros((int(sizes.max(initial=0)), len(raws)), np.int64)
    before = np.cumsum(sizes) - sizes
    out[np.arange(int(sizes.sum())) - np.repeat(before, sizes), np.repeat(np.arange(len(raws)), sizes)] = np.frombuffer(b"".join(raws), np.int64)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: partition selection, then ties by the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], np.int64)
    if len(scores) > k:
        least = -np.partition(-scores, k - 1)[k - 1]
        found = np.flatnonzero(scores >= least)
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((ids[found], -scores[found]))][:k]


class Block:
    """Candidates as postings: per term, the rows that weigh something there and their weights."""

    def __init__(self, ids: list[int], times: list[int], raws: list[bytes]):
        dense = matrix(raws)
        self.ids, self.times = np.array(ids, np.int64), np.array(times, np.int64)
        self.most = max(abs(int(dense.max(initial=0))), abs(int(dense.min(initial=0))))
        self.postings = [np.flatnonzero(row) for row in dense]
        self.weights = [dense[t, p] for t, p in enumerate(self.postings)]

    def score(self, query: int, weights: list[int], k: int) -> list[tuple[int, int, int]]:
        """The k best of the block for a query, term at a time."""
        fits = self.most * max(map(abs, weights), default=0) * max(1, len(weights)) <= LONG // 2
        scores = np.zeros(len(self.ids), np.int64 if fits else object)
        for term, weight in enumerate(weights[: len(self.postings)]):
            if weight:
                own = self.weights[term]
                scores[self.postings[term]] += weight * (own if fits else own.astype(object))
        other = np.flatnonzero(self.ids != query)
        out = []
        for j in other[best(scores[other], self.ids[other], k)]:
            score = max(-LONG - 1, min(LONG, int(scores[j])))
            out += [(query, int(self.ids[j]), score)] * min(k, int(self.times[j]))
        return out[:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on the column ``id``."""
    rows = usable(vectors, id_col, vec_col, scale)
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    n_c, n_q = max(1, -(-n // block_rows)), max(1, -(-asking // query_rows))
    cand = _blocks(rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("times")), n_c, "c")
    asked = _blocks(rows.where(is_query).groupBy("id").agg(F.lit(1).cast("long").alias("times"), F.min("v").alias("v")), n_q, "q")
    # Queries are copied for every block, so a join would send them to the driver whenever they look small uncopied.
    copied = asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)).cast("array<long>")))
    dealt = cand.select("c", F.lit(False).alias("asks"), F.col("c_rows").alias("rows")).union(copied.select("c", F.lit(True), "q_rows"))
    dealt = dealt.repartition(n_c, "c").sortWithinPartitions("c", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, None
        fields = lambda rows: [rows.field(f).to_pylist() for f in ("id", "times", "raw")]
        for batch in batches:
            for i, (block, asks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids, times, raws = fields(batch.column(2)[i].values)
                if not asks:
                    number, held = block, Block(ids, times, raws)
                elif block == number:
                    found = [x for q, r in zip(ids, raws, strict=True) for x in held.score(q, np.frombuffer(r, np.int64).tolist(), k)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
