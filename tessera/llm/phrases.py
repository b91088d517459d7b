"""Phrase collocations by SON partitioning.

The corpus is dealt into shards. A phrase that is frequent in the whole is frequent in one shard at least, when
each shard asks for its share of the support: the words that it has of a language, in proportion,
rounded up. So every shard is mined completely at its lowered support, what is frequent in any shard is
a candidate, and the candidates are counted over all documents, exactly. Of a candidate that could not
reach the support even if every other shard held just less than its share, the count is spared.

The support is a number, not a share, so shards that stay small as the corpus grows would end at a
support of one and call everything a candidate. There are therefore ``SHARDS`` of them at any size, and a
shard is mined by many tasks: its phrases are counted by a 64-bit hash, level by level, and a level looks only
at places whose two shorter phrases were frequent in the shard. Which were is told by a bit table of fixed size.
Clashes, of hashes or in the table, add candidates and never lose one; the last count is by words.

Texts are read once, into blocks of one language: word numbers and the block's dictionary. A block is
all that a task holds.

Defined results: a null text counts as empty, a null lang as ``und``; a repeated row counts again; phrases never
cross pieces or documents; an empty table, or one without a frequent phrase, gives no rows; other columns are
ignored. Equal scores are settled by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import byte_slices, materialize

SHARDS = 4
#: Bits of the table of frequent phrases, as a power of two (16 MB).
BITS = 27
#: Bytes of text in a block, and bytes of all languages that a task holds before it closes blocks.
BLOCK_BYTES, HELD_BYTES = 2 << 20, 8 << 20
#: Bytes of a row group of blocks, and blocks that a task is handed at once: what a task reads doesn't grow with its share.
GROUP_BYTES, HANDED = 16 << 20, 4
#: Bytes of added-up counts that a task of the last count holds before it hands them on.
COUNT_BYTES = 8 << 20
LONGEST = 5
#: Characters that end a piece (`[.,;:!?\\x0A-\\x0D]`); the byte 255 is in no text.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
MARK = 255
TABLE = bytes(MARK if b in ENDS else 0x20 if b == 0x09 else b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * TURN
    return x ^ (x >> np.uint64(29))


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words], np.uint64)


def _numbered(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The distinct words of ``texts``, and their numbers (from 1) in order, with 0 between pieces."""
    raw = np.frombuffer(b"\xff".join(t.encode() for t in [*texts, ""]).translate(TABLE), np.uint8)
    mark = raw == MARK
    word = ~(mark | (raw == 0x20))
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & ~before)
    stops = np.flatnonzero(before & ~word)
    places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(raw[word].tobytes())).dictionary_encode()
    piece = np.cumsum(mark)[starts]
    new = np.concatenate([[False], piece[1:] != piece[:-1]]) if len(starts) else np.zeros(0, bool)
    codes = np.zeros(len(starts) + int(new.sum()), np.int32)
    codes[np.arange(len(starts)) + np.cumsum(new)] = found.indices.to_numpy() + 1
    return found.dictionary, codes


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts: shard, lang, n_words, words, counts (of each word), hashes, codes."""
    names = ["shard", "lang", "n_words", "words", "counts", "hashes", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % SHARDS
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            words, codes = _numbered(held.pop(lang))
            size.pop(lang)
            counts = np.bincount(codes, minlength=len(words) + 1)[1:]
            row = [shard, lang, int(counts.sum()), words.to_pylist(), counts, word_hashes(lang, words.to_pylist()).tobytes(), codes.tobytes()]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in byte_slices(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 100
                if size[lang] > BLOCK_BYTES:
                    yield close(lang)
                elif sum(size.values()) > HELD_BYTES:
                    yield close(max(size, key=size.__getitem__))
        for lang in list(held):
            yield close(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "shard int, lang string, n_words long, words array<string>, counts array<long>, hashes binary, codes binary")


def _bit_table(keys: DataFrame, *shard: str) -> Broadcast:
    """The bit table of the hashes in ``key`` (apart for each shard, if a column is named), at most
    2^BITS / 64 longs, as a broadcast."""
    place = F.shiftrightunsigned("key", 64 - BITS)
    if shard:
        place = place.bitwiseXOR(F.col(shard[0]).cast("long") * ((1 << BITS) // SHARDS))
    long, bit = F.shiftright(place, 6), F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros((1 << BITS) // 64, np.int64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table.tobytes())


def _holds(table: bytes, keys: np.ndarray, shard: int = 0) -> np.ndarray:
    bits = (len(table) * 8).bit_length() - 1
    place = (keys >> np.uint64(64 - bits)) ^ np.uint64(shard * ((1 << bits) // SHARDS))
    return np.frombuffer(table, np.uint64)[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1


def _chained(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of the phrases without their last word, and of that word."""
    return _mixed(grams * MIX + words)


def _level(cut: DataFrame, frequent: Broadcast, below: Broadcast | None, shortest: int, longest: int) -> DataFrame:
    """Phrases of ``shortest`` to ``longest`` words with their counts per block: shard, lang, key, n.

    Only places where all words are frequent anywhere (``frequent``) and all phrases of one word less
    than ``shortest`` are frequent in the shard (``below``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, hashes, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                hashes = np.concatenate([np.zeros(1, np.uint64), np.frombuffer(hashes.as_buffer(), np.uint64)])
                fine = _holds(frequent.value, hashes)
                fine[0] = False
                codes = np.frombuffer(codes.as_buffer(), np.int32)
                words, good = hashes[codes], fine[codes]
                grams = words
                for k in range(2, longest + 1):
                    grams = _chained(grams[:-1], words[k - 1 :])
                    good = good[:-1] & good[1:]
                    if k == shortest - 1 and below is not None:
                        good &= _holds(below.value, grams, shard)
                    if k >= shortest:
                        keys, counts = np.unique(grams[good], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), shard, np.int32)), pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["shard", "lang", "key", "n"])

            pa.default_memory_pool().release_unused()

    return cut.select("shard", "lang", "hashes", "codes").mapInArrow(run, "shard int, lang string, key long, n long")


def _added(counts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Adds up ``n`` over rows with the same other columns, handing on what it holds whenever that exceeds ``most`` bytes.

    New rows are added to the sums once they are as many, so a row is taken up about twice."""
    sums, new, size = None, [], 0

    def added() -> pa.Table:
        table = pa.Table.from_batches(new if sums is None else [*sums.to_batches(), *new])
        names = [x for x in table.column_names if x != "n"]
        return table.group_by(names, use_threads=False).aggregate([("n", "sum")]).select([*names, "n_sum"]).rename_columns([*names, "n"])

    for batch in counts:
        new.append(batch)
        size += batch.num_rows
        if size >= max(1 << 16, 0 if sums is None else sums.num_rows):
            sums, new, size = added(), [], 0
            if sums.nbytes > most:
                yield from sums.to_batches(max_chunksize=1 << 16)
                sums = None
    if new:
        sums = added()
    if sums is not None:
        yield from sums.to_batches(max_chunksize=1 << 16)


def _counted(cut: DataFrame, candidates: Broadcast) -> DataFrame:
    """Counts of the phrases whose hash is a candidate's, told apart by their words: lang, k, phrase, n.

    A row for each block and phrase in it would make rows as blocks times candidates, and both grow with the
    corpus. So there is one task a core at any size, and each adds up its blocks before it hands counts on."""

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, names, hashes, codes in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                hashes = np.concatenate([np.zeros(1, np.uint64), np.frombuffer(hashes.as_buffer(), np.uint64)])
                codes = np.frombuffer(codes.as_buffer(), np.int32).astype(np.int64)
                words = hashes[codes]
                grams, numbers, at = words, codes, np.flatnonzero(codes)
                for k in range(2, LONGEST + 1):
                    grams = _chained(grams[:-1], words[k - 1 :])
                    at = at[at < len(grams)]
                    at = at[(codes[at + k - 1] > 0) & _holds(candidates.value, grams[at])]
                    if not len(at):
                        break
                    _, first, number, counts = np.unique(numbers[at] * len(hashes) + codes[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                    numbers = np.zeros(len(codes), np.int64)
                    numbers[at] = number
                    parts = [names.values.take(pa.array(codes[at[first] + j] - 1)) for j in range(k)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(first), np.int32))), pa.array(np.full(len(first), k, np.int32)), pc.binary_join_element_wise(*parts, " "), pa.array(counts.astype(np.int64))], names=["lang", "k", "phrase", "n"])

            pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _added(by_block(batches), COUNT_BYTES)

    few = cut.coalesce(cut.sparkSession.sparkContext.defaultParallelism)
    return few.select("lang", "words", "hashes", "codes").mapInArrow(run, "lang string, k int, phrase string, n long")


@contextmanager
def _batches_of(spark: SparkSession, blocks: int) -> Iterator[None]:
    """Arrow batches of so many rows in the jobs inside: a task that reads many blocks is handed a few at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(blocks))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frequent_phrases(docs: DataFrame, support: int = 100) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to five words that occur ``support`` times or more in a language (lang, k, phrase, f), and
    the languages with their words (lang, n)."""
    cut = materialize(blocks(docs), "blocks", GROUP_BYTES)
    totals = materialize(cut.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0"), "totals")
    least = cut.groupBy("shard", "lang").agg(F.sum("n_words").alias("own")).join(totals, "lang").select("shard", "lang", F.expr(f"cast(({support} * cast(own as decimal(38,0)) + n - 1) div n as long)").alias("least"))
    least = materialize(least, "supports")
    each = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
    words = materialize(each.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support).select("lang", F.lit(1).alias("k"), "phrase", "f"), "frequent")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, given = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = [word_hashes(lang, [w])[0] for lang, w in zip(langs, given, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], names=["key"])

    frequent = _bit_table(words.select("lang", "phrase").mapInArrow(hashed, "key long"))
    below, found = None, []
    for shortest, longest in ((2, 2), (3, 3), (4, LONGEST)):
        counts = _level(cut, frequent, below, shortest, longest).groupBy("shard", "lang", "key").agg(F.sum("n").alias("n"))
        local = counts.join(least, ["shard", "lang"]).where(F.col("n") >= F.col("least")).select("shard", "lang", "key", (F.col("n") - F.col("least") + 1).alias("more"))
        with _batches_of(docs.sparkSession, HANDED):
            found.append(materialize(local, "local"))
        if longest < LONGEST:
            below = _bit_table(found[-1], "shard")
    # A shard in which a phrase isn't frequent holds less than its share; what is above the shares must make up for the rest.
    most = least.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("most"))
    above = found[0].union(found[1]).union(found[2]).groupBy("lang", "key").agg(F.sum("more").alias("more"))
    candidates = _bit_table(above.join(most, "lang").where(F.col("more") + F.col("most") >= support).select("key"))
    phrases = _counted(cut, candidates).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support)
    with _batches_of(docs.sparkSession, HANDED):
        phrases = materialize(phrases, "phrases")
    return words.union(phrases), totals


def collocations(docs: DataFrame, support: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two to five words of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase whose words lie inside a longer frequent one with ``percent`` of its count or more goes: it is
    enough to look at those with one word more, since counts fall with length. Frequent phrases grow with the corpus
    and Spark sizes them by compressed files, so their joins are sorted ones by hint and none pass through the driver."""
    frequent, totals = frequent_phrases(docs, support)
    w = frequent.where("k > 1").withColumn("w", F.split("phrase", " ", -1))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    inside = w.where("k > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = w.join(inside.hint("merge"), ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {percent} * f")
    cuts = kept.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select("lang", "phrase", F.col("f").alias("a"), "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda side, name: frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)).hint("merge")
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = scored.withColumn("score", F.expr("cast((cast(a as decimal(38,0)) * n * 1000) div (cast(l as decimal(38,0)) * r) as long)"))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return worst.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
