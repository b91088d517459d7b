"""Grouping of spelling variants: words at one edit, found through asymmetric q-chunks.

Of two words at one edit, the chunk word (the shorter one, or either of two of equal length) is cut into two disjoint
chunks, its halves. The edit touches one of them at most, so the other is among the positional grams of the
second word, at the same place or, behind an inserted character, one place on. Halves alone are met by
too many words, so what the method says of the word is said again of its other half, which holds the edit
by then: ``depth`` times, each with two chunks of what is left. The join key is the length of the chunk word, the place of the
part that is left over, and all chunks that are kept; a key meets an equal one only, so the shift is at most one. Each pair that meets
is verified by its edit distance. With depth 1 the chunks are plain halves; every depth gives the same pairs.

Word counts are gathered per document and batch before they are shuffled, and every later step works on
distinct words: copies of documents cost nothing there. Words grow with the corpus, and Spark sizes them by compressed
files and their keys as if there were one a word; so joins are by hint sorted ones, and no words pass through the driver. Forms rise at least tenfold in
frequency, so chains are short; they are followed by doubling, each step written to the shared folder.

Defined results: a null text has no words; a null doc_id counts as the empty text before the colon of the rule;
repeated rows count again; a run that loses its only letter is no word; an empty table gives no rows; other
columns are ignored. Equal counts are settled by code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import byte_slices, materialize

#: A to Z are lower-cased before; the two bytes are U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Words that a task counts before it passes them on.
HELD_WORDS = 200_000


def words(docs: DataFrame, every: int = 31, least: int = 7) -> DataFrame:
    """Words of at least ``least`` characters with their counts per batch: word, n (not summed over batches).

    A run of one document keeps or loses the same letter wherever it stands in it, so it is judged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in byte_slices(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall(text.encode().lower() if text else b"")).items():
                    h = zlib.crc32(word, start)
                    if h % every == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    if len(word) >= least and (len(word) >= 2 * least or len(word.decode()) >= least):
                        held[word] += n
            if len(held) > HELD_WORDS:
                yield out()
        yield out()

    return docs.select(F.col("doc_id").cast("string"), F.col("text")).mapInArrow(run, "word string, n long")


def _keys(word: Column, length: Column, more: int, depth: int) -> Column:
    """The keys of a word as chunk word (more = 0), or as second word with ``more`` characters than the
    chunk word, whose length is ``length``. Halving ``depth`` times leaves one of 2^depth even parts over."""
    kept, parts = [], 1 << depth
    for part in range(parts):
        start, stop = (F.shiftright(length * k, depth) for k in (part, part + 1))
        kept.append(F.xxhash64(length, F.lit(part), F.substring(word, F.lit(1), start), F.substring(word, stop + 1 + more, length - stop)))
    return F.array(*kept)


def near_pairs(counted: DataFrame, depth: int = 3) -> DataFrame:
    """Pairs of ``counted`` words (word, n) at one edit, once each: a, na, b, nb."""
    w = counted.withColumn("m", F.length("word"))
    chunks = w.select("word", "n", "m", F.explode(_keys(F.col("word"), F.col("m"), 0, depth)).alias("key"))
    grams = w.select("word", "n", "m", F.explode(F.concat(_keys(F.col("word"), F.col("m"), 0, depth), _keys(F.col("word"), F.col("m") - 1, 1, depth))).alias("key"))
    met = chunks.select("key", F.col("word").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma")).join(grams.select("key", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb")).hint("merge"), "key")
    fits = (F.col("mb") == F.col("ma") + 1) | (F.col("mb") == F.col("ma")) & (F.col("a") < F.col("b"))
    return met.where(fits).where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form), by doubling."""
    p = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        up = p.select(F.col("word").alias("root"), F.col("root").alias("above"))
        q = materialize(p.join(up.hint("merge"), "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        p = q.select("word", "root")
        if q.where("moved").isEmpty():
            return p


def group(docs: DataFrame, least: int = 7, occurrences: int = 2, times: int = 10, every: int = 31, depth: int = 3) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least ``least`` characters and ``occurrences``.

    A word's form is its near word of largest count (the smallest of equals) if that is at least ``times`` its own."""
    counted = materialize(words(docs, every, least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences), "words")
    pairs = materialize(near_pairs(counted, depth), "near")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("minus"), F.col("b").alias("word")).alias("other")).union(pairs.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("minus"), F.col("a").alias("word")).alias("other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    enough = -F.col("best")["minus"] >= times * F.col("n")
    found = counted.join(best.hint("merge"), "word", "left").select("word", F.when(enough, F.col("best")["word"]).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("best")["minus"]).alias("form_n"))
    found = materialize(found, "near_of")
    roots = _roots(found.where(F.col("form").isNotNull()))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
