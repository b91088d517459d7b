"""Quality rules: counts per text, and a hashed n-gram log-likelihood ratio of a trusted target
against the raw corpus. DataFrame functions only.

Words are maximal runs of characters other than ASCII white space. Word unigrams and bigrams fall
into ``buckets`` by hash. The raw multinomial counts them over all documents; the trusted one over
documents of quality 1 in the labels, of which at most ``trusted_docs`` are taken (by the order of a
hash of their id; the bound keeps their ids fit for a broadcast). A bucket weighs
log((t + c) / (e + c)), t being its trusted count and e the count expected from the raw corpus, so
rare buckets say nothing. A document scores the mean weight of its n-grams and passes at or above
``threshold``; the threshold is fixed, so a verdict depends on the two multinomials alone.

The corpus counts are one aggregation with map-side sums of at most ``buckets`` groups, written
before totals are taken, so texts are counted in one pass. The weights are a constant of ``buckets``
floats in the plan (a scalar subquery), and every text is scored in its own row, so no text is
shuffled and no group exists that could be hot.

Defined results: a null, empty or blank text has no words, fails the base and is not kept; a null
doc_id is a row like others; rows repeated in full stay repeated; without labels all weights are 0
and what passes the base is kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 15
TRUSTED_DOCS = 20_000
#: Added to both counts: with 20, no good document of a fold that wasn't learned from fell at 1 000 or 10 000
#: documents (with 5, one of eight did at 1 000, where most n-grams are rare).
PRIOR = 20.0
THRESHOLD = -0.06


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.array(F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    return F.element_at(F.transform(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), 1)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the optimizer merges projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _neighbours(a: Column, b: Column, skip: int) -> Column:
    """Hashes of element i of ``a`` with element i + skip of ``b``."""
    n = F.greatest(F.size(b) - skip, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(skip + 1), n), lambda x, y: F.xxhash64(x, y))


def repeat_words(windows: Column) -> Column:
    """Words covered by windows (hashes) found twice or more.

    Windows are sorted as plain longs that hold the leading bits of the hash and the place; neighbours
    that agree in the leading bits are the only ones that can be equal. Of these the whole hashes are
    sorted with their places, equal neighbours give the places, and each place adds what the one
    before left open."""

    def near(p: Column, m: Column) -> Column:
        pairs = F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.when(b - F.pmod(b, m) == a - F.pmod(a, m), F.array(F.pmod(a, m), F.pmod(b, m))))
        return F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))

    def places(o: Column) -> Column:
        same = F.zip_with(o, F.slice(o, F.lit(2), F.size(o)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        marked = _let(same, lambda s: F.zip_with(s, F.slice(F.concat(F.array(F.lit(False)), s), F.lit(1), F.size(s)), lambda a, b: a | b))
        return F.array_sort(F.filter(F.zip_with(o, marked, lambda x, y: F.when(y, x["i"])), lambda x: x.isNotNull()))

    def total(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x).cast("long")

    def counted(t: Column) -> Column:
        bits = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(t) + 2.0))).cast("long")
        packed = lambda m: F.sort_array(F.transform(t, lambda h, i: h - F.pmod(h, m) + i))
        maybe = _let(bits, lambda m: _let(packed(m), lambda p: near(p, m)))
        order = lambda c: F.array_sort(F.transform(c, lambda i: F.struct(F.get(t, i.cast("int")).alias("h"), i.cast("int").alias("i"))))
        return _let(maybe, lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(_let(order(c), lambda o: _let(places(o), total))))

    return _let(windows, counted)


def measured(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The row, the counts, base_failed, and the n-gram buckets of each text."""

    def counts(h: Column, two: Column) -> Column:
        grams = F.transform(F.concat(h, two), lambda g: F.pmod(g, F.lit(buckets)).cast("int"))
        return F.struct(F.size(h).cast("long").alias("n_words"), repeat_words(_neighbours(two, h, 2)).alias("n_repeat_words"), grams.alias("grams"))

    text = F.coalesce("text", F.lit(""))
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    all_counts = _let(hashed, lambda h: _let(_neighbours(h, h, 1), lambda two: counts(h, two)))
    bare = F.length(F.translate(text, BLANKS, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    rows = docs.select(F.struct("*").alias("row"), all_counts.alias("m"), bare.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), dup_lines(text).cast("long").alias("n_dup_lines"))
    failed = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    return rows.select("row", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"), "m.grams")


def trusted(labels: DataFrame, most: int = TRUSTED_DOCS) -> DataFrame:
    """Ids of at most ``most`` documents of quality 1."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """bucket, weight: at most ``buckets`` rows."""
    known = F.broadcast(trusted(labels, trusted_docs).withColumn("good", F.lit(1)))
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    grams = docs.select("doc_id", _let(hashed, lambda h: F.concat(h, _neighbours(h, h, 1))).alias("grams"))
    grams = grams.join(known, "doc_id", "left").select("good", F.explode("grams").alias("g"))
    counts = grams.groupBy(F.pmod("g", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("r"), F.coalesce(F.sum("good"), F.lit(0)).alias("t"))
    counts = materialize(counts, "grams")
    both = counts.agg(F.sum("r").alias("all_r"), F.sum("t").alias("all_t")).withColumn("one", F.lit(1))
    expected = F.col("all_t") * F.col("r") / F.col("all_r")
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(both), "one").select("bucket", F.log((F.col("t") + PRIOR) / (expected + PRIOR)).cast("float").alias("weight"))


def model(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """One row: the weights of all buckets in order, 0 where the corpus has none."""
    known = weights(docs, labels, buckets, trusted_docs)
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(known), "bucket", "left")
    ordered = F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0.0).cast("float")).alias("weight"))))
    return materialize(every.agg(F.transform(ordered, lambda x: x["weight"]).alias("model")), "weights")


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of ``docs`` as ``row``, its counts, base_failed, kept and score."""
    # the optimizer moves the constant to its one use, so rows don't carry it
    rows = measured(docs, buckets).withColumn("model", model(docs, labels, buckets, trusted_docs).scalar())
    total = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.get("model", g).cast("double"))
    rows = rows.withColumn("score", F.coalesce(F.try_divide(total, F.size("grams").cast("double")), F.lit(0.0)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("grams", "model")


def judge(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score, one row per row of ``docs``."""
    return judged(docs, labels, **more).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose verdict is kept."""
    # by a generator and not a filter, which the optimizer would copy below the measurements
    return judged(docs, labels).select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")
