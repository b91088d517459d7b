"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens. DataFrame
functions only.

Tokens of 20 or more characters of [A-Za-z0-9+/_=-] are candidates. Their encoding is inferred (hex,
base32, base64), and three tests ask how unlike written text they are:

* chi-squared of the alphabet's counts: written text is uneven, so its statistic grows with the
  length; a value far below what text of that length gives speaks for chance;
* runs of character classes (upper, lower, digit, other): words, paths and identifiers change class
  less often than chance does;
* serial correlation: vowels and consonants alternate in text, which chance doesn't do; and strings
  whose neighbouring codes correlate (ordered or repeated ones) are no chance either.

Each gives a normal score against "text of that length", the scores are combined (Stouffer), and the
false-discovery rate is controlled within classes of length (Benjamini-Hochberg over a histogram of
p-values of all candidates, a bounded table). Tokens below the class's threshold are spans of kind
``random``. Pattern spans always stay.

Positions are code points: the texts between matches come from a split by the same pattern, and their
lengths are summed in blocks of 256 matches.

Defined results: a null text counts as empty and has no spans; rows repeat as given; a null doc_id is
a row like others; without candidates no threshold exists and no ``random`` span is found; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The patterns, the group that is measured, and the least length of that group.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = [*PATTERNS, "random"]
RATE = 0.01
BINS = 400
#: Fixed values by encoding: alphabet size; then of words, paths, dotted and camel-case identifiers written
#: in it, at the end nearest to chance: the chance that two characters are equal (English letters: 0.066;
#: less with two cases and separators), the share of neighbours that differ in class, and the lag-1
#: correlation of vowels (null: not used). Each is followed by its standard deviation times sqrt(length).
ENCODINGS = {"hex": (16, 0.11, 0.10, 0.10, 0.4, None, 0.8), "base32": (32, 0.062, 0.10, 0.05, 0.3, -0.37, 0.8), "base64": (64, 0.050, 0.10, 0.30, 0.3, -0.25, 0.8)}
ENCODING_FIELDS = ("k", "equal", "equal_sd", "change", "change_sd", "vowel", "vowel_sd")
VOWELS = [float(ord(c)) for c in "aeiouAEIOU"]
BLOCK = 256


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, part) of all matches; ``part`` is the group."""
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    rows = F.zip_with(F.zip_with(hits, parts, lambda h, p: F.struct(F.length(h).alias("n"), p.alias("p"))), F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(g.alias("gap"), h["n"].alias("n"), h["p"].alias("part")))

    def walk(block: Column) -> Column:
        empty = F.expr("named_struct('pos', 0, 'out', cast(array() as array<struct<start:int,end:int,part:string>>))")
        return F.aggregate(block, empty, lambda acc, x: F.struct((acc["pos"] + x["gap"] + x["n"]).alias("pos"), F.concat(acc["out"], F.array(F.struct((acc["pos"] + x["gap"]).alias("start"), (acc["pos"] + x["gap"] + x["n"]).alias("end"), x["part"].alias("part")))).alias("out")))

    count = F.ceil(F.size(hits) / F.lit(float(BLOCK))).cast("int")
    walked = F.transform(F.sequence(F.lit(0), count - 1), lambda c: walk(F.slice(rows, c * BLOCK + 1, F.lit(BLOCK))))
    bases = F.aggregate(walked, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["pos"])))
    moved = F.zip_with(walked, F.slice(bases, F.lit(1), count), lambda b, base: F.transform(b["out"], lambda x: F.struct((x["start"] + base).alias("start"), (x["end"] + base).alias("end"), x["part"].alias("part"))))
    return F.when(F.rlike(text, F.lit(pattern)), F.flatten(moved))


def _cdf(z: Column) -> Column:
    """The normal distribution, by its logistic approximation (error below 2e-4)."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def battery(token: Column) -> Column:
    """struct(p, size_class) of a token: the combined p-value of "this is text" and its class of
    length. A token that is short without its padding has p 1."""

    def encoded(t: Column) -> Column:
        kind = F.when(F.rlike(t, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), "hex").when(F.rlike(t, F.lit("^[A-Z2-7]+$")), "base32").otherwise("base64")
        values = [F.struct(*(F.lit(x).cast("double").alias(name) for name, x in zip(ENCODING_FIELDS, v, strict=True))) for v in ENCODINGS.values()]
        return _let(kind, lambda e: F.when(e == "hex", values[0]).when(e == "base32", values[1]).otherwise(values[2]))

    def scores(t: Column, e: Column, v: Column) -> Column:
        n = F.length(t).cast("double")
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(v, lambda x: x == c)).cast("double"), F.lit(2.0)))
        chi = squares * e["k"] / n - n
        z_chi = (e["k"] * (1 + (n - 1) * e["equal"]) - n - chi) * F.sqrt(n) / (e["k"] * (n - 1) * e["equal_sd"])
        shape = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "A" * 26 + "a" * 26 + "0" * 10 + "+" * 4)
        runs = F.length(F.regexp_replace(shape, r"(.)\1+", "$1")).cast("double") - 1
        z_runs = (runs / (n - 1) - e["change"]) * F.sqrt(n) / e["change_sd"]

        def correlation(d: Column) -> Column:
            """Lag-1 correlation of an array of numbers; null where all are equal."""
            lag = lambda c: _sum(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * b))
            centred = lambda m: _let(F.transform(d, lambda x: x - m), lambda c: F.try_divide(lag(c), _sum(F.transform(c, lambda x: x * x))))
            return _let(_sum(d) / n, centred)

        ordered = F.least(F.coalesce(F.abs(correlation(v)), F.lit(0.999)), F.lit(0.999))
        z_ordered = (F.atanh(F.lit(0.5)) - F.atanh(ordered)) * F.sqrt(F.greatest(n - 3, F.lit(1.0)))
        vowels = F.transform(v, lambda x: F.when(x.isin(VOWELS), 1.0).otherwise(0.0))
        z_vowels = F.coalesce((correlation(vowels) - e["vowel"]) * F.sqrt(n) / e["vowel_sd"], F.lit(0.0))
        z_serial = F.least(z_ordered, z_vowels)
        z = F.least(F.greatest((z_chi + z_runs + z_serial) / F.lit(3.0**0.5), F.lit(-8.0)), F.lit(8.0))
        p = _let(z, lambda x: F.greatest(1 - _cdf(x), F.lit(1e-12)))
        return F.struct(F.when(n >= 16, p).otherwise(1.0).alias("p"), F.when(n < 32, 0).when(n < 64, 1).otherwise(2).alias("size_class"))

    def whole(t: Column) -> Column:
        codes = F.transform(F.filter(F.split(t, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c).cast("double"))
        return F.when(F.length(t) < 16, F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("size_class"))).otherwise(_let(encoded(t), lambda e: _let(codes, lambda v: scores(t, e, v))))

    return _let(F.rtrim(token, F.lit("=")), whole)


def thresholds(candidates: DataFrame, rate: float = RATE) -> DataFrame:
    """One row: the largest p-value accepted in each class of length. ``candidates`` has p and
    size_class; p-values fall into ``BINS`` logarithmic bins, so what is ranked is bounded."""
    step = 12.0 / BINS
    bins = candidates.groupBy("size_class", F.floor(-F.log10("p") / step).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    least = Window.partitionBy("size_class").orderBy(F.desc("bin"))
    whole = Window.partitionBy("size_class")
    upper = F.pow(F.lit(10.0), -F.col("bin") * step)
    ranked = bins.withColumn("rank", F.sum("c").over(least)).withColumn("m", F.sum("c").over(whole)).withColumn("upper", upper)
    passed = ranked.where(F.col("upper") <= rate * F.col("rank") / F.col("m"))
    most = lambda c: F.coalesce(F.max(F.when(F.col("size_class") == c, F.col("upper"))), F.lit(0.0))
    return passed.agg(F.array(most(0), most(1), most(2)).alias("limits"))


def _at_least(least: int):
    return lambda x: F.length(x["part"]) >= least


#: Characters of a chunk of a text that is rewritten.
CHUNK = 1024


def _is(kind: int):
    return lambda x: x["kind"] == kind


def _spans(hits: Column, kind: int) -> Column:
    """Array of (start, kind, end); null becomes empty."""
    made = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.coalesce(made, F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Each row of ``docs`` as ``row``, and ``found``: array of (start, kind number, end) in order."""
    inner = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")
    tokens = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CANDIDATE), F.lit(0))).alias("token"))
    limit = F.broadcast(thresholds(tokens.select(battery(F.col("token")).alias("s")).select("s.*"), rate).withColumn("one", F.lit(1)))
    base = []
    for i, (pattern, group, least) in enumerate(PATTERNS.values()):
        base.append(_spans(F.filter(located(t, pattern, group), _at_least(least)), i))
    rows = inner.select("row", F.concat(*base).alias("base"), located(t, CANDIDATE).alias("tokens"))
    scored = F.transform("tokens", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["part"]).alias("s")))
    rows = rows.withColumn("scored", scored).withColumn("one", F.lit(1)).join(limit, "one", "left")
    low = F.filter("scored", lambda x: x["s"]["p"] <= F.element_at("limits", x["s"]["size_class"] + 1))
    return rows.select("row", F.array_sort(F.concat("base", _spans(low, len(PATTERNS)))).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts per pattern, the hash of the pattern spans, and all spans as text."""
    name = F.array(*(F.lit(k) for k in KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.filter("found", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return found.select("row.doc_id", *counts, F.sha2(written(F.filter("found", lambda x: x["kind"] < len(PATTERNS))).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def redact(found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows with every span of ``text`` replaced; overlapping spans are one. A text is cut once into chunks, and spans
    are walked through block by block, so the work grows with the text and not with its square."""
    # get() and slice() take no place twice: a part between two places costs its own length and a chunk or two
    low = lambda at: F.floor(at / CHUNK).cast("int")
    chunk = lambda i: F.coalesce(F.get("chunks", i), F.lit(""))

    def part(start: Column, stop: Column) -> Column:
        head = F.substring(chunk(low(start)), F.pmod(start, F.lit(CHUNK)) + 1, F.lit(CHUNK))
        middle = F.array_join(F.slice("chunks", low(start) + 2, F.greatest(low(stop) - low(start) - 1, F.lit(0))), "")
        tail = F.substring(chunk(low(stop)), F.lit(1), F.pmod(stop, F.lit(CHUNK)))
        one = F.substring(chunk(low(start)), F.pmod(start, F.lit(CHUNK)) + 1, stop - start)
        return F.when(stop <= start, "").when(low(start) == low(stop), one).otherwise(F.concat(head, middle, tail))

    def step(acc: Column, x: Column) -> Column:
        new = x["end"] > acc["pos"]
        parts = F.concat(acc["parts"], F.array(part(acc["pos"], x["start"]), F.when(x["start"] >= acc["pos"], F.lit(mark)).otherwise(F.lit(""))))
        return F.struct(F.when(new, x["end"]).otherwise(acc["pos"]).alias("pos"), F.when(new, parts).otherwise(acc["parts"]).alias("parts"))

    count = F.ceil(F.size("found") / F.lit(float(BLOCK))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice("found", b * BLOCK + 1, F.lit(BLOCK)))
    rows = found.withColumn("many", F.size("found") > 0).withColumn("chunks", F.when(F.col("many"), F.regexp_extract_all(F.coalesce("row.text", F.lit("")), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    rows = rows.withColumn("blocks", F.when(F.col("many"), blocks)).withColumn("ends", F.transform("blocks", lambda b: F.array_max(F.transform(b, lambda x: x["end"]))))
    rows = rows.withColumn("from", F.transform("ends", lambda _, i: F.coalesce(F.array_max(F.slice("ends", 1, i)), F.lit(0))))
    empty = lambda pos: F.struct(pos.alias("pos"), F.expr("cast(array() as array<string>)").alias("parts"))
    walked = F.zip_with("blocks", "from", lambda b, pos: F.aggregate(b, empty(pos), step, lambda acc: F.array_join(acc["parts"], "")))
    cut = F.concat(F.array_join(walked, ""), part(F.array_max("ends"), F.length("row.text")))
    clean = F.when(F.col("many"), cut).otherwise(F.col("row.text"))
    return rows.select(*(clean.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in found.schema["row"].dataType.names))
