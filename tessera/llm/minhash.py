"""Near-duplicate detection by a signature-coordinate inverted join.

A document's set of word shingles becomes ``k`` MinHash coordinates. Every coordinate-value pair is
a posting list. With at least ``matches`` of ``k`` coordinates equal asked of a pair, two documents
must meet within the ``k - matches + 1`` rarest postings of each (prefix), so common postings, such
as those of a passage that many documents share, are skipped. Collisions are counted over the
signature, pairs at or above the match threshold are confirmed on the full sets, and the confirmed
links give the components.

The chance that a pair at the similarity of 0.8 has fewer than 34 of 64 equal coordinates is below
1e-6. Sets that are equal are one class from the start, so copies never meet as pairs. Within a
posting list members are first compared with a pivot, then with other pivots for a few rounds, and
only what is still in different components is compared pair by pair; a link inside a component would
change nothing, so nothing is lost and no list gives all its pairs. Before that, the shingles that a
document shares with any other bound its similarity to every partner: postings that the bound rules
out for all members of their list are dropped, and pairs are held against it inside the joins. The
last round also compares bitmaps of the sets (the parity of the members in each of 512 hash classes):
the bits that differ are a lower bound of the symmetric difference, which rules pairs out exactly.

Hot keys: counts of tokens and of shingles are joined back by broadcast where a key holds more than a
ten-thousandth of all rows (ten thousand keys at most), and by hash otherwise. A posting list of
more than ``LIST_PART`` members is split by a hash of the member, and what its members are compared
with is sent to each part.

Defined results: a null or blank text has an empty set and stays alone; with fewer words than a
shingle the whole sequence is one shingle; rows without doc_id are left out; rows that repeat a
doc_id are one document, whose set is the one with the smallest key of all its rows' sets; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import merged
from tessera.llm.shared import byte_slices, materialize

K, MATCHES = 64, 34
ROUNDS = 2
HOT_KEYS = 10_000
LIST_PART = 4096
#: Columns of the bitmaps, and the size and hashes of a set.
BITS = [f"bits{i}" for i in range(8)]
KEYS = ["n_shingles", "key1", "key2"]
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORDS_KEPT = 250_000


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word shingles, sorted. Words end at ASCII white space;
    A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    step = np.uint64(0x9E3779B97F4A7C15)
    n = len(h) - width + 1
    if n < 1:
        out = np.full(1, len(h), np.uint64)
        for w in h:
            out = out * step + w
        return _mix(out)
    out = h[:n].copy()
    for i in range(1, width):
        out = out * step + h[i : i + n]
    return np.unique(_mix(out))


def coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1 << 32, size=(k, 1), dtype=np.uint32), rng.integers(1 << 32, size=(k, 1), dtype=np.uint32) | np.uint32(1)


def signature(found: np.ndarray, flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(flip), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        y = (x[i : i + 4096] ^ flip) * times
        y ^= y >> np.uint32(15)
        np.minimum(least, y.min(axis=1), out=least)
    return least.view(np.int32)


def set_keys(found: np.ndarray) -> tuple[int, int, int]:
    """Size and two hashes of a set."""
    a = int(np.sum(_mix(found ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).view(np.int64))
    b = int(np.bitwise_xor.reduce(_mix(found * np.uint64(0xD1342543DE82EF95))).view(np.int64)) if len(found) else 0
    return len(found), a, b


def signatures(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, n_shingles, two keys of the set, and the signature (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, times = coefficients(k)
        for batch in byte_slices(batches, "text"):
            keys, sig = [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                keys.append(set_keys(found))
                sig.append(signature(found, flip, times) if len(found) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*keys, strict=True)), pa.array(sig, pa.list_(pa.int32()))], names=["doc_id", *KEYS, "sig"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, sig array<int>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, its whole set of shingle hashes, and the bitmap of the set; of a repeated doc_id, the
    set with the smallest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            found = [shingles(t, width) for t in batch.column(1).to_pylist()]
            bits = np.array([np.packbits(np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=512) & 1).view(np.int64) for h in found]).reshape(-1, 8)
            sets = pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))
            keys = zip(*map(set_keys, found), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in keys), sets, *(pa.array(bits[:, i]) for i in range(8))], names=["doc_id", *KEYS, "shingles", *BITS])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in KEYS)}, shingles array<long>, " + ", ".join(f"{b} long" for b in BITS))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("shingles", *BITS), F.struct(*KEYS)).alias("s")).select("doc_id", "s.*")


def counted(rows: DataFrame, key: str, total: int, name: str) -> DataFrame:
    """``rows`` whose ``key`` appears in two rows or more, with that number as ``df``. Keys of more than
    1 / ``HOT_KEYS`` of the ``total`` rows, of which there can't be more than ``HOT_KEYS``, are joined
    by broadcast; what is dealt out by key holds no hot one."""
    counts = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("df")).where("df > 1"), name)
    least = max(LIST_PART, total // HOT_KEYS)
    hot, rest = F.broadcast(counts.where(F.col("df") > least)), counts.where(F.col("df") <= least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def _n_parts() -> Column:
    return F.ceil(F.col("df") / LIST_PART)


def by_part(rows: DataFrame) -> DataFrame:
    """Members of posting lists of ``df`` members, with the part of the list that they belong to."""
    return rows.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), _n_parts()))


def to_parts(rows: DataFrame) -> DataFrame:
    """Each row once for every part of its list."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _n_parts() - 1))).drop("df")


def prefixes(reps: DataFrame, k: int, matches: int) -> DataFrame:
    """rep, token, df: the postings in which a document can meet a partner. Postings of one document
    only are dropped, but hold their places in the prefix."""
    post = reps.select("rep", F.posexplode("sig").alias("place", "value")).select("rep", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    shared = counted(post, "token", reps.count() * k, "tokens").groupBy("rep").agg(F.collect_list(F.struct("df", "token")).alias("held"))
    room = F.lit(k - matches + 1) - (F.lit(k) - F.size("held"))
    rare = shared.where((F.size("held") >= matches) & (room > 0)).select("rep", F.explode(F.slice(F.array_sort("held"), F.lit(1), room)).alias("p"))
    return rare.select("rep", F.col("p.token").alias("token"), F.col("p.df").alias("df"))


def reachable(shared: Column, n: Column, other: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``other`` members that have ``shared`` in common at most can be similar."""
    return shared * 100 >= percent * (n + other - shared)


def bounded(post: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Postings with n and shared (shingles that another taking document has as well); without those
    that no member of their list can reach."""
    each = sets.select(F.col("doc_id").alias("rep"), F.explode("shingles").alias("g"))
    total = reps.agg(F.sum("n_shingles")).first()[0] or 0
    shared = counted(each, "g", total, "shingles").groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    rows = post.join(reps.select("rep", F.col("n_shingles").alias("n")).join(shared, "rep"), "rep")
    least = to_parts(rows.groupBy("token").agg(F.min("n").alias("least"), F.max("df").alias("df")))
    other = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    return by_part(rows).join(least, ["token", "part"]).where(reachable(F.col("shared"), F.col("n"), other, percent)).select("rep", "token", "df", "n", "shared")


def confirm(pairs: DataFrame, reps: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures match often enough and whose full sets are similar enough."""
    left = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    near = pairs.join(left, "a").join(right, "b").where(sizes).where(equal >= matches).select("a", "b")
    sa, sb = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    return near.join(sa, "a").join(sb, "b").where(both * 100 >= percent * (F.size("xa") + F.size("xb") - both)).select("a", "b")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, matches: int = MATCHES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    seen = materialize(signatures(docs, width, k).groupBy("doc_id").agg(F.min(F.struct("n_shingles", "key1", "key2", "sig")).alias("s")).select("doc_id", "s.*"), "signatures")
    classes = materialize(seen.where("n_shingles > 0").groupBy(*KEYS).agg(F.min("doc_id").alias("rep")), "classes")
    reps = materialize(classes.select("rep", "n_shingles").join(seen.select(F.col("doc_id").alias("rep"), "sig"), "rep"), "reps")
    post = materialize(prefixes(reps, k, matches), "prefixes")
    taking = post.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(full_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(taking, "doc_id", "left_semi"), width), "sets")
    reps = materialize(reps.join(taking.select(F.col("doc_id").alias("rep")), "rep", "left_semi"), "taking")
    post = materialize(bounded(post, reps, sets, percent), "bounded")
    near = reachable(F.least("shared", "x_shared"), F.col("n"), F.col("x_n"), percent)
    tried = label = None
    for turn in range(rounds + 1):
        held = post.withColumn("root", F.col("rep")) if label is None else post.join(label.select(F.col("v").alias("rep"), F.col("root").alias("r")), "rep", "left").select("rep", "token", "df", "n", "shared", F.coalesce("r", "rep").alias("root"))
        draw = F.struct((F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")).alias("draw"), "rep", "root", "n", "shared")
        mixed = held.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("df").alias("df"), F.min(draw).alias("p")).where("low < high")
        all_ = by_part(held)
        if turn < rounds:
            few = to_parts(mixed.select("token", "df", *(F.col(f"p.{c}").alias(x) for c, x in (("rep", "x"), ("root", "x_root"), ("n", "x_n"), ("shared", "x_shared")))))
        else:
            all_ = all_.join(to_parts(mixed.select("token", "df")), ["token", "part"], "left_semi").join(sets.select(F.col("doc_id").alias("rep"), *BITS), "rep")
            most = all_.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), F.max("df").alias("df")).groupBy("token").agg(F.max_by("root", "c").alias("main"), F.max("df").alias("df"))
            apart = all_.join(to_parts(most), ["token", "part"]).where("root <> main")
            few = to_parts(apart.select("token", "df", F.col("rep").alias("x"), F.col("root").alias("x_root"), F.col("n").alias("x_n"), F.col("shared").alias("x_shared"), *(F.col(b).alias(f"x_{b}") for b in BITS)))
            differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"x_{b}"))) for b in BITS), F.lit(0))
            size = F.col("n") + F.col("x_n")
            near = near & ((100 + percent) * (size - differ) >= 2 * percent * size)
        pairs = all_.join(few, ["token", "part"]).where("root <> x_root").where(near).select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            if turn == rounds or mixed.isEmpty():
                break
            continue
        tried = pairs if tried is None else tried.union(pairs)
        label = merged(label, confirm(pairs, reps, sets, matches, percent))
    out = seen.join(classes.select(*KEYS, "rep"), KEYS, "left")
    if label is not None:
        out = out.join(label.withColumnRenamed("v", "rep"), "rep", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("long"))
    best = F.coalesce("root", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", best.alias("component_id"), (best == F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that name their component; rows without doc_id stay, and so do all rows of
    a doc_id that stays."""
    gone = near_components(docs, width, percent).where("NOT kept").select("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
