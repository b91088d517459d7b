"""Exact removal of repeated passages with an enhanced suffix array.

Every ``length``-byte window of a text has a minimizer: the smallest hash of the ``gram``-byte
strings inside it. Equal windows have equal minimizers at equal places, so repeats can only be found
under one anchor (minimizer), and a partition by anchor loses none. A block is the longest string
whose windows all share one anchor occurrence (at most 2 * length - gram bytes).

1. Each task cuts texts into blocks and keeps the first of equal blocks of an Arrow batch; the others
   are repeats already. That pre-aggregation bounds what a hot passage sends to one task by the
   number of batches.
2. Sorted by anchor, block and place, equal blocks follow one another; all but the first are repeats.
   Anchors with two different blocks or more go on. Rows stream by; at most ``hot`` rows are held.
3. For these, all windows of the blocks are suffixes of an enhanced suffix array per anchor: sorted
   suffixes, common-prefix lengths, and the preceding bytes. A stack scan walks the tree of
   common-prefix intervals; those of ``length`` or more whose occurrences differ in the byte to the
   left are maximal repeats, and come out with all occurrences. The suffixes of anchors with more than
   ``hot`` different blocks are dealt out by their first ``length`` bytes, which is a subtree: the
   same tree in smaller pieces, with the same repeats.
4. In each repeat every occurrence but the first (smallest doc_id, then place) is to go.

Suffixes are compared by bytes. Blocks of one anchor are taken as equal if a 64-bit hash is, so of m
different blocks two are confused with a chance of about m^2 / 2^65.

Defined results: a null text counts as empty; rows without doc_id come back unchanged and take no
part; rows that repeat a doc_id and its text are one document; other texts of a repeated doc_id are
documents of their own, which follow one another by a hash of the text (at most 2^22 of one id);
texts below ``length`` bytes stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import byte_slices, materialize, whole_groups

LENGTH, GRAM = 100, 20
HOT_BLOCKS = 2048
#: A block's number of places is kept in eight bits beside its start.
LONGEST = 255
LOW = (1 << 63) - 1
BASE1, BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: ``start`` holds the number of the text among those of its doc_id above this bit.
TEXT_BITS = 31
#: Numbered texts of repeated ids are joined by broadcast up to so many.
SMALL = 100_000
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        size = 1 << max(16, n.bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, np.uint64(pow(key, -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _POWERS[key] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[key]


_BYTES = np.random.default_rng(11).integers(1 << 62, size=256, dtype=np.int64).astype(np.uint64)


class Hashed:
    """Hashes of any substring of a byte string from prefix sums."""

    def __init__(self, raw: np.ndarray, base: np.uint64):
        up, self.down = _powers(base, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=self.sums[1:])

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _places(values: np.ndarray, w: int) -> np.ndarray:
    """Where the smallest value of every window of ``w`` values stands, the last of equal ones, by
    doubling. The choice depends on the window's content alone."""
    value, place, size = values, np.arange(len(values), dtype=np.int32), 1
    n = len(values) - w + 1
    while size < w:
        step = min(size, w - size)
        right = value[step:] <= value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        size += step
    return place[:n]


def blocks(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, block hash, first window and number of windows of each block of joined texts.
    ``ends`` are the ends of the texts; no window crosses one."""
    none = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    if len(raw) < length:
        return none
    first = Hashed(raw, BASE1)
    grams = first.all(gram)
    place = _places((grams >> np.uint64(32)).astype(np.uint32), length - gram + 1)
    n = len(place)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.ones(len(raw) + 1, bool)
    for e, s in zip(ends.tolist(), starts.tolist(), strict=True):
        inside[max(s, e - length + 1) : e] = False
    inside = inside[:n]
    # a block goes on while the smallest gram is the same occurrence
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    new &= inside
    at = np.flatnonzero(new)
    if not len(at):
        return none
    edge = np.flatnonzero(np.concatenate([new | ~inside, [True]]))
    count = edge[np.searchsorted(edge, at, side="right")] - at
    stop = at + count + length - 1
    return grams[place[at]], first.at(at, stop) ^ Hashed(raw, BASE2).at(at, stop), at, count


#: ``place`` packs the first window, the number of windows (8 bits) and the kind (2 bits), to keep the shuffle narrow.
ANCHORS = "anchor long, block long, doc_id long, place long"
NAMES = ["anchor", "block", "doc_id", "place"]


def _parts(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, in parts of about ``most`` bytes (one text at least) with the place of the first.
    Hashing needs some hundred bytes a byte of text, so it goes by parts; equal blocks are sought in
    the whole batch."""
    part: list[bytes] = []
    held = first = 0
    for i, text in enumerate(texts):
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if part and held + len(raw) > most:
            yield first, part
            part, held, first = [], 0, i
        part.append(raw)
        held += len(raw)
    yield first, part


def _blocks_of(texts: list[bytes], ids: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, block, document, first window in it and number of windows of each block."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    a, b, at, count = blocks(np.frombuffer(b"".join(texts), np.uint8), ends, length, gram)
    doc = np.searchsorted(ends, at, side="right")
    starts = np.concatenate([[0], ends[:-1]])
    return a, b, ids[doc], at - starts[doc], count


def cut(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Blocks of all texts (kind 0; one of equal ones per batch) and, as kind 1, the others: repeats."""
    if not gram <= length <= gram + LONGEST:
        raise ValueError(f"with anchors of {gram} bytes, repeats of {gram} to {gram + LONGEST} bytes can be told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            number = batch.column(2).to_numpy()
            parts = [_blocks_of(part, np.arange(first, first + len(part)), length, gram) for first, part in _parts(batch.column(1))]
            a, b, row, start, count = (np.concatenate(c) for c in zip(*parts, strict=True))
            own, start = ids[row], start + (number[row] << TEXT_BITS)
            order = np.lexsort((start, own, b, a))
            a, b, own, start, count = (x[order] for x in (a, b, own, start, count))
            same = np.zeros(len(a), bool)
            same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            twin = np.zeros(len(a), bool)  # the same place of the same document
            twin[1:] = same[1:] & (own[1:] == own[:-1]) & (start[1:] == start[:-1])
            keep = ~twin
            # repeats need no partner any more: they are dealt out by their own place
            a = np.where(same, _mix(own.astype(np.uint64) * BASE1 + start.astype(np.uint64)), a)
            columns = (a.view(np.int64), b.view(np.int64), own, start << 10 | count << 2 | same)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=NAMES)

    return docs.mapInArrow(run, ANCHORS)


def compare(cuts: DataFrame, hot: int) -> DataFrame:
    """Kind 1: repeats. Kind 2: first of equal blocks under an anchor that has several blocks; ``block``
    then says whether they are more than ``hot``. Of an anchor that is under way, that many rows are held."""

    def out(a: np.ndarray, block: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, block, doc, place)], names=NAMES)

    def judge(held: np.ndarray, spilled: int | None) -> pa.RecordBatch:
        """Rows (anchor, doc, place) of whole anchors; ``spilled`` is one that is known to be hot."""
        a, doc, place = held
        group = np.cumsum(np.concatenate([[True], a[1:] != a[:-1]])) - 1 if len(a) else a
        several = np.bincount(group)[group] if len(a) else a
        known = a == spilled if spilled is not None else np.zeros(len(a), bool)
        take = (several > 1) | known
        return out(a[take], ((several > hot) | known)[take].astype(np.int64), doc[take], place[take] & ~3 | 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, spilled, held = None, None, np.empty((3, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, doc, place = (batch.column(i).to_numpy() for i in range(4))
            rows = np.stack([a, b, doc, place >> 10])
            before = np.concatenate([rows[:, :1] + 1 if last is None else last, rows[:, :-1]], axis=1)
            same = rows == before
            new = ~(same[0] & same[1])
            gone = place & 3 == 1
            # a repeat that a batch found stands apart from its block, so it is no block's first
            repeat = (~new | gone) & ~same.all(axis=0)
            yield out(a[repeat], np.zeros(int(repeat.sum()), np.int64), doc[repeat], place[repeat] & ~3 | 1)
            first = new & ~gone
            held = np.concatenate([held, np.stack([a[first], doc[first], place[first]])], axis=1)
            under_way = held[0] == a[-1]
            yield judge(held[:, ~under_way], spilled)
            held = held[:, under_way]
            spilled = spilled if spilled == a[-1] else None
            if spilled is not None or held.shape[1] > hot:
                spilled = int(a[-1])
                yield judge(held, spilled)
                held = held[:, :0]
            last = rows[:, -1:]
        yield judge(held, spilled)

    return cuts.mapInArrow(run, ANCHORS)


CONTEXT = [("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("count", pa.int32()), ("left", pa.int32()), ("raw", pa.binary())]


def contexts(docs: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """The bytes of blocks: one row per block, or one per suffix where an anchor is hot."""
    number = F.shiftright("start", TEXT_BITS)
    wanted = firsts.groupBy("doc_id", number.alias("number")).agg(F.collect_list(F.struct("anchor", "start", "count", (F.col("block") > 0).alias("hot"))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            out: list[tuple] = []
            many: list[tuple] = []
            for doc, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for x in held:
                    base, s = x["start"] >> TEXT_BITS << TEXT_BITS, x["start"] & (1 << TEXT_BITS) - 1
                    whole = raw[s : s + x["count"] + length - 1]
                    if x["hot"]:
                        for i in range(x["count"]):
                            key = int.from_bytes(hashlib.blake2b(whole[i : i + length], digest_size=8).digest(), "little", signed=True)
                            many.append((key, whole[i:], doc, base + s + i, whole[i - 1] if i else -1))
                    else:
                        out.append((x["anchor"], doc, x["start"], x["count"], -1, whole))
            # of equal suffixes of hot anchors, one of each batch goes on; the others (count 0) are repeats
            # already and are dealt out by their place
            many.sort(key=lambda x: x[:4])
            for (key, suffix), equal in itertools.groupby(many, key=lambda x: x[:2]):
                first, *rest = equal
                left = first[4] if all(x[4] == first[4] for x in rest) else -1
                out.append((key, first[2], first[3], 1, left, suffix))
                out += [(key ^ (x[2] * 1_000_003 + x[3]) & LOW, x[2], x[3], 0, -1, b"") for x in rest]
            columns = list(zip(*out, strict=True)) if out else [()] * len(CONTEXT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, CONTEXT, strict=True)], names=[n for n, _ in CONTEXT])

    return docs.join(wanted, ["doc_id", "number"]).select("doc_id", "text", "held").mapInArrow(run, "key long, doc_id long, start long, count int, left int, raw binary")


def interval_scan(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Intervals (common prefix, first, last) of a suffix array whose members share ``least`` or more
    and are preceded by different bytes. ``lcp[i]`` belongs to i - 1 and i; ``left`` holds the byte
    before each suffix, negative ones differing from all."""
    stack: list[list[int]] = []  # prefix length, first member, common left byte or -1
    for i in range(1, len(left) + 1):
        depth = lcp[i] if i < len(left) else 0
        first, byte = i - 1, left[i - 1]
        while stack and stack[-1][0] > depth:
            size, first, own = stack.pop()
            byte = own if own == byte else -1
            if byte < 0:
                yield size, first, i - 1
        if depth >= least:
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != byte:
                    stack[-1][2] = -1
            else:
                stack.append([depth, first, byte])


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at ``a`` and at ``b`` are the same."""
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    parts = [(view[a[i : i + 65536]] == view[b[i : i + 65536]]).all(axis=1) for i in range(0, len(a), 65536)]
    return np.concatenate(parts) if parts else np.empty(0, bool)


def repeats_of(key: np.ndarray, count: np.ndarray, raws: list[bytes], length: int, left: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats inside each key: their length and all occurrences (row, offset in the row). A
    row's first suffix is preceded by the byte ``left``, or by one unlike all others if that is negative."""
    left = np.full(len(raws), -1, np.int64) if left is None else left.astype(np.int64)
    joined = b"".join(raws)
    raw = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    base = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(raws)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = base[row] + offset
    window = Hashed(raw, BASE1).at(at, at + length)
    # suffixes whose first ``length`` bytes stand alone are no repeat; the rest are sorted
    order = np.lexsort((window, key[row]))
    w, k = window[order], key[row][order]
    same = (w[1:] == w[:-1]) & (k[1:] == k[:-1])
    if not _equal(raw, at[order[1:]][same], at[order[:-1]][same], length).all():
        # hashes that clash: windows are told apart by their bytes
        ids: dict[bytes, int] = {}
        window = np.array([ids.setdefault(joined[p : p + length], len(ids)) for p in at.tolist()], np.uint64)
        order = np.lexsort((window, key[row]))
        w, k = window[order], key[row][order]
        same = (w[1:] == w[:-1]) & (k[1:] == k[:-1])
    many = np.zeros(len(w), bool)
    many[1:] |= same
    many[:-1] |= same
    order, w, k = order[many], w[many], k[many]
    row, offset, at = row[order], offset[order], at[order]
    rest = (base + sizes)[row] - at
    deep = int(rest.max()) - length if len(rest) else 0
    words = -(-deep // 7) if deep > 0 else 0
    columns = []
    padded = np.concatenate([raw, np.zeros(7 * words + length + 8, np.uint8)])
    for j in range(words):  # seven bytes a word, each plus one, so that an end sorts first
        v = np.zeros(len(at), np.uint64)
        for x in range(7):
            p = length + 7 * j + x
            v = v * np.uint64(257) + np.where(p < rest, padded[at + p].astype(np.uint64) + np.uint64(1), np.uint64(0))
        columns.append(v)
    order = np.lexsort((*columns[::-1], w, k)) if columns else np.arange(len(w))
    row, offset, at, rest, w, k = (x[order] for x in (row, offset, at, rest, w, k))
    lcp = np.zeros(len(w), np.int64)
    if len(w):
        same = (w[1:] == w[:-1]) & (k[1:] == k[:-1])
        common = np.where(same, length, 0)
        going = same.copy()
        for p in range(deep):
            q = length + p
            going &= (q < rest[1:]) & (q < rest[:-1])
            if not going.any():
                break
            going &= padded[at[1:] + q] == padded[at[:-1] + q]
            common += going
        lcp[1:] = common
    # what stands before a block belongs to another anchor: its first window differs from all others
    before = np.where(offset > 0, padded[at - 1].astype(np.int64), left[row])
    rows, offsets = row.tolist(), offset.tolist()
    for size, a, b in interval_scan(lcp.tolist(), before.tolist(), length):
        yield size, list(zip(rows[a : b + 1], offsets[a : b + 1], strict=True))


def _tables(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """Per table of whole keys: rows that passed through (count 0), places of the others, repeats."""
    for table in whole_groups(batches, "key"):
        passed = table.filter(pc.equal(table.column("count"), 0))
        table = table.filter(pc.greater(table.column("count"), 0))
        doc, start, count = (table.column(c).to_numpy() for c in ("doc_id", "start", "count"))
        yield passed, doc.tolist(), start.tolist(), repeats_of(table.column("key").to_numpy(), count, table.column("raw").to_pylist(), length, table.column("left").to_numpy())


def maximal_repeats(found: DataFrame, length: int) -> DataFrame:
    """The repeats of ``suffixes`` themselves: size and all occurrences (doc_ids, starts), the first one
    first. Of equal blocks, the first stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, starts, repeats in _tables(batches, length):
            sizes, docs_out, starts_out, n = [], [], [], [0]
            for size, where in repeats:
                places = sorted({(docs[r], starts[r] + o) for r, o in where})
                if len(places) < 2:
                    continue
                sizes.append(size)
                docs_out.extend(p[0] for p in places)
                starts_out.extend(p[1] for p in places)
                n.append(len(docs_out))
            offsets = pa.array(n, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(docs_out, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(starts_out, pa.int64()))], names=["size", "doc_ids", "starts"])

    return found.mapInArrow(run, "size long, doc_ids array<long>, starts array<long>")


def later_spans(found: DataFrame, length: int) -> DataFrame:
    """doc_id, start, stop: all occurrences of maximal repeats but the first ones, joined where they
    overlap inside a block, so that nested repeats give no row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for passed, docs, starts, repeats in _tables(batches, length):
            covered: dict[int, list[dict]] = {}
            for size, where in repeats:
                first = min((docs[r], starts[r] + o) for r, o in where)
                for r, o in where:
                    if (docs[r], starts[r] + o) != first:
                        covered.setdefault(r, []).append({"start": starts[r] + o, "stop": starts[r] + o + size})
            rows = [(docs[r], s, e) for r, held in covered.items() for s, e in merge_spans(held, 1 << 62)]
            rows += [(d, s, s + length) for d, s in zip(passed.column("doc_id").to_pylist(), passed.column("start").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], names=["doc_id", "start", "stop"])

    return found.mapInArrow(run, "doc_id long, start long, stop long")


def numbered(docs: DataFrame) -> DataFrame:
    """Adds ``number``: the place of the text among the different texts of its doc_id, nearly always 0."""
    rows = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = rows.select("doc_id", "_h").distinct()
    several = texts.join(texts.groupBy("doc_id").count().where("count > 1"), "doc_id", "left_semi")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_h")) - 1
    later = materialize(several.withColumn("number", number.cast("long")).where("number > 0"), "texts")
    n = later.count()
    if not n:
        return docs.withColumn("number", F.lit(0).cast("long"))
    return rows.join(F.broadcast(later) if n <= SMALL else later, ["doc_id", "_h"], "left").drop("_h").withColumn("number", F.coalesce("number", F.lit(0).cast("long")))


def suffixes(known: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Repeats found by whole blocks (doc_id, start, stop), and the suffixes of all others by key."""
    cuts = cut(known.select("doc_id", "text", "number"), length, gram).repartition("anchor").sortWithinPartitions("anchor", "block", "doc_id", "place")
    judged = materialize(compare(cuts, hot).select("anchor", "block", "doc_id", F.shiftright("place", 10).alias("start"), (F.shiftright("place", 2) % 256).cast("int").alias("count"), (F.col("place") % 4).alias("kind")), "blocks")
    gone = judged.where("kind = 1").select("doc_id", "start", (F.col("start") + F.col("count") + (length - 1)).alias("stop"))
    return gone, contexts(known, judged.where("kind = 2"), length).repartition("key").sortWithinPartitions("key")


def spans(known: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_BLOCKS) -> DataFrame:
    """doc_id, number, start, stop (bytes) of strings that also start earlier; they may overlap.
    ``known`` has doc_id, text and number."""
    gone, found = suffixes(known, length, gram, hot)
    every = gone.unionByName(later_spans(found, length))
    place = lambda c: F.col(c).bitwiseAND(F.lit((1 << TEXT_BITS) - 1)).alias(c)
    return every.select("doc_id", F.shiftright("start", TEXT_BITS).alias("number"), place("start"), place("stop"))


def merge_spans(held: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, clipped to the text."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], min(x["stop"], size)) for x in held or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif s < e:
            out.append([s, e])
    return [tuple(x) for x in out]


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_BLOCKS, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, the kept
    text (whole characters) and the row itself as ``row``."""
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct("*").alias("row")] if keep_text else [])))
    covered = spans(rows.where("doc_id IS NOT NULL").select("doc_id", "text", "number"), length, gram, hot).groupBy("doc_id", "number").agg(F.collect_set(F.struct("start", "stop")).alias("held"))
    extra = f", kept string, row {rows.schema['row'].dataType.simpleString()}" if keep_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            out, kept = [], []
            for doc, text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = merge_spans(held, len(raw))
                left = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)], strict=True))
                out.append((doc, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
                kept.append(left.decode("utf-8", "ignore"))
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays, names = [*arrays, pa.array(kept, pa.string()), batch.column(3)], [*names, "kept", "row"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    joined = rows.join(covered, ["doc_id", "number"], "left").select("doc_id", "text", "held", *(["row"] if keep_text else []))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)


def clean(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_BLOCKS) -> DataFrame:
    """The rows of ``docs`` with repeats cut out of ``text``. Bytes of a character that a cut splits
    go as well; rows of which nothing is left are dropped."""
    done = remove(docs, length, gram, hot, keep_text=True).where("n_removed = 0 OR n_removed < n_bytes")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return done.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
