"""Byte-level BPE over Arrow batches.

A batch of texts is cut into pre-tokens with vectorised character classes. A byte-to-character map
turns the cuts into an Arrow array over the texts' own bytes, whose dictionary (exact: Arrow compares
bytes) holds each distinct pre-token once. A bounded table of words remembers the ids of pre-tokens
seen before; new ones go through the ``tokenizers`` library. Token offsets come from token byte
lengths and the same map; decoding joins the bytes of the ids, so characters that are split over
tokens come back whole.

Defined results: a null text counts as empty (no tokens); an empty text has no tokens; texts of any
length are encoded whole; repeated rows give repeated results; special-token strings are ordinary
text, unless an encoder is asked to take them as the library does by default; columns that the caller does not name pass through untouched, but for a column that bears the
name of an output, which the output replaces; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import byte_slices

LETTER, NUMBER, SPACE, OTHER, END = 1, 2, 3, 0, 4
#: The white space of the split pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What a worker remembers: words (as a power of two), ids, and bytes of words.
SLOTS_BITS, KEPT_IDS, KEPT_BYTES = 20, 6_000_000, 16_000_000
#: Characters encoded at once, and words handed to the library at once.
CHUNK = 400_000
WORDS = 16_384


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


@functools.cache
def classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE] = SPACE
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def _halves(ranks: dict[bytes, int], token: bytes) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``: merges of lower rank, applied until two remain."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


@functools.cache
def load(path: str) -> tuple[object, list[bytes]]:
    """A tokenizers.Tokenizer that takes pre-tokens, and the bytes of each id."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on every core
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_chars()
    if path.endswith(".json"):
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        back = {c: b for b, c in enumerate(chars)}
        vocab = tok.get_vocab(with_added_tokens=False)
        table = [b""] * (max(tok.get_vocab().values()) + 1)
        for token, i in vocab.items():
            table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    else:
        ranks = read_ranks(path)
        text = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [tuple(text[x] for x in _halves(ranks, t)) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1]
        tok = Tokenizer(models.BPE(vocab={text[t]: i for t, i in ranks.items()}, merges=merges))
        table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tok.no_truncation()
    return tok, table


def split_words(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of joined texts; ``ends`` are the places of the separators.

    Works on runs of letters, numbers, white space and other characters: the last blank before a
    run joins it, other white space stands alone, and an apostrophe that starts a pre-token takes a
    following s, t, m, d, re, ve or ll.
    """
    kind = classes()[points]
    kind[ends] = END
    n = len(kind)
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[ends] = True
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points[:-1] == 0x27) & (kind[:-1] == OTHER) & (kind[1:] == LETTER) & start[: n - 1])
    if len(quote):
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, size in ((quote[short], 1), (quote[long], 2)):
            start[found + 1] = False
            start[found + 1 + size] = True
    return np.flatnonzero(start[:n])


def byte_places(points: np.ndarray) -> np.ndarray:
    """The byte at which each character begins, and the number of bytes at the end."""
    size = np.ones(len(points), np.int32)
    for least in (0x80, 0x800, 0x10000):
        size += points >= least
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``starts``, one range after the other."""
    before = np.cumsum(sizes, dtype=np.int64) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum(dtype=np.int64)))


class Pool:
    """A growing array; ``add`` returns where the new values begin."""

    def __init__(self, kind: type):
        self.held, self.used = np.empty(1 << 18, kind), 0

    def add(self, values: np.ndarray) -> int:
        first, self.used = self.used, self.used + len(values)
        if self.used > len(self.held):
            self.held = np.resize(self.held, max(2 * len(self.held), self.used))
        self.held[first : self.used] = values
        return first


class Encoder:
    """Ids of whole texts; one per Python worker.

    Pre-tokens seen before are found in a direct-mapped table by a hash of their bytes; the bytes are
    compared before an entry is taken, so a clash of hashes costs a new entry and never a wrong id."""

    def __init__(self, path: str, special: bool = False):
        """``special``: strings of special tokens become their ids (a ``.json`` vocabulary names them)."""
        self.tok, self.table = load(path)
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items() if t.special} if special else {}
        self.start()

    def start(self) -> None:
        self.lengths = np.array([len(x) for x in self.table], np.int64)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mix = np.random.default_rng(20240101).integers(1 << 62, size=256, dtype=np.int64).astype(np.uint64)
        self.up = self.down = np.empty(0, np.uint64)
        self.reset()

    def reset(self) -> None:
        slots = 1 << SLOTS_BITS
        self.key, self.at, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.offset, self.count = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids, self.bytes = Pool(np.uint32), Pool(np.uint8)

    def split(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return split_words(points, ends)

    def hashes(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        if len(raw) > len(self.up):
            n = 1 << len(raw).bit_length()
            self.up, self.down = np.full(n, 0x9E3779B97F4A7C15, np.uint64), np.full(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.mix[raw] * self.up[: len(raw)], out=sums[1:])
        return (sums[stops] - sums[starts]) * self.down[starts] | np.uint64(1)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of new pre-tokens into the pool; their places there and counts."""
        found = []
        for i in range(0, len(words), WORDS):  # an encoding is far larger than its ids
            found += [e.ids for e in self.tok.encode_batch_fast(words[i : i + WORDS], add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int32, len(found))
        first = self.ids.add(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(count.sum())))
        return (first + np.cumsum(count) - count).astype(np.int32), count

    def known(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool of ids, and counts, of distinct pre-tokens."""
        edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2], np.uint8)[: edges[-1]]
        starts, size = edges[:-1], np.diff(edges)
        h = self.hashes(raw, starts, edges[1:])
        slot = (h >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
        hit = np.flatnonzero((self.key[slot] == h) & (self.size[slot] == size))
        n = size[hit]
        same = self.bytes.held[_gather(self.at[slot[hit]], n)] == raw[_gather(starts[hit], n)]
        fine = np.zeros(len(words), bool)
        if len(hit):
            fine[hit] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        offset, count = self.offset[slot], self.count[slot]
        miss = np.flatnonzero(~fine)
        if len(miss):
            offset[miss], count[miss] = self.learn(words.take(pa.array(miss)).to_pylist())
            n = size[miss]
            first = self.bytes.add(raw[_gather(starts[miss], n)])
            at = slot[miss]
            self.key[at], self.size[at], self.at[at], self.offset[at], self.count[at] = h[miss], n, first + np.cumsum(n) - n, offset[miss], count[miss]
        return offset, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many belong to each text."""
        if self.ids.used > KEPT_IDS or self.bytes.used > KEPT_BYTES:
            self.reset()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = self.split(points, ends)
        cuts = byte_places(points)[np.append(starts, len(points))]
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(joined.encode())).dictionary_encode()
        text_of = np.searchsorted(ends, starts)
        real = starts != ends[text_of]
        text_of, index = text_of[real], words.indices.to_numpy()[real]
        offset, count = self.known(words.dictionary)
        offset, count = offset[index], count[index]
        return self.ids.held[_gather(offset, count)], np.bincount(text_of, weights=count, minlength=len(texts)).astype(np.int64)

    def each(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in chunks of bounded size."""
        group: list[str] = []
        held = 0
        for i, text in enumerate(texts):
            if self.cut and self.cut.search(text or ""):
                if group:
                    ids, counts = self.encode(group)
                    yield from np.split(ids, np.cumsum(counts)[:-1])
                    group, held = [], 0
                yield self.with_special(text)
                continue
            group.append(text or "")
            held += len(group[-1])
            if held > CHUNK or i == len(texts) - 1:
                ids, counts = self.encode(group)
                yield from np.split(ids, np.cumsum(counts)[:-1])
                group, held = [], 0
        if group:
            ids, counts = self.encode(group)
            yield from np.split(ids, np.cumsum(counts)[:-1])

    def with_special(self, text: str) -> np.ndarray:
        """The ids of a text in which special strings stand for their ids."""
        parts = self.cut.split(text)
        ids, counts = self.encode(parts[::2])
        found = np.split(ids, np.cumsum(counts)[:-1])
        marks = [np.array([self.special[x]], np.uint32) for x in parts[1::2]]
        return np.concatenate([x for pair in itertools.zip_longest(found, marks) for x in pair if x is not None])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each token; a token that holds part of a character
        counts the whole of it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80)
        stop = np.cumsum(self.lengths[ids])
        start = stop - self.lengths[ids]
        return (char[start] - 1 if len(raw) else start), (char[stop - 1] if len(raw) else stop)


@functools.cache
def encoder(path: str, special: bool = False) -> Encoder:
    return Encoder(path, special)


def _without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that outputs of these names replace."""
    lower = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in lower))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: bool = False) -> DataFrame:
    """Adds ``ids`` (array of long) and, if asked for, ``token_start`` and ``token_stop``
    (characters). ``path`` is a ``.tiktoken`` or ``.json`` vocabulary, readable on every worker."""
    df = _without(df, ids, *(("token_start", "token_stop") if offsets else ()))
    more = [T.StructField(ids, T.ArrayType(T.LongType(), False), False)]
    if offsets:
        more += [T.StructField(c, T.ArrayType(T.LongType(), False), False) for c in ("token_start", "token_stop")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in byte_slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = list(enc.each(texts))
            out = [found]
            if offsets:
                places = [enc.offsets(t or "", i) for t, i in zip(texts, found, strict=True)]
                out += [[p[0] for p in places], [p[1] for p in places]]
            arrays = [pa.array([x.astype(np.int64) for x in c], pa.list_(pa.int64())) for c in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *(f.name for f in more)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (binary): the bytes of the ids; null ids give empty bytes."""
    df = _without(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = [b"".join(map(enc.table.__getitem__, r or ())) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType(), False)]))


def digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text and keeps counts and SHA-256 digests; ids stay inside the task.
    Besides, from the offsets: n_chars, the characters that the tokens cover, and n_split, the tokens
    that begin inside a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in byte_slices(batches, text):
            out: list[list] = [[], [], [], [], []]
            texts = batch.column(1).to_pylist()
            for given, ids in zip(texts, enc.each(texts), strict=True):
                start, stop = enc.offsets(given or "", ids)
                found = (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest(), int(stop[-1]) if len(stop) else 0, int(np.count_nonzero(start[1:] < stop[:-1])))
                for held, value in zip(out, found, strict=True):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars", "n_split"])

    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias(text))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long, n_split long")
