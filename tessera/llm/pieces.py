"""SentencePiece BPE encoding by prefix tables, and decoding.

The encoding of a text ends, for each of its prefixes, in one token only, and two tokens may stand
side by side exactly if the merges of their joined text leave both of them (merges inside a token
never depend on what stands around it). So an automaton over all pieces gives the candidates that end
at each place, one of them is compatible with the last token of the prefix before it, and the ids
are read backwards from the end of the table. No merge is carried out on texts. Tables are built per
stretch: a text is cut wherever no piece holds its two neighbouring characters in a row, so no token
crosses a cut; equal stretches of an Arrow batch are looked up once, and a bounded table of words keeps what a
worker has seen (``bpe.Encoder``).

Only models of type BPE without text rules are read (identity normalizer, byte fallback); others are
refused. Defined results: a null text counts as empty (no tokens); texts of any length are encoded
whole; strings that look like control or byte pieces are ordinary text; the mark U+2581 in a text is
encoded as a blank, as the library does; repeated rows give repeated results; columns that the caller
does not name pass through untouched, but for a column that bears the name of an output, which the
output replaces; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bpe
from tessera.llm.shared import byte_slices

BLANK = "▁"
#: No piece holds it, so it parts stretches in the automaton's input.
BREAK = "\n"
#: Pairs of tokens whose verdict a worker keeps.
KEPT_PAIRS = 2_000_000
NEVER = 1 << 60

codecs.register_error("tessera-each", lambda e: ("�", e.start + 1))


class Model:
    """The vocabulary: pieces with their ranks, and how each was merged from two parts."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        named = [lib.id_to_piece(i) for i in range(n)]
        self.bytes_of = {int(named[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        odd = {i for i in range(n) if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)}
        self.id_of = {named[i]: i for i in range(n) if i not in odd}
        scores = sorted({lib.get_score(i) for i in self.id_of.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.rank = {p: place[lib.get_score(i)] for p, i in self.id_of.items()}
        if len(self.bytes_of) < 256 or any(BREAK in p for p in self.id_of) or lib.encode(f"{BREAK} ÅÅ {BREAK}") != lib.encode(f"{BREAK} ÅÅ {BREAK}".replace(" ", BLANK)) or lib.decode(lib.encode("  a  Åﬁ ")) != "  a  Åﬁ ":
            raise ValueError("only BPE models with byte fallback and without text rules are read")
        self.table = [b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else bytes([int(named[i][3:5], 16)]) if lib.is_byte(i) else named[i].replace(BLANK, " ").encode() for i in range(n)]
        self.plain = ~np.array([i in odd for i in range(n)])
        self.control = np.array([lib.is_control(i) for i in range(n)])
        self.text = named

        # Parts: the last merge of each piece. A piece that its own merges don't give never occurs.
        self.parts: dict[int, tuple[str, str]] = {}
        for p, i in list(self.id_of.items()):
            if len(p) > 1:
                made, last = self.merge(list(p))
                if made != [p]:
                    self.rank.pop(p), self.id_of.pop(p)
                else:
                    self.parts[i] = last
        self.right, self.left = {}, {}
        for p, i in self.id_of.items():
            self.right[i], self.left[i] = self.spine(p, 1), self.spine(p, 0)
        if any(len(x) > 1 and self.rank[x] > self.rank[p] for p, i in self.id_of.items() for x in self.parts.get(i, ())):
            raise ValueError("a piece ranks before the parts that it is made of")
        self.tied = {r for r, n in itertools.groupby(sorted(self.rank.values())) if len(list(n)) > 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.verdict: dict[int, bool] = {}

    def merge(self, symbols: list[str]) -> tuple[list[str], tuple[str, str]]:
        """Merges of the best rank first, the leftmost of equals, and the parts of the last one."""
        last = ("", "")
        while len(symbols) > 1:
            best, at = min((self.rank.get(symbols[i] + symbols[i + 1], NEVER), i) for i in range(len(symbols) - 1))
            if best == NEVER:
                break
            last = (symbols[at], symbols[at + 1])
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols, last

    def spine(self, piece: str, side: int) -> list[tuple[str, int]]:
        """What stands at the right (1) or left (0) end of a piece while it is made, each with the rank
        of the merge that ends it."""
        out, until = [(piece, NEVER)], NEVER
        while len(piece) > 1:
            until = self.rank[piece]
            piece = self.parts[self.id_of[piece]][side]
            out.append((piece, until))
        return out

    def together(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no merge across their border comes before the merges
        that end its two sides. Of equal ranks the left one comes first. Pieces of one rank (runs of
        blanks) say too little, so their merges are carried out."""
        p, t = self.text[a], self.text[b]
        if self.rank[p] in self.tied and not t.strip(p[0]) or self.rank[t] in self.tied and not p.strip(t[0]):
            return self.merge(list(p + t))[0] == [p, t]
        for x, up in self.right[a]:
            for y, on in self.left[b]:
                r = self.rank.get(x + y, NEVER)
                if r < up and r <= on and r < NEVER:
                    return False
        return True

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix of ``text`` its last token, -1 at breaks and after characters without a piece."""
        last = [-1] * (len(text) + 1)
        if len(self.verdict) > KEPT_PAIRS:
            self.verdict.clear()
        known = self.verdict
        for end, (token, size) in self.automaton.iter(text):
            before = last[end + 1 - size]
            if before >= 0:
                pair = before << 32 | token
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = self.together(before, token)
                if not fits:
                    continue
            last[end + 1] = token
        return last


@functools.cache
def model(path: str) -> Model:
    return Model(path)


class Encoder(bpe.Encoder):
    """Ids of whole texts; one per Python worker."""

    def __init__(self, path: str):
        self.model = model(path)
        self.table, self.special = self.model.table, {}
        self.size_of = [len(p) for p in self.model.text]
        pieces = [p for p in self.model.id_of if len(p) > 1]
        self.index = np.zeros(sys.maxunicode + 1, np.uint16)
        inside = sorted({c for p in pieces for c in p})
        self.index[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.joined = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        a, b = zip(*{(ord(x), ord(y)) for p in pieces for x, y in itertools.pairwise(p)}, strict=True)
        self.joined[self.index[list(a)], self.index[list(b)]] = True
        self.words_of_ids = [str(i).encode() for i in range(len(self.table))]
        self.start()

    def split(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of the stretches: wherever no piece holds the two characters in a row."""
        at = self.index[points]
        start = np.ones(len(points), bool)
        start[1:] = ~self.joined[at[:-1], at[1:]]
        start[ends] = True
        return np.flatnonzero(start)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found: list[int] = []
        count = np.empty(len(words), np.int32)
        for i in range(0, len(words), bpe.WORDS):
            group = words[i : i + bpe.WORDS]
            text = BREAK.join(group)
            last = self.model.last_tokens(text)
            end = 0
            for j, word in enumerate(group, i):
                start, end = end, end + len(word)
                here: list[int] = []
                at = end
                while at > start:
                    token = last[at]
                    if token >= 0:
                        here.append(token)
                        at -= self.size_of[token]
                    else:
                        here += [self.model.bytes_of[x] for x in reversed(text[at - 1].encode())]
                        at -= 1
                here.reverse()
                found += here
                count[j] = len(here)
                end += len(BREAK)
        first = self.ids.add(np.array(found, np.uint32))
        return (first + np.cumsum(count) - count).astype(np.int32), count

    def each(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        return super().each([BLANK + t.replace(" ", BLANK) if t else "" for t in texts])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode gives it: the first blank of the text goes, and a
        byte that is no character becomes U+FFFD."""
        control = self.model.control[ids]
        if control.any():  # they end runs of bytes, and leave nothing themselves
            parts = [ids[~control][:1], *np.split(ids, np.flatnonzero(control))]
            text = "".join(b"".join(map(self.table.__getitem__, x.tolist())).decode("utf-8", "tessera-each") for x in parts[1:])
            ids = parts[0]
        else:
            text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "tessera-each")
        return text[1:] if len(ids) and self.model.plain[ids[0]] and text[:1] == " " else text

    def decimal(self, ids: np.ndarray) -> bytes:
        return b",".join(map(self.words_of_ids.__getitem__, ids.tolist()))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array of int). ``path`` is a ``.model`` file, readable on every worker."""
    df = bpe._without(df, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in byte_slices(batches, text):
            found = list(enc.each(batch.column(batch.schema.get_field_index(text)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], names=[*batch.schema.names, ids])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (string): the text of the ids; null ids give an empty text."""
    df = bpe._without(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = [enc.decode(np.array(r or [], np.int64)) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)]))


def digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text and keeps counts and SHA-256 digests; ids stay inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in byte_slices(batches, text):
            out: list[list] = [[], [], []]
            for ids in enc.each(batch.column(1).to_pylist()):
                found = (len(ids), hashlib.sha256(enc.decimal(ids)).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                for held, value in zip(out, found, strict=True):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias(text))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
