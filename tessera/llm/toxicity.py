"""Toxicity: gradient-boosted trees over dense features of the whole text, calibrated by isotonic
regression.

Features: densities of a seed lexicon and of a learned one, insults near a second-person word,
rates of capitals, of exclamation and other punctuation, of obfuscated words (letters mixed with
digits or symbols) and of stretched letters, and how many lexicon words occur and how many different
ones. The learned lexicon holds the words
that stand out in toxic training documents by their log-likelihood ratio. Lexicon, trees and
calibration learn from at most ``per_class`` labelled documents of each class (a bound of the
sample; by the order of a hash of the id), never from held-out rows; the calibration uses a fifth
of the sample that the trees did not see.

Defined results: a null or empty text has all features 0 and is scored like any other; without
labels of both classes every score is 0; rows with a null id are rows like others; conflicting
labels of one id count as toxic; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import byte_slices, held_out, materialize

PER_CLASS = 4000
LEXICON = 100
#: Common insults and second-person words.
SEEDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless clown clowns fool fools hate disgusting ugly imbecile jerk creep coward liar filth vermin garbage".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tú tus".split())
WORD = re.compile(r"[^\s.,;:()\"«»]+")
MIXED = re.compile(r"[a-z]+[0-9@$*!|]+[a-z]+")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
PLAIN = str.maketrans("013457@$!|", "oieastasil")
N_FEATURES = 10


def features(text: str | None, lexicon: frozenset) -> list[float]:
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    seed = learned = near = mixed = 0
    hits = []
    counts = Counter(words)
    known = [w for w in counts if (b := w.strip("!?*'-")) in SEEDS or b in lexicon]
    odd = [w for w in counts if MIXED.search(w)]
    for w in known:
        b = w.strip("!?*'-")
        seed += counts[w] * (b in SEEDS)
        learned += counts[w] * (b in lexicon)
    for w in odd:
        mixed += counts[w]
        if w.translate(PLAIN) in SEEDS or w.translate(PLAIN) in lexicon:
            seed += counts[w]
    if known:
        marked = set(known)
        hits = [i for i, w in enumerate(words) if w in marked]
        near = sum(any(x in SECOND for x in words[max(0, i - 3) : i + 4]) for i in hits)
    size = len(text)
    capitals = sum(map(str.isupper, text)) / size if not low == text else 0.0
    return [
        100 * seed / n, 100 * learned / n, float(np.log1p(len(hits))), 100 * near / n, len({w.strip("!?*'-") for w in known}),
        capitals, (text.count("!") + text.count("?")) / size, sum(text.count(c) for c in "#*$%&|<>") / size, 100 * mixed / n, 100 * len(STRETCHED.findall(low)) / n,
    ]


class Trees:
    """Boosted trees of fixed depth on binned features, logistic loss, Newton steps."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, cuts = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                width = 1 << level
                best = [(0.0, 0, self.bins)] * width
                for j in range(x.shape[1]):
                    at = node * (self.bins + 1) + binned[:, j]
                    gs = np.bincount(at, g, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(at, h, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least / 4) | (ht - hs < self.least / 4)] = 0
                    for k in range(width):
                        b = int(gain[k].argmax())
                        if gain[k, b] > best[k][0] + 1e-9:
                            best[k] = (float(gain[k, b]), j, b)
                feature, cut = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                cuts.append((feature, cut))
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            size = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + 1)
            self.trees.append((cuts, leaf))
            f += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for cuts, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in cuts:
                node = 2 * node + (binned[rows, feature[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of each step of the best rising fit (pool adjacent violators): scores are level on a
    step and interpolated between steps. Equal margins are pooled first."""
    at, where = np.unique(margin, return_inverse=True)
    blocks: list[list[float]] = []
    for m, v, n in zip(at, np.bincount(where, y), np.bincount(where), strict=True):
        blocks.append([m, m, v, n])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, end, v2, n2 = blocks.pop()
            start, _, v1, n1 = blocks[-1]
            blocks[-1] = [start, end, v1 + v2, n1 + n2]
    # part of a case of each kind keeps the ends off 0 and 1
    level = [(b[2] + 0.02) / (b[3] + 0.04) for b in blocks]
    return np.array([x for b in blocks for x in b[:2]]), np.repeat(np.maximum.accumulate(level), 2)


def learned_words(chosen: DataFrame, most: int = LEXICON) -> list[str]:
    """The words that stand out in toxic rows of ``chosen`` (doc_id, text, toxic, fold) outside the
    calibration fold, by document frequency; at most ``most`` words reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update({w.strip("!?*'-") for w in WORD.findall((text or "").lower())})
            words = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], names=["word", "c1", "c0"])

    rows = chosen.where("NOT fold")
    n1, n0 = (max(1, n or 0) for n in rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    words = rows.select("text", "toxic").mapInArrow(run, "word string, c1 long, c0 long").groupBy("word").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    ratio = (F.col("c1") / n1) / ((F.col("c0") + 0.5) / n0)
    stands_out = (F.col("word") != "") & (F.col("c1") >= max(3, n1 // 100)) & (ratio > 4)
    return [r.word for r in words.where(stands_out).orderBy((F.col("c1") * F.log(ratio)).desc(), "word").limit(most).collect()]


def train(docs: DataFrame, ids: DataFrame) -> dict | None:
    """The model learned from the rows of ``docs`` whose id is in ``ids`` (doc_id, toxic), a bounded
    sample. Texts stay in the tasks; words and ten numbers a document reach the driver."""
    held = F.broadcast(ids.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 4))
    chosen = docs.select("doc_id", "text").join(held, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("long").alias("toxic"), "fold")
    lexicon = frozenset(learned_words(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            x = [features(t, lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    # rows that repeat an id count once, so the bound on ids bounds the rows
    got = chosen.mapInArrow(run, "doc_id long, toxic long, fold boolean, x array<double>").groupBy("doc_id", "toxic", "fold").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    x, y, fold = np.array([r.x for r in got]), np.array([float(r.toxic) for r in got]), np.array([r.fold for r in got], bool)
    if len(set(y[~fold].tolist())) < 2:
        return None
    trees = Trees().fit(x[~fold], y[~fold])
    steps = isotonic(trees.margin(x[fold]), y[fold]) if len(set(y[fold].tolist())) == 2 else (np.array([-4.0, 4.0]), np.array([0.02, 0.98]))
    return {"lexicon": lexicon, "trees": trees, "steps": steps}


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    pick = lambda v: known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, materialize(pick(0).union(pick(1)), "labelled")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in byte_slices(batches, "text"):
            texts = batch.column(2).to_pylist()
            if m is None:
                p = np.zeros(len(texts))
            else:
                p = np.interp(m["trees"].margin(np.array([features(t, m["lexicon"]) for t in texts])), *m["steps"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
