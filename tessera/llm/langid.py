"""Language identification in two steps: family first, then the languages inside it.

Texts become frequencies of hashed byte n-grams (one to three bytes of the lower-cased text, other
than letters read as blanks) over the whole text. Linear support vector machines, one against one,
first separate families, then the languages of the chosen family; votes decide, then margins. They
are trained on the driver on at most ``per_lang`` documents of each language and ``most`` in all
(bounds of the sample; by the order of a hash of the id, first within salted parts of a language, so
that no language is one task), never on held-out rows. Frequencies reach the driver as pairs of place
and value, and the one matrix there has ``most`` x ``DIMS`` floats at most.

Defined results: a null text or one without a letter is ``und`` with score 0; if nothing can be
learned all are ``und``; null or repeated ids and rows are rows like others; other columns and lang,
source and doc_id are never inputs of a prediction; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import byte_slices, held_out

DIMS = 1 << 13
PER_LANG, MOST, SALTS = 400, 8000, 16
#: Families of languages by code; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky".split(),
    "indo-aryan": "hi bn mr ne pa gu ur".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_KEEP = bytes(b if 97 <= b < 123 or b > 127 else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Mean occurrences of each hashed n-gram, times 100."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_KEEP) + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] * np.uint32(0x9E3779B1)) ^ (b[1:] * np.uint32(0x85EBCA77))
    three = (two[:-1] ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    places = np.concatenate([b, 256 + (two * np.uint32(0x165667B1) >> np.uint32(21)), 256 + 2048 + (three >> np.uint32(19)) % np.uint32(DIMS - 2304)])
    return np.bincount(places, minlength=DIMS).astype(np.float32) * np.float32(100.0 / len(b))


def sparse(found: np.ndarray) -> bytes:
    """Places (16 bits) and values (32 bits) of what isn't 0."""
    at = np.flatnonzero(found)
    return at.astype("<u2").tobytes() + found[at].astype("<f4").tobytes()


def dense(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMS), np.float32)
    for i, raw in enumerate(rows):
        n = len(raw) // 6
        out[i, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return out


def svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, c: float = 1.0, turns: int = 30) -> np.ndarray:
    """Weights (bias last) of a linear SVM on the given rows of ``x`` by dual coordinate descent:
    half the squared weights, bias included, plus ``c`` times the hinge losses."""
    rows = np.arange(len(x)) if rows is None else rows
    w, a, q = np.zeros(x.shape[1] + 1, np.float32), np.zeros(len(rows)), [float(x[r] @ x[r]) + 1.0 for r in rows]
    rng = np.random.default_rng(0)
    for _ in range(turns):
        for i in rng.permutation(len(rows)):
            own = x[rows[i]]
            new = min(max(a[i] - (y[i] * float(own @ w[:-1] + w[-1]) - 1) / q[i], 0.0), c)
            if new != a[i]:
                step = np.float32((new - a[i]) * y[i])
                w[:-1] += step * own
                w[-1] += step
                a[i] = new
    return w


def train(x: np.ndarray, labels: list[str]) -> dict:
    """One-against-one machines of families and, per family, of languages."""
    lang = np.array(labels)
    family = np.array([FAMILY_OF.get(v, v) for v in labels])

    def pairs(of: np.ndarray, rows: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
        out = []
        for a, b in itertools.combinations(sorted(set(of[rows])), 2):
            both = np.flatnonzero(rows & ((of == a) | (of == b)))
            out.append((a, b, svm(x, np.where(of[both] == a, 1.0, -1.0), both)))
        return out

    every = np.ones(len(lang), bool)
    names = sorted(set(family))
    return {"families": (names, pairs(family, every)), "languages": {f: (sorted(set(lang[family == f])), pairs(lang, family == f)) for f in names}}


def vote(x: np.ndarray, names: list[str], machines: list) -> tuple[str, float]:
    """Winner by votes, then margins, and a confidence from its smallest margin."""
    if len(names) == 1:
        return names[0], 1.0
    votes, margins = dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
    for a, b, w in machines:
        m = float(x @ w[:-1] + w[-1])
        votes[a if m >= 0 else b] += 1
        margins[a], margins[b] = min(margins[a], m), min(margins[b], -m)
    best = max(names, key=lambda n: (votes[n], margins[n]))
    return best, float(1 / (1 + np.exp(-3 * np.clip(margins[best], -10, 10))))


def predict(model: dict, text: str | None) -> tuple[str, float]:
    if not text or not model or not any(map(str.isalpha, text)):
        return "und", 0.0
    x = features(text)
    family, p = vote(x, *model["families"])
    lang, q = vote(x, *model["languages"][family])
    return lang, p * q


def sample(docs: DataFrame, per_lang: int = PER_LANG, most: int = MOST) -> DataFrame:
    """doc_id, lang and frequencies of at most ``most`` training documents; a repeated id counts once."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    ids = rows.select("doc_id", "lang").distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SALTS * SALTS)))
    for keys in (["lang", "salt"], ["lang", F.pmod("salt", F.lit(SALTS))], ["lang"]):  # each step reads a bounded number of rows a group
        first = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_lang)
    ids = ids.orderBy("rank", "lang").limit(most).select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            found = [sparse(features(t)) if t and any(map(str.isalpha, t)) else None for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "lang", "x"])

    chosen = rows.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, lang string, x binary").where("x IS NOT NULL")
    return chosen.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).orderBy("doc_id", "lang").limit(most)


def identify(docs: DataFrame, per_lang: int = PER_LANG, most: int = MOST) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    got = sample(docs, per_lang, most).toArrow()
    model = train(dense(got["x"].to_pylist()), got["lang"].to_pylist()) if len(got) else {}
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most pairs of languages x DIMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            found = [predict(held.value, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
