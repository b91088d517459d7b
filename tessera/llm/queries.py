"""Registered queries of the pipeline operators: name -> query(spark, sf_dir), and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, html, langid, minhash, packing, phrases, pieces, quality, secrets, spelling, suffix, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_read(spark, sf_dir, "documents"), path)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


OP8_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op4_packing": op4_packing, "op8_exact_topk": op8_exact_topk, "op9_byte_bpe": op9_byte_bpe}
ORACLES = {"op8_exact_topk": OP8_SQL}


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(_read(spark, sf_dir, "documents"), width=4, percent=80)


#: Exact links on full sets, found through shared shingles; components by a recursive closure.
OP10_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents WHERE doc_id IS NOT NULL),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
    FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS met FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * met >= 80 * (na + nb - met)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT two.b, reach.r FROM reach JOIN two ON reach.v = two.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(reach.r) AS component_id, min(reach.r) = s.doc_id AS kept
FROM s JOIN reach ON reach.v = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
QUERIES["op10_minhash"] = op10_minhash
ORACLES["op10_minhash"] = OP10_SQL


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(_read(spark, sf_dir, "documents"), length=100)


QUERIES["op1_suffix_dedup"] = op1_suffix_dedup


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_read(spark, sf_dir, "documents")))


QUERIES["op5_quality_rules"] = op5_quality_rules
QUERIES["op6_secret_scan"] = op6_secret_scan


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


QUERIES |= {"op2_toxicity": op2_toxicity, "op3_html_layout": op3_html_layout, "op7_language_id": op7_language_id}


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"), support=100, percent=100, top=2000)


#: Counts all phrases of all lengths, without shards.
OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
    FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (
    SELECT lang, phrase, max(f) AS f
    FROM (SELECT lang, f, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 : k], ' ')]) AS phrase FROM c WHERE k > 2) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside i USING (lang, phrase) WHERE i.f IS NULL OR 100 * i.f < 100 * c.f),
cuts AS (
    SELECT lang, phrase, f AS a, cut, array_to_string(w[1 : cut], ' ') AS a1, array_to_string(w[cut + 1 : k], ' ') AS a2
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
    SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n.n, cut, 1000 * CAST(a AS HUGEINT) * CAST(n.n AS HUGEINT) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = a1 JOIN f y ON y.lang = cuts.lang AND y.phrase = a2 JOIN n ON n.lang = cuts.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(_read(spark, sf_dir, "documents"), least=7, occurrences=2, times=10, every=31)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES |= {"op11_collocations": op11_collocations, "op12_spelling_variants": op12_spelling_variants, "op13_sentencepiece": op13_sentencepiece}
ORACLES["op11_collocations"] = OP11_SQL
