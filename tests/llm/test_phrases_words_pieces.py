"""Collocations, spelling variants and SentencePiece against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from tessera.llm import phrases, pieces, queries, spelling
from tessera.llm.shared import materialize

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, n long, word string, key string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """(doc_id, text, lang) rows, with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)


def brute_phrases(rows, support):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    return {g: {p: c for p, c in held.items() if c >= support} for g, held in f.items()}, n


def brute_collocations(rows, support, percent, top):
    f, n = brute_phrases(rows, support)
    out = set()
    for lang, held in f.items():
        inside = [(p, c) for p, c in held.items() if len(p) > 2]
        found = []
        for p, a in held.items():
            holds = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if len(p) < 2 or any(len(q) > len(p) and 100 * c >= percent * a and holds(q) for q, c in inside):
                continue
            score, _, cut = min((1000 * a * n[lang] // (held[p[:k]] * held[p[k:]]), k, k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), held[p[:cut]], held[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    common, rare = ["the", "of", "é日", "a|b", "A", "New"], [f"w{i}" for i in range(300)]
    rows = []
    for i in range(240):
        words = [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randrange(60))]
        for phrase in ("New York City Hall park", "state of the art", "x x x x x x x"):
            if rng.random() < 0.5:
                words[rng.randrange(len(words) + 1) :] = phrase.split(" ")
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\x0b"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "fr", None])))
    return [*rows, (500, None, "en"), (501, "", "fr"), (502, " . ,", "de"), (None, "the of the of", "und"), *[(7, "same row again and again", "en")] * 12, (503, "tail of the art " * 40_000, "xx")]


def test_collocations(spark, prose):
    for rows, parts in ((prose, 13), (prose, 1), (prose[:60], 40)):
        data = docs(spark, rows).repartition(parts)
        for support, percent, top in ((6, 100, 2000), (20, 80, 7)):
            got = phrases.collocations(data, support, percent, top).collect()
            assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_collocations(rows, support, percent, top)


def test_collocations_of_shards_lose_no_phrase(spark, prose):
    """A phrase that stands in one shard only, and one dealt evenly; counts are exact with a table full of clashes."""
    rows = [r for r in prose if r[0] is not None and r[0] < 240] + [(1000 + i, f"spread phrase {i} . {'packed phrase here . ' * (40 * (i == 3))}", "en") for i in range(40)]
    want, _ = brute_phrases(rows, 40)
    old = phrases.BITS
    try:
        for bits in (old, 12):
            phrases.BITS = bits
            found, _ = phrases.frequent_phrases(docs(spark, rows).repartition(16, "doc_id"), 40)
            assert {(r.lang, r.phrase, r.f) for r in found.collect()} == {(g, " ".join(p), c) for g, held in want.items() for p, c in held.items()}
    finally:
        phrases.BITS = old


def test_last_count_adds_up_blocks_of_a_task(spark, monkeypatch):
    """Rows of the last count follow tasks and phrases, not blocks; what a task can't hold it hands on, and nothing is lost."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(6)}" for _ in range(500)), rng.choice(["en", "fr"])) for i in range(800)]
    want = {(g, " ".join(p)): c for g, held in brute_phrases(rows, 1)[0].items() for p, c in held.items() if len(p) > 1}
    every = spark.sparkContext.broadcast(b"\xff" * 512)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 1000)
    cut = phrases.materialize(phrases.blocks(docs(spark, rows).repartition(16)), "blocks")
    assert cut.count() >= 400
    made = []
    for most in (phrases.COUNT_BYTES, 1):
        monkeypatch.setattr(phrases, "COUNT_BYTES", most)
        found, got = phrases._counted(cut, every).collect(), Counter()
        for r in found:
            assert r.k == r.phrase.count(" ") + 1
            got[r.lang, r.phrase] += r.n
        assert got == want
        made.append(len(found))
    assert made[0] <= spark.sparkContext.defaultParallelism * len(want) and made[0] < made[1]


def test_a_group_of_blocks_is_read_at_once_not_a_file(spark, monkeypatch, prose):
    """However many blocks a task writes, a reader holds a few: row groups follow bytes, from the first row on."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(phrases, "GROUP_BYTES", 40_000, raising=False)
    written = []
    monkeypatch.setattr(phrases, "materialize", lambda df, *a: written.append((a[0], made := materialize(df, *a))) or made)
    rows = prose[:240] * 3
    got = {(r.lang, r.phrase, r.f) for r in phrases.frequent_phrases(docs(spark, rows).repartition(1), 20)[0].collect()}
    assert got == {(g, " ".join(p), c) for g, held in brute_phrases(rows, 20)[0].items() for p, c in held.items()}
    files = [x.removeprefix("file://") for x in dict(written)["blocks"].inputFiles()]
    groups = [m.row_group(i) for m in (pq.ParquetFile(x).metadata for x in files) for i in range(m.num_row_groups)]
    assert len(files) == 1 and sum(g.num_rows for g in groups) > 50 and max(g.total_byte_size for g in groups) < 80_000


def test_frequent_phrases_are_not_broadcast(spark):
    """Only the words of each language are: one row a language."""
    top = phrases.collocations(docs(spark, [(1, "a b c a b . " * 30, "en")]), 20)
    assert {tuple(r) for r in top.collect()} == brute_collocations([(1, "a b c a b . " * 30, "en")], 20, 100, 2000)
    plan = top._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") == 3 and plan.count("BroadcastHashJoin") == 1


def test_collocations_beyond_64_bits_and_of_nothing(spark):
    assert phrases.collocations(docs(spark, [(1, None, None), (2, " .\n", "en")])).count() == 0
    assert phrases.collocations(docs(spark, [(1, "a b", "en")]).limit(0)).count() == 0
    rows = spark.sql("select cast(9e15 as long) a, cast(9e16 as long) n, cast(9e15 as long) l, cast(9e15 as long) r")
    assert rows.selectExpr("cast((cast(a as decimal(38,0)) * n * 1000) div (cast(l as decimal(38,0)) * r) as long) s").first().s == 1000 * 9 * 10**15 * 9 * 10**16 // (9 * 10**15) ** 2


def test_blocks_number_words_and_pieces():
    words, codes = phrases._numbered(["B a\tb;;B", "", "b", "\x0c é É.\n"])
    names = [None, *words.to_pylist()]
    assert [names[c] for c in codes] == ["b", "a", "b", None, "b", None, "b", None, "é", "É"]
    assert [len(x) for x in phrases._numbered([""])] == [0, 0]


def brute_variants(rows, least=7, occurrences=2, times=10, every=31):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= occurrences}
    near = {a: [b for b in n if a != b and abs(len(a) - len(b)) <= 1 and one_edit(a, b)] for a in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_spelling_variants(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé×ÿ") for _ in range(rng.randrange(5, 30))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    words = []
    for b in base:
        words += [b] * rng.choice([1, 2, 30, 400])
        for _ in range(6):
            at, c = rng.randrange(len(b) + 1), rng.choice("abÀ")
            v = rng.choice([b[:at] + c + b[at:], b[:at] + b[at + 1 :], b[:at] + c + b[at + 1 :]])
            words += [v] * rng.choice([1, 2, 3, 25])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 9 : i * 9 + 9]).replace("b", rng.choice("bB"))) for i in range(len(words) // 9 + 1)]
    rows += [(None, "solitaire solitaire"), (9, None), (10, ""), (11, "zz9zz abcdefg" * 3), *[(12, "repeated rows count")] * 3, (13, "q" * 50_000 + " " + "longlong " * 60_000)]
    data = docs(spark, [(*r, "en") for r in rows]).repartition(7)
    want = brute_variants(rows)
    got = spelling.group(data).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and sum(r.form is not None for r in got) > 20
    assert any(r.form is not None and r.root != r.form for r in got)
    assert {tuple(r) for r in spelling.group(data, least=3, occurrences=1, times=2, every=5).collect()} == brute_variants(rows, 3, 1, 2, 5)
    assert spelling.group(data.limit(0)).count() == 0 and spelling.group(docs(spark, [(1, None, None)])).count() == 0


def test_each_depth_of_chunks_gives_all_pairs(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7, 13))) for _ in range(400)})
    counted = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = {frozenset((a, b)) for a in words for b in words if a < b and abs(len(a) - len(b)) <= 1 and one_edit(a, b)}
    for depth in (1, 2, 3):
        got = spelling.near_pairs(counted, depth).collect()
        assert len(got) == len(want) and {frozenset((r.a, r.b)) for r in got} == want


def test_words_are_not_broadcast(spark):
    """Keys are many a word, and Spark doesn't know it: however small words look, none pass through the driver."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    counted = spark.createDataFrame([("spelling", 40), ("speling", 3), ("another", 2)], "word string, n long")
    pairs = spelling.near_pairs(counted)
    assert [tuple(r) for r in pairs.collect()] == [("speling", 3, "spelling", 40)] and "Broadcast" not in plan(pairs)
    found = spelling.group(docs(spark, [(1, "spelling " * 40 + "speling " * 3 + "another another", "en")]), every=10**12)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}
    assert got == {"spelling": (None, "spelling", 40, 1, None), "speling": ("spelling", "spelling", 3, 1, 40), "another": (None, "another", 2, 0, None)}
    assert "Broadcast" not in plan(found)


def test_spelling_query_equals_brute_force(spark):
    """Counts by hand; near words by joining what is left after one deletion."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.word: r for r in queries.op12_spelling_variants(spark, SF).collect()}
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{doc}:{w}".encode())
            n[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    assert {w: r.n for w, r in got.items()} == {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    less, near = defaultdict(set), {w: set() for w in got}
    for w in got:
        for i in range(len(w)):
            less[i, w[:i] + w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in got:
                near[w].add(x), near[x].add(w)
    for same in less.values():
        for w in same:
            near[w] |= same - {w}
    for w, r in got.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        assert (r.form, r.n_near, r.form_n) == (form, len(near[w]), n[form] if form else None)
        assert r.root == (got[form].root if form else w)


@pytest.fixture(scope="module")
def model():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_pieces_equal_the_library(model, library):
    rng = random.Random(1)
    bits = ["a", "b", "the", " ", "  ", "   ", "▁", "\n", "\t", "é", "日本", "Å", "ﬁ", "1", "23", "\U0001f600", "\x00", "ing", "tion", ".", ",", "<0x0A>", "<s>", "ß", "\r", "  " * 9, "ab" * 5, "　"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [" " * k + "x" + " " * (40 - k) for k in range(40)] + ["▁" * k for k in range(40)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1000), rng.randrange(0x3000, 0xA000)])) for _ in range(rng.randrange(50))) for _ in range(1000)]
    texts += ["ab" * 40_000, "日本語" * 9_000, " " * 5_000, "a" * 60_001]
    enc = pieces.encoder(model)
    for text, ids in zip(texts, enc.each(texts), strict=True):
        assert ids.tolist() == library.encode(text) and enc.decode(ids) == library.decode(ids.tolist())
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32_000), 259, 260, 28705, 0, 1, 2]) for _ in range(rng.randrange(9))]
        assert enc.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_each_prefix_ends_in_its_token(model, library):
    held = pieces.model(model)
    for text in ("▁the▁internationalization", "▁▁▁▁x", "▁aaaaaaaaa", "▁日本éa"):
        last = held.last_tokens(text)
        for end in range(1, len(text) + 1):
            ids = library.encode(text[1:end].replace("▁", " ")) if end > 1 else [held.id_of["▁"]]
            assert last[end] == (ids[-1] if not library.is_byte(ids[-1]) else -1)


def test_pieces_of_rows(spark, model, library):
    rows = [(1, None, "en"), (2, "", "en"), (3, "a  b\n", None), (None, "no id", "en"), (3, "a  b\n", None), (4, "long words " * 30_000, "en")]
    data = docs(spark, rows)
    got = pieces.decode(pieces.encode(data, model, ids="key"), model, ids="key", out="word").collect()
    assert sorted(map(str, data.columns)) == sorted(got[0].__fields__) and len(got) == len(rows)
    for r in got:
        assert list(r.key) == library.encode(r.text or "") and r.word == (r.text or "")
    assert pieces.encode(data.limit(0), model).count() == pieces.digests(data.limit(0), model).count() == 0


def test_pieces_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
