"""Bounded memory and exactness on long texts, repeated rows and null ids."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from reasonflow.llm import components, fingerprints, langid, media, neardup, packing, quality, secrets, sentencepieces, substring, tokenbin
from reasonflow.llm.kernels import STEP_BYTES, hash_words, utf8
from reasonflow.llm.tokens import PieceEncoder

DOCS = "doc_id long, text string, lang string"


def test_dictionary_sample_is_bounded_and_has_long_texts(spark):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"))
    assert tokenbin.dictionary_sample(copies, 100, 50).count() == 100
    long = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("a" * 50), F.lit("b" * 50), F.lit("c" * 7)).alias("text"))
    got = [r.text for r in tokenbin.dictionary_sample(long, 100, 50).collect()]
    assert len(got) == 20 and set(got) <= {"a" * 50, "b" * 50, "c" * 7} and len(set(got)) > 1
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3000)), lambda i: F.concat(F.lit("w"), (i * F.col("id") % 97).cast("string"))), " ")
    texts = spark.range(80).select(F.col("id").alias("doc_id"), words.alias("text"))
    assert texts.where("length(text) <= 8192").where("doc_id > 0").isEmpty()
    assert tokenbin.train_dictionary(texts, P.path("byte_bpe_50k.json"), 2, longest=8192)


def test_more_pieces_than_the_table_holds():
    own, texts = PieceEncoder(P.path("byte_bpe_50k.json"), bits=8), [" ".join(f"w{i}x{i}" for i in range(300)), "w1x1 w2 end", ""]
    for some in (texts, texts[::-1], texts[1:]):
        ids, at = own.encode(some, 2)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*own.tokenizer.encode(x, add_special_tokens=False).ids, 2] for x in some]


def test_long_texts_repeated_rows_and_null_ids(spark):
    """One text of more than a step, rows that come twice, ids that are null: all operators give each row its result."""
    from tokenizers import Tokenizer

    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(vocab, k=200_000))
    assert len(long) > STEP_BYTES
    short = " ".join(rng.choices(vocab, k=70))
    rows = [(1, long, "aa"), (2, long + " end", "aa"), (3, short, "aa"), (3, short, "aa"), (None, short, "bb"), (None, short, "bb"), (4, None, None), (None, None, None), (5, "", "aa")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).cache()
    key = lambda i: -1 if i is None else i
    ids = sorted(key(i) for i, _, _ in rows)

    got = sorted((key(r.doc_id), r.n_words, r.n_removed) for r in substring.substring_digests(docs).collect())
    assert got == sorted((key(i), len((t or "").split()), 200_000 if i == 2 else 0) for i, t, _ in rows)

    for path, end, run in (("word_bpe_49k.json", 1, lambda p: tokenbin.token_binary(docs, p, 1)), ("byte_bpe_50k.json", 2, lambda p: packing.pack_documents(docs, p, 2))):
        t = Tokenizer.from_file(P.path(path))
        want = sorted((key(i), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x, _ in rows)
        found = run(P.path(path)).collect()
        if end == 1:
            assert sorted((key(r.doc_id), r.n_tokens) for r in found) == want
        else:
            total: dict[int, int] = {}
            for r in found:
                total[key(r.doc_id)] = total.get(key(r.doc_id), 0) + r.length
            assert total == {i: sum(n for j, n in want if i == j) for i in ids}

    for found, columns in (
        (secrets.secret_report(docs), ["n_assign", "spans"]),
        (quality.quality(docs, spark.createDataFrame([(1, 1), (3, 0), (3, 0), (None, 1)], "doc_id long, label int")), ["score"]),
        (sentencepieces.encode_and_decode(docs, P.path("piece_bpe_32k.model")), ["n_ids", "ids_crc32", "decoded_sha256"]),
        (media.media_columns(docs), ["payload_sha256", "media_sha256", "feature"]),
        (fingerprints.edited_fingerprints(docs), ["n_chars", "fingerprint"]),
        (langid.identify(docs), ["lang_pred", "score"]),
    ):
        some = found.collect()
        assert sorted(key(r.doc_id) for r in some) == ids
        for group in ([r for r in some if r.doc_id == 3], [r for r in some if r.doc_id in (4, 5)]):
            assert len({tuple(r[c] for c in columns) for r in group}) == 1
    sp = sentencepieces.encoder(P.path("piece_bpe_32k.model"))
    import sentencepiece

    assert sp._encode([long])[0] == sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(long)

    got = sorted((key(r.doc_id), key(r.component_id)) for r in neardup.near_duplicates(docs, 3, 85).collect())
    assert got == sorted((key(i), 1 if i == 2 else key(i)) for i, _, _ in rows)


def test_pieces_equal_the_library_on_random_strings():
    import sentencepiece

    rng = random.Random(4)
    signs = "aaaabbbcdeeefghiilmnoorssttuu ABC.,!?-'0123456789éßñ日本語привет🙂\n"
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 80))) for _ in range(1500)] + ["a" * k for k in range(1, 90)] + ["ha" * k for k in range(1, 60)] + ["=" * k for k in range(1, 90)]
    enc, sp = sentencepieces.SentencePieceEncoder(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids, at = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == sp.encode(texts)


def test_spans_apart_and_redaction_by_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        at, c = 0, []
        for _ in range(rng.randint(0, 5)):
            a = at + rng.randint(0, 4)
            at = a + rng.randint(1, 4)
            c.append((a, 3, at, "t"))
        rows.append((i, c, sorted((a := rng.randint(0, 20), rng.randint(0, 2), a + rng.randint(1, 6)) for _ in range(rng.randint(0, 4)))))
    df = spark.createDataFrame(rows, "i int, c array<struct<s:int,kind:int,e:int,t:string>>, b array<struct<s:int,kind:int,e:int>>")
    for r in df.select("*", secrets.apart(F.col("c"), F.col("b")).alias("o")).collect():
        assert r.o == [x for x in r.c if not any(b.s < x.e and x.s < b.e for b in r.b)]
    texts = []
    kinds = [lambda: "password: " + "".join(rng.choices("abc123é", k=rng.randint(4, 9))), lambda: "token='" + "".join(rng.choices("0123456789abcdef", k=rng.randint(20, 50))), lambda: "AKIA" + "".join(rng.choices("ABC123", k=rng.randint(10, 22))), lambda: "".join(rng.choices("ABCDEFGHIJabcdefghij0123456789+/", k=40)), lambda: "é word"]
    for i in range(100):
        texts.append((i, " ".join(rng.choice(kinds)() for _ in range(rng.randint(0, 30)))))
    df = spark.createDataFrame(texts, "doc_id long, text string").cache()
    red, hits = {r.doc_id: r.text for r in secrets.redact(df).collect()}, 0
    for r in secrets.SecretScan.fit(df).spans(df).collect():
        out, upto = "", 0
        for x in r.secret_spans:
            hits += x.kind == 3
            if x.s >= upto:
                out += r.text[upto : x.s] + "[SECRET]"
            upto = max(upto, x.e)
        assert red[r.doc_id] == out + r.text[upto:]
    assert hits > 50


def test_very_many_spans_in_one_text(spark):
    rng = random.Random(2)
    text = " é ".join(f"{rng.getrandbits(100):025x}" for _ in range(200_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert secrets.redact(df).first().text == " é ".join(["[SECRET]"] * 200_000)
    assert time.time() - began < 120


def test_a_text_without_letters_has_no_language(spark):
    known = [(i, "the cat and dog" if i % 2 else "это как что", "en" if i % 2 else "ru") for i in range(60)]
    odd = ["१२३", "٠١٢", "،", "๑๒", "׃", "123 ...", "́", "🙂", "Ⅷ", "٪", "", None]
    rows = known + [(1000 + i, t, None) for i, t in enumerate(odd)] + [(2000, "ª", None), (2001, "日", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all((got[1000 + i].lang_pred, got[1000 + i].score) == ("und", 0.0) for i in range(len(odd)))
    assert got[2000].lang_pred in ("en", "ru") and got[2001].lang_pred in ("en", "ru")
    assert all(langid.letter_table()[i] == (unicodedata.category(chr(i))[0] == "L") for i in range(0, 0x110000, 97))


def test_rows_without_an_id_teach_no_language(spark):
    rows = [(None, f"text number {i}", "xx") for i in range(500)]
    assert langid.fit_languages(spark.createDataFrame(rows, DOCS), most=20).langs == []
    same = spark.createDataFrame([(7, f"word{i}", "xx") for i in range(500)], DOCS)
    chosen = langid.fit_languages(same, most=20)  # an id that repeats: twice ``most`` rows
    assert chosen.langs == ["xx"]


def test_stretches_give_the_same_path(monkeypatch):
    rng = np.random.default_rng(0)
    for n, k in ((1, 3), (2, 4), (50, 4), (10_007, 4)):
        scores = (rng.normal(size=(n, k)) * 3).astype(np.float32)
        model = langid.LanguageModel(list("abcdefgh")[:k], None, None, rng.normal(size=k) * 0.1, 2.0)
        monkeypatch.setattr(langid, "LONG", 10**9)
        want = model.label(np.array([0, n]), scores)
        cut = n // 3 + 1
        parts, v = [], None
        for part in (scores[:cut], scores[cut:]):
            if len(part):
                came, v = model.forward(v, part)
                parts.append(came)
        state, got = int(v.argmax()), []
        for came in reversed(parts):
            labels, state = model.backward(came, state)
            got.append(labels)
        assert (np.concatenate(got[::-1]) == want).all()


def test_language_of_a_very_long_text(spark):
    rng = random.Random(6)
    kinds = {"aa": ["the", "of", "and", "ing", "tion"], "bb": ["der", "und", "ein", "ung", "keit"]}
    say = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(n))
    rows = [(i, say(k, 30), k) for i, k in enumerate(rng.choices(list(kinds), k=100))]
    model = langid.fit_languages(spark.createDataFrame(rows, DOCS))
    text = say("aa", 900_000) + " " + say("bb", 900_000)
    assert len(text) > 18_000_000
    began = time.time()
    ((_, before, letters, label),) = langid._labelled(model, pa.RecordBatch.from_arrays([pa.array([text])], names=["text"]))
    assert before.tolist() == [0, 1_800_000] and len(letters) == 1_800_000
    turn = np.flatnonzero(label[1:] != label[:-1]) + 1
    assert len(turn) == 1 and abs(turn[0] - 900_000) <= 2
    assert time.time() - began < 120


def test_quality_is_plain_ftrl(spark):
    """Weights and scores against an update loop in plain Python over features named one by one."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["aa", "Bb", "c1", "dd!", "dd!", "éé"], k=rng.randint(0, 12))), i % 2) for i in range(90)] + [(200, None, 1), (201, "", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, 7)], "doc_id long, label int")

    def h(raw, seed=1):
        return int(hash_words(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), seed)[0]) if raw else None

    def mix(x):
        x &= (1 << 64) - 1
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * by & ((1 << 64) - 1)
        return x ^ (x >> 31)

    def named(text):
        found, last, last_shape, before = {}, 7, 7, None
        for w in (text or "").encode().split():
            kinds = [1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b for b in w]
            shape = h(bytes(k for j, k in enumerate(kinds) if not j or k != kinds[j - 1]), 2)
            own = h(w)
            for x in (own, mix(own + last * 0x9E3779B97F4A7C15), mix(shape + last_shape * 0x9E3779B97F4A7C15 + (w == before) * 0xC2B2AE3D27D4EB4F)):
                found[x >> (64 - quality.BITS)] = found.get(x >> (64 - quality.BITS), 0) + 1
            last, last_shape, before = own, shape, w
        n = max(len((text or "").encode().split()), 1)
        return {k: v / n for k, v in found.items()} | {quality.DIM: 1.0}

    order = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    train = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1), key=lambda r: order[r[0]])
    z, n = {}, {}
    alpha, beta, l1, l2 = 2.0, 0.1, 0.002, 0.01

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    for _ in range(3):
        for _, text, y in train:
            x = named(text)
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
            for k, v in x.items():
                g, w, old = (p - y) * v, weight(k), n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w
                n[k] = old + g * g
    got = quality.fit_quality(docs, labels)
    assert np.abs(got - [weight(k) for k in range(quality.DIM + 1)]).max() < 1e-4
    for r in quality.quality(docs, labels).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(weight(k) * v for k, v in named(text).items()))), abs=1e-4)


def test_equal_texts_have_equal_scores_in_any_batch():
    rng = np.random.default_rng(1)
    weights, texts = rng.normal(size=quality.DIM), ["a b c d e f g " * 9, "", "x y"]
    alone = [quality.dot_products(weights, 0.1, *utf8(pa.array([t])))[0] for t in texts]
    for order in ([0, 1, 2], [2, 2, 0, 1], [1, 0, 0, 2]):
        assert quality.dot_products(weights, 0.1, *utf8(pa.array([texts[i] for i in order]))).tolist() == [alone[i] for i in order]


def test_next_document_with_more_buckets_than_quantiles(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "QUANTILES", 5)
    rng = random.Random(8)
    ids = [None, *rng.sample(range(-(10**6), 10**6), 200), 10**15, -(10**15)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(4)
    got = {r.text: r.next_text for r in fingerprints.with_next(df, {"n": F.length}).collect()}
    order = [f"t{i}" for i in sorted((i for i in ids if i is not None), reverse=True)] + ["tNone"]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
    numbers = df.select("doc_id", fingerprints._buckets(df, 16).alias("b")).where("doc_id is not null").orderBy(F.desc("doc_id")).collect()
    assert [r.b for r in numbers] == sorted(r.b for r in numbers) and len({r.b for r in numbers}) > 8


def test_components_of_hubs_chains_and_loops(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (5, 5), (None, 3), (7, 2000), (2000, 2001), (2001, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(300)} | {i: 1000 for i in range(1000, 1061)} | {2000: 0, 2001: 0}
    assert got == want


def test_pairs_that_the_sketch_speaks_against_are_compared(spark, monkeypatch):
    """With every pair held unlikely the exact comparison has to find all links of the buckets."""
    monkeypatch.setattr(neardup, "SLACK", -1e9)
    rng = random.Random(5)
    base = [[f"v{rng.randrange(10**6)}" for _ in range(80)] for _ in range(6)]
    rows = []
    for b in base:
        for _ in range(2):
            w = list(b)
            w[rng.randrange(80)] = "changed"
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: i - i % 2 for i in range(12)}


def test_ids_with_several_texts_link_their_classes(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    df = spark.createDataFrame([(1, a), (2, b), (7, a), (7, b), (9, c), (9, None), (4, c), (8, ""), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect())
    assert got == [(1, 18, 1), (2, 18, 1), (4, 18, 4), (7, 18, 1), (7, 18, 1), (8, 0, 8), (8, 0, 8), (9, 0, 4), (9, 18, 4)]


def test_repeats_by_brute_force_on_periodic_texts(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        parts = [rng.choice([["p", "q", "r"] * 40, [f"s{j}" for j in range(120)], [f"u{rng.randrange(9)}" for _ in range(40)], ["z"] * 90]) for _ in range(rng.randint(0, 4))]
        w = [x for p in parts for x in p[rng.randrange(20) : len(p) - rng.randrange(20)]]
        rows.append((i // 2 if i % 7 == 0 else i + 100, " ".join(w)))
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(i, first.get(k, i))
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in gone).encode()).hexdigest()))
    got = [tuple(r) for r in substring.substring_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 1000
