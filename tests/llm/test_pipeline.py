"""The corpus pipeline, stage by stage, against brute force."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import SCHEMA, components, corpus, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    good = corpus()
    bad = [(10_000 + i, " ".join(f"{w.upper()}!!" for w in (t or "x").split()[:60])) for i, (_, t) in enumerate(good[:50]) if t]
    rows = good + bad
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 10_000), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages(spark, tables, tmp_path):
    d, rows = tables
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[n] = docs.collect()
        if n < 4:
            assert docs.columns == columns
    kept = {r.doc_id: r.text for r in seen[0]}
    clean = [i for i, t in rows if i < 10_000 and t and len(t.split()) > 5]
    assert not [i for i in kept if i >= 10_000] and set(clean) <= set(kept)

    comp = components(sorted(kept.items()), 5, 80)
    assert {r.doc_id for r in seen[1]} == {i for i, (_, c) in comp.items() if i == c}

    left = sorted((r.doc_id, r.text) for r in seen[1])
    first: dict[tuple, int] = {}
    for i, t in left:
        w = words(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    got = {r.doc_id: r.text for r in seen[2]}
    for i, t in left:
        w = words(t)
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        assert got[i] == (" ".join(x for q, x in enumerate(w) if q not in gone) if gone else t)

    for r in seen[3]:
        was = got[r.doc_id]
        assert "AKIA" not in (r.text or "") and not re.search("[0-9a-f]{24}", r.text or "")
        assert r.text == was or "[SECRET]" in r.text
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert {r.doc_id for r in seen[4]} == set(got)
    assert max(lengths(seen[4]).values()) <= 1024
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    pieces: dict[int, list] = {}
    for r in sorted(seen[4], key=lambda r: (r.doc_id, r.piece)):
        pieces.setdefault(r.doc_id, []).extend(int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4))
    clean = {r.doc_id: r.text for r in seen[3]}
    assert pieces == {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in clean.items()}


def lengths(rows):
    out: dict[int, int] = {}
    for r in rows:
        out[r.sequence_id] = out.get(r.sequence_id, 0) + r.length
    return out


def test_run(spark, tables):
    d, _ = tables
    a, b = ({(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, d).select("doc_id", "piece", "ids_crc32").collect()} for _ in range(2))
    assert a == b and a


def test_repeated_rows_leave_one(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 60")
    twice = docs.unionByName(docs).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    out = corpus_pipeline.near_dedup(spark, twice, d)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and None in ids


def test_ids_with_several_texts(spark, tables):
    """Unlike texts of one id both stay; a near copy of either goes, whatever its id; of equal rows one stays."""
    d, _ = tables
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, b, "en", "s", 1), (5, a, "en", "s", 1), (5, a, "en", "t", 2), (9, a + " end", "en", "s", 3), (2, b, "en", "s", 4), (9, c, "en", "s", 5), (9, None, "en", "s", None), (9, None, "en", "s", None), (None, a, "en", "s", 6)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), d)
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    got = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    assert got == sorted([(5, a), (2, b), (9, c), (9, ""), (-1, a)])
    again = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), d)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_empty_documents(spark, tables):
    d, _ = tables
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.count() == 0


def test_columns_of_any_name_come_through(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 90 or doc_id > 190")
    for c in ("score", "label", "label_id", "secret_spans", "base_spans", "tag", "k", "size", "bucket", "component", "n"):
        docs = docs.withColumn(c, F.lit(c))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        assert all(r.score == "score" and r.secret_spans == "secret_spans" and r.n == "n" for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() > 0
