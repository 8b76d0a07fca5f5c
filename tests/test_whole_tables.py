"""Queries work on all rows and whole texts of tables larger than the smallest ones."""

from __future__ import annotations

import html

import duckdb
from pyspark.sql import functions as F

from reasonflow import derived
from reasonflow.registry import ORACLES, QUERIES
from reasonflow.operators import dags


def test_sorted_ids_ranks_every_row(spark, tmp_path):
    kind = F.when(F.col("id") % 3 == 0, "view").otherwise("click")
    spark.range(5000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 101).alias("user_id"), kind.alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["sorted_ids"](spark, str(tmp_path)).collect()
    assert {r.event_id for r in got} == set(range(5000))
    assert [r.rank for r in got] == list(range(1, 5001))
    assert [(r.number, r.event_id) for r in got] == sorted((r.number, r.event_id) for r in got)


def conversations(spark, path, n, turns):
    rows = spark.range(n).select(F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))
    rows.select("conv_id", F.col("turn").cast("bigint"), F.lit("user").alias("role"), F.concat(F.lit("step "), F.col("turn").cast("string")).alias("text")).write.parquet(f"{path}/conversations.parquet")


def test_training_set_grows_with_the_table(spark, tmp_path, monkeypatch):
    used, make = [], dags.ged_similarity

    def spy(compressed=True, most=None):
        used.append(most)
        return make(compressed, 200_000 if most is None else most)

    monkeypatch.setattr(dags, "ged_similarity", spy)
    conversations(spark, tmp_path, 51 * 12, (F.col("id") % 3 + 1).cast("int"))
    rows = QUERIES["ged_training_set"](spark, str(tmp_path)).collect()
    assert len(rows) == 12 * 2 * 5 and len({r.problem_id for r in rows}) == 12
    QUERIES["ged_similarity"](spark, str(tmp_path))
    assert set(used) <= {None, 200_000} and len(used) == 2


def test_graphs_have_whole_texts(spark, tmp_path):
    odd = "x" * 45 + """ "quoted" it's {a: [1]}, <b>&amp;</b> \\ \n``` end }] """
    rows = [(c, t, "user", f"{c}.{t} {odd}{t}") for c in range(8) for t in range(c % 4 + 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    texts = {(c, t + 1): x for c, t, _, x in rows}
    got = {(r.conv_id, e.step_id): e.analysis for r in derived.dags(spark, str(tmp_path)).collect() for e in r.dag}
    assert got == texts
    for r in QUERIES["dependency_table"](spark, str(tmp_path)).collect():
        assert all(html.escape(x).replace("&#x27;", "&#39;") in r.html for (c, _), x in texts.items() if c == r.conv_id)
    for r in QUERIES["parse_dag_json"](spark, str(tmp_path)).collect():
        n = r.conv_id % 4 + 1
        assert r.n_repaired == {0: n, 1: n, 2: n - 1, 3: None}[r.conv_id % 4] and r.n_strict == (n if r.conv_id % 4 < 2 else None)
    for r in QUERIES["merge_batch"](spark, str(tmp_path)).collect():
        assert r.n_entries == (r.conv_id % 4 + 1 if r.conv_id % 5 > 1 else None)
    for r in QUERIES["dag_compress"](spark, str(tmp_path)).collect():
        joined = " | ".join(e.analysis or "" for e in r.dag)
        assert r.error is None and (r.folded > 0 or all(x in joined for (c, _), x in texts.items() if c == r.conv_id))


def test_long_chains_have_their_depth(spark, tmp_path):
    rows = [(c, t, "user", "x" * 6) for c, n in ((1, 150), (2, 65), (3, 12), (4, 11), (5, 3)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, exact = ({r.conv_id: (r.depth, r.width) for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("dag_depth_width", "dag_depth_width_kernel"))
    assert got == exact == {1: (150, 1), 2: (65, 1), 3: (12, 1), 4: (11, 1), 5: (3, 1)}
    schema = "g int, node string", "g int, src string, dst string"
    nodes = [(g, str(i)) for g, n in ((1, 4), (2, 40)) for i in range(n)]
    edges = [(g, str(i), str((i + 1) % n)) for g, n in ((1, 4), (2, 40)) for i in range(n)]
    cyclic = dags.longest_paths(spark.createDataFrame(nodes, schema[0]), spark.createDataFrame(edges, schema[1]), "g").collect()
    assert {(r.g, r.depth, r.width) for r in cyclic} == {(1, 0, 0), (2, 0, 0)}


def test_truths_of_large_ids(spark, tmp_path):
    ids = [0, 7, 999, 1000, 1499, 120000, 8999999, 9000000, 123456789]
    spark.createDataFrame(list(enumerate(ids)), "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {ids[r.event_id]: r.answer for r in QUERIES["benchmark_truths"](spark, str(tmp_path)).collect() if r.dataset == "comma"}
    assert got == {u: str(1000000 + u) for u in ids}


def test_prefixes_round_as_their_sql_does(spark, tmp_path):
    rows = [(i, 3, [s * x] + [0.0] * 63) for i, (s, x) in enumerate((s, x) for x in (1.453125, 2.984375, 5.734375, 1e-7, 0.0078125) for s in (1, -1))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.prefix for r in QUERIES["prefix_mix"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(con.execute(ORACLES["prefix_mix"]).fetchall())
    assert got[0][0] == 1.017187 and str(sorted(got.items())) == str(sorted(want.items()))  # as text, so that the signs of zeros count
