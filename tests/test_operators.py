"""Operators on hand-made records, and edge cases of nulls, ties and empty tables."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from reasonflow import schemas
from reasonflow.operators import dags, metrics, model, prompts, select, shape
from reasonflow.plans import analyses
from reasonflow.sources import records
from reasonflow.streaming.incremental import segment_arriving

ATTEMPT = "problem_id int, variant string, sample_idx int, correct boolean"


def attempts(spark):
    rows = [(1, "original", 0, True), (1, "simple", 0, False), (1, "simple", 1, True), (1, "hard", 0, False), (1, "hard", 1, None), (2, "original", 0, False), (2, "simple", 0, True), (2, "simple", 1, True)]
    return spark.createDataFrame(rows, ATTEMPT)


def test_accuracy(spark):
    got = {r.variant: (r.total, r.first_acc, r.any_acc, r.sample_acc) for r in metrics.accuracy(attempts(spark)).collect()}
    assert got == {"original": (2, 0.5, 0.5, 0.5), "simple": (2, 0.5, 1.0, 0.75), "hard": (1, 0.0, 0.0, 0.0)}
    problems = spark.createDataFrame([(1,), (2,), (3,)], "problem_id int")
    r = metrics.all_variants_pass(attempts(spark), problems).first()
    assert (r.records, r.passed) == (3, 1)  # the third has nothing to fail
    assert metrics.run_counters(attempts(spark)).first().all_pass == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], ATTEMPT)
    assert metrics.accuracy(none).count() == 0
    assert metrics.all_variants_pass(none).first().all_variant_any_acc == 0.0
    assert metrics.segmentation_totals(spark.createDataFrame([], "steps array<string>")).first().mean_steps == 0.0


def ged_rows(spark, values, variant="simple"):
    return spark.createDataFrame([(1, variant, i, v, True, False) for i, v in enumerate(values)], "problem_id int, variant string, position int, ged double, correct boolean, timed_out boolean")


@pytest.mark.parametrize(("variant", "want"), [("simple", [1, 2]), ("hard", [3, 0])])
def test_top_k_is_stable(spark, variant, want):
    rows = select.top_k(ged_rows(spark, [3.0, 1.0, 1.0, 5.0], variant), k=2).orderBy("rank").collect()
    assert [r.position for r in rows] == want


def test_top_k_needs_a_range(spark):
    assert select.top_k(ged_rows(spark, [2.0, 2.0])).count() == 0
    assert select.top_k(ged_rows(spark, [2.0, 3.0])).count() == 2


@pytest.mark.parametrize(("n", "size"), [(5, 1), (25, 2), (1, 1)])
def test_percentile_slices(spark, n, size):
    rows = select.percentile_slices(spark.createDataFrame([(i, float(i)) for i in range(n)], "id int, ged double"), "id").collect()
    assert sorted(r.id for r in rows if r.category == "low") == list(range(size))
    assert sorted(r.id for r in rows if r.category == "high") == list(range(n - size, n))


@pytest.mark.parametrize(("n", "sizes"), [(10, (8, 1, 1)), (7, (5, 0, 2)), (1, (0, 0, 1))])
def test_split_sizes(spark, n, sizes):
    ids = spark.range(n).withColumnRenamed("id", "problem_id")
    got = [r.split for r in select.split_ids(ids.union(ids)).collect()]
    assert tuple(got.count(s) for s in ("train", "val", "test")) == sizes
    by_python = list(select.python_split(list(range(n))).values())
    assert tuple(by_python.count(s) for s in ("train", "val", "test")) == sizes
    with pytest.raises(ValueError):
        select.split_ids(ids, ratios=(0.5, 0.1, 0.1))


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    lines = [{"problem_id": 1, "original": {"problem": "p", "samples": [{"response": "é", "correct": True}, {"response": "b", "correct": None}]}, "simple": {"response": "flat", "correct": False}}, {"problem_id": 2}]
    with open(path, "w") as f:
        f.write("\n\n".join(json.dumps(x) for x in lines) + "\n")
    df = shape.attempts(records.read_records(spark, path))
    rows = df.collect()
    assert {(r.problem_id, r.variant, r.sample_idx, r.response) for r in rows} == {(1, "original", 0, "é"), (1, "original", 1, "b"), (1, "simple", 0, "flat")}
    records.write_jsonl(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert "é" in text and '"correct":null' in text


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"custom_id": "1_simple_0", "response": {"body": {"choices": [{"message": {"content": "[]"}}]}}}\n{broken\n')
    assert records.read_batch_results(spark, str(tmp_path / "x.jsonl")).count() == 1


def test_appending_skips_what_is_there(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "a")
    records.append_unfinished(df, path, "id")
    records.append_unfinished(spark.range(5), path, "id")
    assert sorted(r.id for r in spark.read.schema("id long").json(path).collect()) == [0, 1, 2, 3, 4]


def test_streaming_segments_each_file_once(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    (tmp_path / "src").mkdir()
    for i in range(2):
        (tmp_path / "src" / f"{i}.jsonl").write_text(json.dumps({"problem_id": i, "original": {"problem": "p", "samples": [{"response": "One long step is here.\n\nAnother long step is here.", "correct": True}]}}) + "\n")
        segment_arriving(spark, src, out, at).awaitTermination(60)
    rows = spark.read.json(out).collect()
    assert sorted((r.problem_id, r.num_steps) for r in rows) == [(0, 2), (1, 2)]


def entries(*rows):
    return [{"step_id": i, "analysis": "a<b", "depends_on": d, "macro_action_tag": t} for i, d, t in rows]


def test_tables_and_kernels_agree_on_depth(spark):
    g = spark.createDataFrame([(1, entries((1, ["0"], "Define"), (2, ["1", "External"], "Derive"), (3, ["1", "2"], None)))], f"g int, dag {schemas.DAG}")
    e = shape.dag_entries(g, "g")
    nodes, edges = dags.nodes(e, "g"), dags.edges(e, "g")
    assert nodes.count() == 5 and edges.count() == 5
    r = dags.longest_paths(nodes, edges, "g").first()
    k = g.select(dags.depth_width(F.col("dag")).alias("x")).first().x
    assert (r.depth, r.width) == (k.depth, k.width) == (3, 2)
    assert "a&lt;b" in g.select(dags.dependency_table(F.col("dag"))).first()[0]


def test_ged_analysis_to_training_set(spark):
    reply = lambda n: json.dumps(entries(*[(i, [str(i - 1)], ["Define", "Derive"][i % 2]) for i in range(1, n + 1)]))
    raw = [("7_original_0", reply(2), 0), ("7_simple_0", reply(3), 1), ("7_simple_1", reply(5), 2), ("7_hard_0", "no", 3), ("8_simple_0", reply(1), 4)]
    graphs = analyses.graphs_of_results(spark.createDataFrame(raw, "custom_id string, content string, position int"))
    labels = spark.createDataFrame([(7, "simple", 0, "p", "r0", True)], "problem_id int, variant string, sample_idx int, problem string, response string, correct boolean")
    rows = {r.sample_id: r for r in analyses.ged_analysis(graphs, labels).collect()}
    assert set(rows) == {"7_simple_0", "7_simple_1"}
    assert rows["7_simple_0"].ged == 2.0 and rows["7_simple_0"].correct and rows["7_simple_1"].correct is None and rows["7_simple_1"].response == ""
    assert analyses.training_set(analyses.ged_analysis(graphs, labels), min_range=0.0).count() == 1


def test_merge_keeps_the_last_reply(spark):
    samples = spark.createDataFrame([(1, "simple", 0), (2, "simple", 0)], "problem_id int, variant string, sample_idx int")
    results = spark.createDataFrame([("1_simple_0", "oops", 0), ("1_simple_0", "[]", 1)], "custom_id string, content string, position int")
    got = {r.problem_id: (r.dag_analysis, r.dag_error) for r in prompts.merge_results(samples, results, "m", F.lit("t")).collect()}
    assert got == {1: ([], None), 2: (None, None)}


def test_asking_retries_and_records_errors(spark):
    rows = spark.createDataFrame([("good",), ("bad",)], "prompt string")

    def call(system, user):
        if user == "bad":
            raise ValueError("no")
        return "[]"

    got = {r.prompt: (r.reply, r.error) for r in prompts.ask(rows, call, delay=0.0).collect()}
    assert got == {"good": ("[]", None), "bad": (None, "no")}


def test_rate_limit_waits():
    slept, clock = [], iter(range(100))
    limit = prompts.RateLimit(2)
    for _ in range(3):
        limit.wait(now=lambda: next(clock) * 0.1, sleep=slept.append)
    assert len(slept) == 1 and 59 < slept[0] <= 60


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, "original", "1+1?", "so \\boxed{2}"), (1, "simple", "1+2?", "3")], "problem_id int, variant string, problem string, ground_truth string")
    got = analyses.evaluation(rows, lambda p, n, t, q: [f"\\boxed{{{eval(p.rstrip('?'))}}}"] * n, n=2).collect()
    assert len(got) == 3 and all(r.is_correct for r in got)


def test_checked_answers(spark):
    cases = [("\\boxed{1 - \\sqrt[4]{x + 1}}", "1 - (x + 1)^{\\frac14}", True), ("\\boxed{3}, \\boxed{2}", "2 or 3", True), ("\\boxed{4}", "5", False), (None, "5", False), ("\\boxed{x}", None, False)]
    df = spark.createDataFrame([(i, "simple", "q", t, r) for i, (r, t, _) in enumerate(cases)], "problem_id int, variant string, problem string, ground_truth string, response string")
    got = {r.problem_id: r.is_correct for r in analyses.checked(df).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_evaluation_asks_once(spark, tmp_path):
    def call(p, n, t, q):
        (tmp_path / uuid.uuid4().hex).touch()
        return ["\\boxed{x+x}"] * n

    rows = spark.createDataFrame([(i, "simple", f"q{i}", "2*x") for i in range(5)], "problem_id int, variant string, problem string, ground_truth string")
    got = analyses.evaluation(rows, call, n=3).collect()
    assert len(got) == 15 and all(r.is_correct for r in got) and len(list(tmp_path.iterdir())) == 5


def test_equal_attempts_are_read_once(spark):
    texts = [("q", "2*x", "\\boxed{x+x}"), ("q", None, "2*x"), (None, "2*x", "q"), (None, "3", "so 3"), ("q", "", None), ("separated by commas", "\\boxed{1,2}", "\\boxed{2}, \\boxed{1}"), ("q", "\\boxed{1,2}", "\\boxed{2}, \\boxed{1}")]
    rows = [(i, v, *texts[i % len(texts)]) for i, v in enumerate(["original", "simple", None] * 70)]
    df = spark.createDataFrame(rows, "problem_id int, variant string, problem string, ground_truth string, response string")
    got = {r.problem_id: r.is_correct for r in analyses.checked(df).collect()}
    alone = {r.problem_id: r.is_correct for r in analyses.judged(df).collect()}
    assert len(got) == 210 and got == alone and {got[i] for i in range(0, 210, 7) if i % 3} == {True}
    one = analyses.judged(df)._jdf.queryExecution().optimizedPlan().toString()
    both = analyses.checked(df)._jdf.queryExecution().optimizedPlan().toString()
    assert both.count("he answer is") == one.count("he answer is")
    assert "Sort [_v" in both and both.index("he answer is") > both.index("Aggregate [") > both.index("Sort [_v")  # plans print downwards: distinct texts are read, then sorted by pairs


def test_stability(spark):
    d = entries((1, ["0"], "Define"))
    runs = spark.createDataFrame([(1, 0, d), (1, 1, d), (1, 2, None)], f"problem_id int, sample_idx int, dag {schemas.DAG}")
    r = {x.problem_id: x for x in analyses.stability_report(runs).collect()}
    assert (r[1].pairs, r[1].failed, r[1].mean, r[1].band) == (3, 2, 1.0, "high")
    assert r[None].pairs == 3


def test_losses_and_tensors(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "alpha double, target double")
    assert [r[0] for r in df.select(model.cross_entropy(F.col("alpha"), F.col("target"))).collect()] == [100.0, 0.0]
    t = spark.range(1).select(model.training_tensors(F.array(F.lit(5), F.lit(6)).cast("array<bigint>"), F.array(F.lit(7)).cast("array<bigint>"), 4).alias("t")).first().t
    assert (t.input_ids, t.attention_mask, t.labels) == ([5, 6, 7, 0], [1, 1, 1, 0], [-100, -100, 7, -100])


def test_names_and_reports(spark, tmp_path):
    assert records.segmented_name("/a/all_records_50.jsonl") == "/a/segmented_records_50.jsonl"
    assert records.report_name("s", "original_vs_hard", "low") == "s_original_vs_hard_low.html"
    records.write_report(spark.range(2), str(tmp_path / "page"), "Title")
    assert "Title" in (tmp_path / "page.html").read_text()
    records.write_summary(spark.range(1), {"a": 1}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text())["results"] == [{"id": 0}]
    (tmp_path / "sim.csv").write_text("problem_id,original_vs_simple_ged,original_vs_hard_ged\n1,0.0,\n2,x,3\n")
    low = select.low_ged(records.read_similarity_csv(spark, str(tmp_path / "sim.csv"))).collect()
    assert [(r.problem_id, r.comparison, r.ged) for r in low] == [("1", "original_vs_simple", 0.0)]


def test_ranks_and_medians_of_whole_tables(spark):
    import random
    import statistics

    from reasonflow.operators import ranks

    rng = random.Random(3)
    for values in ([7.0], [1.0, 2.0], [rng.choice([0.0, 0.0, 1.0, rng.random()]) for _ in range(5001)], [float(i) for i in range(10_000)], [None, 3.0, None]):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(5)
        got = ranks.medians(df, "v", "i").first()
        assert got.v == statistics.median([v for v in values if v is not None]) and got.i == (len(values) - 1) / 2
        ranked = {r.i: (r._rn, r._n) for r in ranks.with_rank(df.where("v IS NOT NULL"), "v", "i").collect()}
        order = sorted((v, i) for i, v in enumerate(values) if v is not None)
        assert ranked == {i: (n + 1, len(order)) for n, (_, i) in enumerate(order)}
    assert ranks.medians(spark.createDataFrame([], "v double"), "v").first().v is None
    rows = spark.createDataFrame([(i, float(i % 50)) for i in range(200)], "problem_id long, ged double")
    slices = select.percentile_slices(rows, "problem_id").collect()
    assert sum(r.category == "low" for r in slices) == 20 == sum(r.category == "high" for r in slices)
    assert {r.ged for r in slices if r.category == "low"} == {0.0, 1.0, 2.0, 3.0, 4.0}


def test_strict_scans_reject_blank_lines(spark, tmp_path):
    from reasonflow.sources import records

    (tmp_path / "a.jsonl").write_text('{"x":1}\n\n{"x":2}\n')
    assert records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int").count() == 2
    assert [r.x for r in records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int", strict=False, position=True).orderBy("position").collect()] == [1, 2]
    with pytest.raises(Exception, match="a blank line"):
        records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int", blank_lines=False).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.jsonl").write_text('{"k":1,"x":1}\n')
    (tmp_path / "b" / "b.jsonl").write_text("".join(f'{{"k":1,"x":{i}}}\n' for i in range(2, 203)))
    rows = records.read_jsonl(spark, str(tmp_path / "b"), "k int, x int", position=True)
    assert records.last_per_key(rows, "k").first().x == 202 and records.first_per_key(rows, "k").first().x == 1
