"""The analyses from records to reports, each one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import equality as E
from ..functions import normalize as N
from ..functions.dagjson import parse_dag
from ..functions.keys import key_parts, sample_key
from ..functions.segment import segment
from ..operators import dags, metrics, prompts, select, shape
from ..sources.records import first_per_key


def segmented(attempts: DataFrame, threshold: int = 300, min_step: int = 20) -> DataFrame:
    """Attempts with numbered ``steps`` and ``num_steps``; those without a response go."""
    steps = shape.numbered_steps(segment(F.col("response"), threshold, min_step))
    return attempts.where("response IS NOT NULL").withColumn("steps", steps).withColumn("num_steps", F.size("steps"))


def graphs_of_results(results: DataFrame) -> DataFrame:
    """problem_id, variant, sample_idx, dag and position of batch results (custom_id, content, position)."""
    return results.withColumn("k", key_parts(F.col("custom_id"))).select("k.problem_id", "k.variant", F.col("k.sample_idx").alias("sample_idx"), parse_dag(F.col("content")).alias("dag"), "position")


def graphs_of_records(analysed: DataFrame) -> DataFrame:
    """The same from merged records in long form (problem_id, variant, sample_idx, dag_analysis)."""
    return analysed.select(F.col("problem_id").cast("string").alias("problem_id"), "variant", "sample_idx", F.col("dag_analysis").alias("dag"), F.col("sample_idx").cast("bigint").alias("position"))


def originals(graphs: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """The graph of each problem's original: its first row (number 0 or none) in order, from ``graphs``, else from ``others``.

    A first row that doesn't parse leaves the problem without one from there.
    """
    first = lambda g: first_per_key(g.where("variant = 'original' AND coalesce(sample_idx, 0) = 0"), "problem_id").select("problem_id", "dag")
    if others is None:
        return first(graphs).where("dag IS NOT NULL")
    back = first(others).withColumnRenamed("dag", "other")
    return first(graphs).join(back, "problem_id", "full").select("problem_id", F.coalesce("dag", "other").alias("dag")).where("dag IS NOT NULL")


def ged_analysis(graphs: DataFrame, attempts: DataFrame, n: int = 50, most: int = 200_000, original_graphs: DataFrame | None = None) -> DataFrame:
    """Edit distance of each problem's original graph to each of its first n variant samples, with their verdicts.

    Graphs are compressed before the join, so each one only once.  Rows without a distance
    that weren't cut short are left out.
    """
    packed = lambda d, a: d.withColumn(a, dags.compress(F.col("dag"))[ "dag"])
    base = packed(originals(original_graphs if original_graphs is not None else graphs, graphs if original_graphs is not None else None), "left").select("problem_id", "left")
    samples = packed(select.first_n(graphs.where("variant IN ('simple', 'hard') AND sample_idx IS NOT NULL"), n), "right").drop("dag")
    labels = attempts.select(F.col("problem_id").cast("string").alias("problem_id"), "variant", "sample_idx", "problem", "response", "correct")
    pairs = base.join(samples, "problem_id").withColumn("s", dags.ged_similarity(compressed=False, most=most)(_as_dag("left"), _as_dag("right")))
    rows = with_labels(select.compared(pairs.select("problem_id", "variant", "sample_idx", "position", "s.*")), labels)
    return rows.select("problem_id", sample_key(F.col("problem_id"), F.col("variant"), F.col("sample_idx")).alias("sample_id"), "variant", "problem", "response", "correct", "ged", "similarity_normalized", "timed_out", "position")


def with_labels(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples with the other columns of ``labels`` (problem_id, variant, sample_idx, response and others); a sample without them has an empty response."""
    return samples.join(labels, ["problem_id", "variant", "sample_idx"], "left").withColumn("response", F.coalesce("response", F.lit("")))


def _as_dag(c: str) -> Column:
    """A compressed entry list in the shape of an uncompressed one."""
    return F.transform(c, lambda e: F.struct(e["step_id"].alias("step_id"), e["analysis"].alias("analysis"), e["depends_on"].alias("depends_on"), e["macro_action_tag"].alias("macro_action_tag")))


def training_set(ged: DataFrame, k: int = 5, min_range: float = 1.0, seed: int = 42) -> DataFrame:
    """Selected trajectories with the split of their problem."""
    rows = select.training_rows(select.top_k(ged, k, min_range))
    return rows.join(select.split_ids(rows, seed=seed), "problem_id")


def judged(attempts: DataFrame, spent: tuple[str, ...] = ()) -> DataFrame:
    """Attempts with ``is_correct``: the answers of the response against those of the truth, in one pass; without the columns ``spent``.

    Where single answers are equal or both are numbers, built-in functions decide.  Pairs of lists that they
    leave open meet in one task and follow each other there, so Python checks each once, however many rows have it.
    """
    truth = A.truths(F.col("problem"), F.col("ground_truth"), shape.dataset_type(F.col("variant")))
    found = A.predictions(F.col("problem"), F.coalesce("response", F.lit("")))

    def lists(x: Column) -> Column:
        return F.struct(x["answers"].alias("answers"), E.tail(x["found"], x["answers"]).alias("found"))

    def verdict(x: Column) -> Column:
        n, m = F.size(x["found"]), F.size(x["answers"])
        single = E.quick_equal(F.get(x["found"], F.lit(0)), F.get(x["answers"], F.lit(0)))
        quick = F.when(n == 0, m == 0).when(m == 0, False).when((n == 1) & (m == 1), single)
        return F.struct(quick.alias("quick"), F.when(quick.isNull(), x["found"]).alias("found"), F.when(quick.isNull(), x["answers"]).alias("answers"))

    def spread(x: Column) -> Column:
        pair = F.when(x["quick"].isNull(), F.xxhash64(x["found"], x["answers"])).otherwise(F.xxhash64("problem", "ground_truth", "response"))
        return F.struct(x["quick"].alias("quick"), x["found"].alias("found"), x["answers"].alias("answers"), pair.alias("pair"))

    both = F.struct(F.array_distinct(truth).alias("answers"), found.alias("found"))
    # no filter and no second branch on the struct: either would have Spark extract the answers again
    rows = attempts.withColumn("_v", N.let(N.let(N.let(both, lists), verdict), spread))
    rows = rows.select(*[c for c in attempts.columns if c not in spent], "_v")
    tasks = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, F.col("_v.pair")).sortWithinPartitions("_v.pair")
    slow = E.lists_match(F.col("_v.found"), F.col("_v.answers"), in_order=True)
    return rows.withColumn("is_correct", F.coalesce(F.col("_v.quick"), slow, F.lit(False))).drop("_v")


def checked(attempts: DataFrame, tolerance: float = E.TOLERANCE) -> DataFrame:
    """As ``judged``, with each distinct problem, truth and response read once, however many attempts have it.

    Attempts are computed twice, so they have to be the same each time; rows whose responses are made on the way go to ``judged``.
    """
    texts = [F.col(c) for c in ("problem", "ground_truth", "response")]
    kind = shape.dataset_type(F.col("variant"))
    nulls = [c.isNull() for c in texts]  # hashes pass over nulls
    same = [F.xxhash64(F.lit(seed), kind, *nulls, *texts) for seed in (1, 2)]
    keyed = attempts.withColumns({"_a": same[0], "_b": same[1]})
    asked = keyed.select("_a", "_b", kind.alias("variant"), *texts).distinct()
    verdicts = judged(asked, spent=("variant", "problem", "ground_truth", "response"))
    out = keyed.join(verdicts, ["_a", "_b"], "left")
    return out.select(*attempts.columns, "is_correct")


def evaluation(problems: DataFrame, call: Callable[[str, int, float, float], list[str]], **sampling: float) -> DataFrame:
    """Generates, checks and lays out attempts of paired problems (problem_id, variant, problem, ground_truth)."""
    asked = prompts.generate(problems.withColumn("sampling", shape.sampling_parameters(F.col("variant"), **sampling)), call)
    rows = asked.select("problem_id", "variant", "problem", "ground_truth", F.posexplode("responses").alias("sample_idx", "response"))
    return judged(rows)  # asks once


def compression_report(graphs: DataFrame) -> DataFrame:
    """How much each graph shrinks: one row a graph with the statistics of ``dags.compress``."""
    c = dags.compress(F.col("dag"))
    return graphs.withColumn("c", c).select("problem_id", "variant", "sample_idx", "c.*").drop("dag")


def stability_report(runs: DataFrame, most: int = 50_000) -> DataFrame:
    """Similarity of repeated analyses of one problem (problem_id, sample_idx, dag) by pairs, rolled up."""
    pairs = metrics.iteration_pairs(runs).withColumn("similarity", dags.ged_similarity(most=most)(F.col("a"), F.col("b"))["similarity_normalized"])
    return metrics.stability(pairs)


def repeated(samples: DataFrame, n: int) -> DataFrame:
    """Each sample n times, numbered by ``sample_idx``, to be analysed again and again."""
    return samples.drop("sample_idx").select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_idx"))


def report_rows(segmented: DataFrame, graphs: DataFrame) -> DataFrame:
    """Segmented samples with their graph, if there is one, and its diagram and table."""
    g = graphs.select("problem_id", "variant", "sample_idx", "dag")
    rows = segmented.withColumn("problem_id", F.col("problem_id").cast("string")).join(g, ["problem_id", "variant", "sample_idx"], "left")
    return rows.withColumns({"diagram": dags.mermaid(F.col("dag")), "dependencies": dags.dependency_table(F.col("dag"))})
