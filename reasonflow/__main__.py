"""Command line: ``python -m reasonflow COMMAND ...`` over JSON-lines files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import keys as K
from .operators import metrics, prompts, select, shape
from .plans import analyses
from .sources import records


def _attempts(spark: SparkSession, path: str) -> DataFrame:
    return shape.attempts(records.read_records(spark, path))


def _segmented(spark: SparkSession, path: str) -> DataFrame:
    rows = shape.variants(records.read_jsonl(spark, path, schemas.SEGMENTED))
    rows = rows.select("problem_id", "variant", F.col("entry.problem").alias("problem"), F.col("entry.ground_truth").alias("ground_truth"), F.posexplode("entry.samples").alias("sample_idx", "s"))
    return rows.select("problem_id", "variant", "sample_idx", "problem", "ground_truth", "s.*")


def _nest(rows: DataFrame, values: list[str]) -> DataFrame:
    """Long rows to one record a problem with a struct of problem, truth and samples for each variant."""
    samples = shape.nested(rows, ["problem_id", "variant", "problem", "ground_truth"], values)
    return samples.groupBy("problem_id").pivot("variant", schemas.VARIANTS).agg(F.first(F.struct("problem", "ground_truth", "samples")))


def segment(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = analyses.segmented(_attempts(spark, a.input), a.threshold, a.min_step)
    records.write_jsonl(_nest(rows, ["response", "correct", "steps", "num_steps"]), a.output or records.segmented_name(a.input))
    metrics.segmentation_totals(rows).show()


def requests(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _segmented(spark, a.input).where(F.col("variant").isin(a.variants))
    records.write_jsonl(prompts.batch_requests(records.head(rows, a.limit), a.model), a.output)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    merged = prompts.merge_results(_segmented(spark, a.input), records.read_batch_results(spark, a.results), a.model, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    records.write_jsonl(_nest(merged, ["response", "correct", "steps", "num_steps", "dag_analysis", "dag_error", "dag_metadata"]), a.output)


def ged(spark: SparkSession, a: argparse.Namespace) -> None:
    graphs = analyses.graphs_of_results(records.read_batch_results(spark, a.results))
    others = analyses.graphs_of_results(records.read_batch_results(spark, a.originals)) if a.originals else None
    attempts = _attempts(spark, a.records)
    if a.problem_id is not None:
        graphs, attempts = graphs.where(F.col("problem_id") == str(a.problem_id)), attempts.where(F.col("problem_id") == a.problem_id)
    rows = analyses.ged_analysis(graphs, attempts, a.num_samples, original_graphs=others).drop("position").withColumn("problem_id", F.col("problem_id").try_cast("bigint"))
    records.write_jsonl(rows, a.output)
    written = spark.read.schema(schemas.GED_RESULT).json(a.output)
    if a.csv:
        records.write_csv_by_problem(written, a.csv)
    metrics.ged_summary(written).show()


def choose(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = records.read_jsonl(spark, a.input, schemas.GED_RESULT, position=True)
    records.write_jsonl(select.training_rows(select.top_k(rows, a.top_k, a.min_range)), a.output)
    select.filter_reasons(rows, a.top_k, a.min_range).show()


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = records.read_jsonl(spark, a.input, schemas.TRAINING)
    if rows.where("problem_id IS NULL").count() or rows.isEmpty():
        raise SystemExit("there are no rows, or rows without an id")
    rows = rows.join(select.split_ids(rows, ratios=tuple(a.ratios), seed=a.seed), "problem_id")
    for name in ("train", "val", "test"):
        records.write_jsonl(rows.where(F.col("split") == name).drop("split"), f"{a.output}_{name}")
    metrics.variants_by_split(rows).show()


def accuracy(spark: SparkSession, a: argparse.Namespace) -> None:
    new = _attempts(spark, a.input)
    metrics.accuracy(new).show()
    metrics.all_variants_pass(new, records.read_records(spark, a.input)).show()
    if a.compare:
        metrics.delta(metrics.accuracy(new), metrics.accuracy(_attempts(spark, a.compare))).show()


def errors(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = records.read_records(spark, a.input)
    hits = select.verdicts(shape.attempts(rows)).where(select.pattern(a.filter)).select("problem_id")
    records.write_jsonl(records.only_ids(rows, hits).drop("position"), a.output)


def sort(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = records.with_position(spark.read.json(a.input))
    key = K.problem_of(F.col("custom_id") if "custom_id" in rows.columns else F.lit(None).cast("string"), F.col("problem_id") if "problem_id" in rows.columns else None)
    ordered = rows.withColumn("_n", K.numeric_id(key)).orderBy("_n", "position").drop("_n", "position")
    records.write_jsonl(ordered, a.output)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _attempts(spark, a.input)
    metrics.responses(rows).show()
    records.write_report(records.head(rows, a.limit), a.output, "Responses")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="reasonflow")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *args: tuple) -> None:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for flag, options in args:
            p.add_argument(flag, **options)

    need = lambda flag: (flag, {"required": True})
    add("segment", segment, need("--input"), ("--output", {}), ("--threshold", {"type": int, "default": 300}), ("--min-step", {"type": int, "default": 20}))
    add("requests", requests, need("--input"), need("--output"), ("--model", {"default": "model"}), ("--limit", {"type": int}), ("--variants", {"nargs": "+", "default": schemas.VARIANTS}))
    add("merge", merge, need("--input"), need("--results"), need("--output"), ("--model", {"default": "model"}))
    add("ged", ged, need("--results"), need("--records"), need("--output"), ("--originals", {}), ("--problem-id", {"type": int}), ("--num-samples", {"type": int, "default": 50}), ("--csv", {}))
    add("select", choose, need("--input"), need("--output"), ("--top-k", {"type": int, "default": 5}), ("--min-range", {"type": float, "default": 1.0}))
    add("split", split, need("--input"), need("--output"), ("--ratios", {"type": float, "nargs": 3, "default": [0.8, 0.1, 0.1]}), ("--seed", {"type": int, "default": 42}))
    add("accuracy", accuracy, need("--input"), ("--compare", {}))
    add("errors", errors, need("--input"), need("--output"), ("--filter", {"choices": select.PATTERN_NAMES, "required": True}))
    add("sort", sort, need("--input"), need("--output"))
    add("report", report, need("--input"), need("--output"), ("--limit", {"type": int, "default": 1000}))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)


if __name__ == "__main__":
    main()
