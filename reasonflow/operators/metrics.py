"""Roll-ups of attempts, graphs and similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dagjson import dependency_kind
from .ranks import medians


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 if b is zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def groups(attempts: DataFrame, key: str = "problem_id") -> DataFrame:
    """One row for each (problem, variant): first (sample 0 is correct), any_ok, n_ok, n.  An unknown verdict is false."""
    ok = F.coalesce("correct", F.lit(False))
    return attempts.groupBy(key, "variant").agg(F.min_by(ok, "sample_idx").alias("first"), F.bool_or(ok).alias("any_ok"), F.count_if(ok).alias("n_ok"), F.count("*").alias("n"))


def accuracy(attempts: DataFrame, key: str = "problem_id") -> DataFrame:
    """variant, total, first_acc, any_acc, sample_acc."""
    return groups(attempts, key).groupBy("variant").agg(F.count("*").alias("total"), ratio(F.count_if("first"), F.count("*")).alias("first_acc"), ratio(F.count_if("any_ok"), F.count("*")).alias("any_acc"), ratio(F.sum("n_ok"), F.sum("n")).alias("sample_acc"))


def all_variants_pass(attempts: DataFrame, problems: DataFrame | None = None, key: str = "problem_id") -> DataFrame:
    """One row: records, passed, all_variant_any_acc.  A problem passes if each variant that it has has a correct sample; one without any passes."""
    per = groups(attempts, key).groupBy(key).agg(F.bool_and("any_ok").alias("ok"))
    if problems is not None:
        per = problems.select(key).distinct().join(per, key, "left")
    ok = F.coalesce("ok", F.lit(True))
    return per.agg(F.count("*").alias("records"), F.count_if(ok).alias("passed"), ratio(F.count_if(ok), F.count("*")).alias("all_variant_any_acc"))


def run_counters(attempts: DataFrame, key: str = "problem_id") -> DataFrame:
    """One row: total problems, those with a correct sample in all three variants, and the rest."""
    per = groups(attempts, key).groupBy(key).agg((F.count_if("any_ok") == 3).alias("ok"))
    return per.agg(F.count("*").alias("total"), F.count_if("ok").alias("all_pass"), F.count_if(~F.col("ok")).alias("errors"))


def delta(new: DataFrame, base: DataFrame) -> DataFrame:
    """New minus base of each accuracy by variant, with signed percentages."""
    names = ["first_acc", "any_acc", "sample_acc"]
    rows = new.select("variant", *[F.col(c).alias(f"n_{c}") for c in names]).join(base.select("variant", *names), "variant")
    change = {c: F.col(f"n_{c}") - F.col(c) for c in names}
    return rows.select("variant", *[v.alias(f"{c}_delta") for c, v in change.items()], *[F.format_string("%+.2f%%", v * 100).alias(f"{c}_text") for c, v in change.items()])


def responses(attempts: DataFrame) -> DataFrame:
    """By variant and in all (variant null): present entries whose first sample is correct, or not (unknown counts as not)."""
    first = attempts.where("sample_idx = 0")
    ok = F.coalesce("correct", F.lit(False))
    return first.rollup("variant").agg(F.count("*").alias("present"), F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect"))


def ged_summary(df: DataFrame) -> DataFrame:
    """Mean GED by variant of correct and of other rows; rows without one don't count."""
    return df.where("ged IS NOT NULL").groupBy("variant", F.coalesce("correct", F.lit(False)).alias("correct")).agg(F.avg("ged").alias("mean_ged"), F.count("*").alias("n"))


def variants_by_split(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", F.coalesce("variant_type", F.lit("unknown")).alias("variant_type")).count().withColumnRenamed("count", "n")


def id_statistics(df: DataFrame, key: str, number: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_distinct(key).alias("n_distinct"), F.min_by(key, F.struct(number, key)).alias("min_id"), F.max_by(key, F.struct(number, key)).alias("max_id"))


def alpha_gap(df: DataFrame) -> DataFrame:
    """Mean alpha where the target is low and where it is high (0.0 if nowhere), and the gap."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("alpha"))), F.lit(0.0))
    low, high = mean(F.col("target") < 0.5), mean(F.col("target") >= 0.5)
    return df.agg(low.alias("low_alpha"), high.alias("high_alpha"), (high - low).alias("gap"))


def segmentation_totals(df: DataFrame) -> DataFrame:
    """One row over ``steps``: samples, total steps, mean."""
    return df.agg(F.count("*").alias("samples"), F.coalesce(F.sum(F.size("steps")), F.lit(0)).alias("total_steps"), ratio(F.coalesce(F.sum(F.size("steps")), F.lit(0)), F.count("*")).alias("mean_steps"))


def dag_statistics(graphs: DataFrame, dag: str = "dag") -> DataFrame:
    """One row over all graphs: steps, dependencies, entries by kind of dependency, and means."""
    kinds = F.transform(dag, lambda e: dependency_kind(e["depends_on"]))
    per = graphs.where(F.col(dag).isNotNull()).select(F.size(dag).alias("steps"), F.aggregate(dag, F.lit(0), lambda a, e: a + F.size(e["depends_on"])).alias("deps"), *[F.size(F.filter(kinds, _is(n))).alias(n) for n in ("problem", "external", "steps_only")])
    s = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("steps", "deps", "problem", "external", "steps_only")}
    return per.agg(F.count("*").alias("variants"), *[v.alias(f"n_{c}") for c, v in s.items()], ratio(s["steps"], F.count("*")).alias("mean_steps"), ratio(s["deps"], s["steps"]).alias("mean_deps"))


def _is(name: str):
    return lambda k: k == name.removesuffix("_only")


def tag_distribution(entries: DataFrame) -> DataFrame:
    """Of entries (tag, depends_on, ord): count and share of each tag, and entries by kind of dependency."""
    rows = entries.where("tag IS NOT NULL").withColumn("kind", dependency_kind(F.col("depends_on")))
    by_tag = rows.groupBy("tag").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"on_{k}") for k in ("problem", "external", "steps")])
    total = F.sum("n").over(Window.partitionBy())  # a few rows, one a tag
    return by_tag.select("tag", "n", ratio(F.col("n"), total).alias("share"), "on_problem", "on_external", "on_steps")


def compression_effect(df: DataFrame) -> DataFrame:
    """One row over ratio, absorbed, before and after: how much graphs shrank and what that did to their similarity."""
    change = F.col("after") - F.col("before")
    middle = medians(df.select(F.col("ratio").alias("ratio_median"), change.alias("change_median")), "ratio_median", "change_median")
    out = df.agg(
        F.count("ratio").alias("n"), F.avg("ratio").alias("ratio_mean"), F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"), F.when(F.count("ratio") > 1, F.stddev_samp("ratio")).alias("ratio_stdev"),
        F.avg("absorbed").alias("absorbed_mean"), F.sum("absorbed").alias("absorbed_total"), F.avg(change).alias("change_mean"), F.count_if(change > 0).alias("improved"), F.count_if(change < 0).alias("degraded"), F.count_if(change == 0).alias("unchanged"),
    )
    return out.crossJoin(middle)  # one row each


def stability(pairs: DataFrame, key: str = "problem_id") -> DataFrame:
    """By problem and in all (key null): statistics of ``similarity`` over pairs; a null similarity is a failed pair.  Bands from 0.95 and 0.85."""
    s = F.col("similarity")
    told = [F.count("*").alias("pairs"), F.count_if(s.isNull()).alias("failed"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("stdev"), F.min(s).alias("min"), F.max(s).alias("max")]
    by_problem = pairs.groupBy(key).agg(*told, F.median(s).alias("median"))  # a problem's pairs are few
    every = pairs.agg(F.lit(None).cast(pairs.schema[key].dataType).alias(key), *told).crossJoin(medians(pairs.select(s.alias("median")), "median"))
    out = by_problem.unionByName(every.select(by_problem.columns))
    mean = F.round("mean", 9)  # a band doesn't hang on the order of a sum
    return out.withColumn("band", F.when(mean > 0.95, "high").when(mean > 0.85, "moderate").when(mean.isNotNull(), "low"))


def iteration_pairs(runs: DataFrame, key: str = "problem_id", number: str = "sample_idx", value: str = "dag") -> DataFrame:
    """All pairs i < j of one problem's runs (a handful each): key, i, j and both values."""
    a = runs.select(key, F.col(number).alias("i"), F.col(value).alias("a"))
    b = runs.select(key, F.col(number).alias("j"), F.col(value).alias("b"))
    return a.join(b, key).where("i < j")
