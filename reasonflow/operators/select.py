"""Choosing trajectories: filters, top-k, slices and splits.

Sorts are stable: ``position`` (or what the caller names) is the last sort key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import with_rank

GROUP = ("problem_id", "variant")


def usable(df: DataFrame) -> DataFrame:
    """Correct rows with a GED that didn't time out; an unknown verdict doesn't count as correct."""
    return df.where("correct AND ged IS NOT NULL AND NOT coalesce(timed_out, false)")


def top_k(df: DataFrame, k: int = 5, min_range: float = 1.0, order: str = "position") -> DataFrame:
    """The k best of each (problem, variant): least GED for ``simple``, greatest for others.

    Groups whose GEDs range over less than ``min_range`` give nothing.
    """
    group = Window.partitionBy(*GROUP)
    rank = group.orderBy(F.when(F.col("variant") == "simple", F.col("ged")).otherwise(-F.col("ged")), order)
    rows = usable(df).withColumn("_range", F.max("ged").over(group) - F.min("ged").over(group)).withColumn("rank", F.row_number().over(rank))
    return rows.where((F.col("_range") >= min_range) & (F.col("rank") <= k)).drop("_range")


def training_rows(df: DataFrame) -> DataFrame:
    """Rows of the training set: a target of 0 for the simple variant, 1 for others."""
    return df.select("problem_id", "problem", "response", F.col("variant").alias("variant_type"), F.when(F.col("variant") == "simple", 0.0).otherwise(1.0).alias("target_alpha"), F.col("ged").alias("ged_score"), "sample_id")


def filter_reasons(df: DataFrame, k: int = 5, min_range: float = 1.0) -> DataFrame:
    """How many groups were skipped for which reason, and how many rows are kept: reason, n_groups, n_rows."""
    good = F.col("correct") & F.col("ged").isNotNull() & ~F.coalesce("timed_out", F.lit(False))
    groups = df.groupBy(*GROUP).agg(F.count_if(good).alias("n"), (F.max(F.when(good, F.col("ged"))) - F.min(F.when(good, F.col("ged")))).alias("range"))
    reason = F.when(F.col("n") == 0, "no_correct").when(F.col("range") < min_range, "low_range").otherwise("selected")
    return groups.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_groups"), F.sum(F.when(reason == "selected", F.least("n", F.lit(k))).otherwise(0)).alias("n_rows"))


def first_n(df: DataFrame, n: int = 50, order: str = "sample_idx") -> DataFrame:
    """The first n rows of each group whose graph was parsed (``dag`` not null)."""
    w = Window.partitionBy(*GROUP).orderBy(order)
    return df.where("dag IS NOT NULL").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def percentile_slices(df: DataFrame, key: str, value: str = "ged", low: float = 10, high: float = 10, by: list[str] | None = None, order: str | None = None) -> DataFrame:
    """The lowest and highest p percent (one at least) of each group, or of all rows; a row may be in both: category low / high."""
    rows = df.where(F.col(value).isNotNull())
    if by:
        w, total = Window.partitionBy(*by).orderBy(value, order or key), Window.partitionBy(*by)
        rows = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(total))
    else:
        rows = with_rank(rows, value, order or key)
    size = lambda p: F.greatest(F.lit(1), F.floor(F.col("_n") * p / 100.0))
    lows = rows.where(F.col("_rn") <= size(low)).withColumn("category", F.lit("low"))
    highs = rows.where(F.col("_rn") > F.col("_n") - size(high)).withColumn("category", F.lit("high"))
    return lows.unionByName(highs).drop("_rn", "_n")


def compared(df: DataFrame) -> DataFrame:
    """Rows with a distance, or whose search was cut short."""
    return df.where("ged IS NOT NULL OR timed_out")


def by_frequency(df: DataFrame, value: str, order: str) -> DataFrame:
    """``value`` and n, the most frequent first, among equals the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").drop("_first")


def low_ged(df: DataFrame, most: float = 0.0) -> DataFrame:
    """Similarity rows unpivoted to (problem_id, comparison, ged) with a GED of at most ``most``."""
    names = ["original_vs_simple_ged", "original_vs_hard_ged"]
    long = df.unpivot("problem_id", names, "comparison", "ged")
    return long.where(F.col("ged") <= most).withColumn("comparison", F.regexp_replace("comparison", "_ged$", ""))




def pattern(name: str) -> Column:
    o, s, h = (F.coalesce(F.col(c), F.lit(False)) for c in ("original", "simple", "hard"))
    return {"original_not_simple": o & ~s, "original_hard_not_simple": o & ~s & h, "easier_not_hard": (o | s) & ~h}[name]


PATTERN_NAMES = ["original_not_simple", "original_hard_not_simple", "easier_not_hard"]


def verdicts(attempts: DataFrame, key: str = "problem_id") -> DataFrame:
    """One row a problem: whether its first sample of each variant is correct."""
    return attempts.where("sample_idx = 0").groupBy(key).pivot("variant", ["original", "simple", "hard"]).agg(F.bool_or("correct"))


def split_ids(ids: DataFrame, key: str = "problem_id", ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, parts: int = 256) -> DataFrame:
    """(key, split): train, val or test by the order of md5(seed:id), so that both engines agree.

    The rank of an id is its rank within its hash's leading byte plus the number of ids in
    lesser ones, so ids are ranked in many tasks.
    """
    if abs(sum(ratios) - 1) > 1e-8:
        raise ValueError("ratios must sum to 1")
    rows = ids.select(key).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_b", F.substring("_h", 1, 2))
    sizes = rows.groupBy("_b").count()
    before = sizes.select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_before"), F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))  # 256 rows
    ranked = rows.join(F.broadcast(before), "_b").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    train, val = F.floor(F.col("_n") * ratios[0]), F.floor(F.col("_n") * ratios[1])
    return ranked.select(key, F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "val").otherwise("test").alias("split"))


def python_split(ids: list, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> dict:
    """The split of a short list of ids by CPython's seeded shuffle: id to split."""
    import random

    if not ids:
        raise ValueError("no ids")
    if any(i is None for i in ids):
        raise ValueError("a row has no id")
    ids = list(dict.fromkeys(ids))
    random.Random(seed).shuffle(ids)
    train, val = int(len(ids) * ratios[0]), int(len(ids) * ratios[1])
    return {x: "train" if i < train else "val" if i < train + val else "test" for i, x in enumerate(ids)}


def random_subset(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same ones each time."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
