"""Ranks and medians of whole tables, found in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The share of rows on each side of the middle among which a median is looked for, and the accuracy of the quantiles that bound them.
AROUND, ACCURACY = 0.001, 10_000


def with_rank(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_rn``, the place of each row by ``order`` from 1, and ``_n``, the number of rows.

    Rows are dealt to ranges of all the sort keys, so that a value that is very common is parted by the
    keys after it, and numbered within; the sizes of the ranges (a row each) tell what stands before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    every = Window.orderBy("_part")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(every) - F.col("_size")).alias("_before"), F.sum("_size").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    return rows.join(F.broadcast(before), "_part").withColumn("_rn", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def medians(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the exact median (double) of each column, nulls left out; null if there is none.

    Quantiles close to the middle bound the rows that can hold it; the others are only counted.  Equal
    values are summed before they are dealt, so what is sorted is the distinct values of a small share of the rows.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    near = [0.5 - AROUND, 0.5 + AROUND]
    bounds = df.agg(*[F.percentile_approx(v, near, ACCURACY).alias(c) for c, v in values.items()]).first()  # two numbers a column
    total = df.agg(*[x for c, v in values.items() for x in (F.count(c).alias(f"{c}_n"), F.count_if(v < (bounds[c] or [0.0])[0]).alias(f"{c}_under"))]).first()
    one = df.sparkSession.range(1)
    for c, v in values.items():
        n, under = total[f"{c}_n"], total[f"{c}_under"]
        if not n:
            one = one.withColumn(c, F.lit(None).cast("double"))
            continue
        low, high = bounds[c]
        counts = df.where((v >= low) & (v <= high)).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
        upto = counts.select("v", (F.sum("n").over(Window.orderBy("v")) + under).alias("upto"))
        middle = lambda k, upto=F.col("upto"): F.min(F.when(upto >= k, F.col("v")))  # noqa: E731  the value of rank k
        one = one.crossJoin(upto.agg(((middle((n + 1) // 2) + middle(n // 2 + 1)) / 2).alias(c)))  # one row each
    return one.drop("id")
