"""Array maths around the trained router: rows to train on, scores and losses."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED = -100


def pad(x: Column, n: int, value: int) -> Column:
    """The first n values, filled up with ``value`` on the right."""
    cut = F.slice(x, 1, n)
    return F.concat(cut, F.array_repeat(F.lit(value).cast("bigint"), F.lit(n) - F.size(cut)))


def training_tensors(prompt: Column, response: Column, n: int, pad_id: int = 0) -> Column:
    """struct of ids, masks and labels of length n; the prompt's labels are left out of the loss."""
    both = F.slice(F.concat(prompt, response), 1, n)
    masked = F.transform(both, lambda x, i: F.when(i < F.size(prompt), F.lit(IGNORED).cast("bigint")).otherwise(x))
    ones = lambda x: F.transform(F.slice(x, 1, n), lambda _: F.lit(1).cast("bigint"))
    return F.struct(pad(both, n, pad_id).alias("input_ids"), pad(ones(both), n, 0).alias("attention_mask"), pad(masked, n, IGNORED).alias("labels"), pad(prompt, n, pad_id).alias("prompt_input_ids"), pad(ones(prompt), n, 0).alias("prompt_attention_mask"))


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def router_score(x: Column, w1: list[list[float]], b1: list[float], w2: list[float], b2: float) -> Column:
    """A linear layer, its positive part, a linear layer and a sigmoid."""
    hidden = F.array(*[F.greatest(F.lit(0.0), dot(x, F.array(*map(F.lit, row))) + b) for row, b in zip(w1, b1, strict=True)])
    return 1 / (1 + F.exp(-(dot(hidden, F.array(*map(F.lit, w2))) + b2)))


def mixed_prefix(alpha: Column, p0: Column, p1: Column) -> Column:
    return F.zip_with(p0, p1, lambda a, b: (1 - alpha) * a.cast("double") + alpha * b.cast("double"))


def last_unmasked(states: Column, mask: Column) -> Column:
    """The state of the last token that counts; the first if none does."""
    return F.element_at(states, F.greatest(F.lit(1), F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int"))))


def cross_entropy(alpha: Column, target: Column) -> Column:
    """Logarithms are not less than -100."""
    log = lambda x: F.when(x <= 0, F.lit(-100.0)).otherwise(F.greatest(F.lit(-100.0), F.log(x)))
    return -(target * log(alpha) + (1 - target) * log(1 - alpha))


def training_loss(df: DataFrame, weight: float = 0.5) -> DataFrame:
    """Mean language loss, mean cross entropy of alpha against target, and their weighted sum."""
    bce = F.avg(cross_entropy(F.col("alpha"), F.col("target")))
    return df.agg(F.avg("lm_loss").alias("lm_loss"), bce.alias("router_loss"), (F.avg("lm_loss") + weight * bce).alias("loss"))


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of a few settings, with a run id."""
    names = list(values)
    rows = [(i, *map(float, x)) for i, x in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, "run_id int, " + ", ".join(f"{n} double" for n in names))
