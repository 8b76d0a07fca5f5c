"""From nested records to long tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import VARIANTS


def ground_truth(solution: Column, answer: Column) -> Column:
    """The solution if there is one, else the answer; the text None if neither."""
    return F.coalesce(F.nullif(solution, F.lit("")), answer, F.lit("None"))


def dataset_type(variant: Column) -> Column:
    return F.when(variant == "original", "original").otherwise("perturb")


def sampling_parameters(variant: Column, n: int = 50, temperature: float = 1.0, top_p: float = 1.0, n_original: int = 1, original_temperature: float = 0.0, original_top_p: float = 1.0) -> Column:
    """struct(n, temperature, top_p) by variant."""
    own = lambda a, b: F.when(variant == "original", F.lit(a)).otherwise(F.lit(b))
    return F.struct(own(n_original, n).alias("n"), own(original_temperature, temperature).alias("temperature"), own(original_top_p, top_p).alias("top_p"))


def variants(df: DataFrame, names: list[str] = VARIANTS) -> DataFrame:
    """One row for each record and present variant: the other columns, ``variant`` and ``entry``."""
    here = [v for v in names if v in df.columns]
    rest = [c for c in df.columns if c not in VARIANTS]
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("entry")) for v in here])
    return df.select(*rest, F.inline(rows)).where("entry IS NOT NULL")


def samples_of(entry: Column) -> Column:
    """The samples of an entry; an old flat entry is its own only sample."""
    flat = F.when(entry["response"].isNotNull() | entry["correct"].isNotNull(), F.array(F.struct(entry["response"].alias("response"), entry["correct"].alias("correct"))))
    return F.coalesce(entry["samples"], flat)


def attempts(records: DataFrame) -> DataFrame:
    """One row a sample: problem_id, variant, sample_idx, problem, ground_truth, response, correct."""
    long = variants(records)
    rows = long.select("problem_id", "variant", F.col("entry.problem").alias("problem"), F.col("entry.ground_truth").alias("ground_truth"), F.posexplode(samples_of(F.col("entry"))).alias("sample_idx", "s"))
    return rows.select("problem_id", "variant", "sample_idx", "problem", "ground_truth", "s.response", "s.correct")


def nested(rows: DataFrame, keys: list[str], values: list[str], order: str = "sample_idx", into: str = "samples") -> DataFrame:
    """Rows of one key gathered into a list of structs in order.  A key's rows are one record's samples, so lists are small."""
    ordered = F.array_sort(F.collect_list(F.struct(order, *values)))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: F.struct(*[x[v].alias(v) for v in values])).alias(into))


def records(rows: DataFrame, values: list[str], key: str = "problem_id") -> DataFrame:
    """Attempts back to one record a problem with a column for each variant."""
    per = nested(rows, [key, "variant"], values)
    return per.groupBy(key).pivot("variant", VARIANTS).agg(F.first("samples"))


def numbered_steps(texts: Column) -> Column:
    """Texts to structs with an index from 1."""
    return F.transform(texts, lambda t, i: F.struct((i + 1).cast("int").alias("index"), t.alias("text")))


def dag_entries(graphs: DataFrame, key: str, dag: str = "dag") -> DataFrame:
    """One row an entry: key, ord, step_id, tag, analysis, depends_on."""
    return graphs.select(key, F.posexplode(dag).alias("ord", "e")).select(key, "ord", "e.step_id", F.col("e.macro_action_tag").alias("tag"), "e.analysis", "e.depends_on")
