"""Keys of problems and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = 999999


def sample_key(problem_id: Column, variant: Column, sample_idx: Column) -> Column:
    return F.concat_ws("_", problem_id.cast("string"), variant, sample_idx.cast("string"))


def problem_of(custom_id: Column, problem_id: Column | None = None) -> Column:
    """What stands before the last underscore of the key (all of it if there is none), else the id, else 999999."""
    given = F.when(custom_id.contains("_"), F.regexp_extract(custom_id, "(?s)^(.*)_[^_]*$", 1)).otherwise(custom_id)
    return F.coalesce(given, *([problem_id.cast("string")] if problem_id is not None else []), F.lit(str(UNKNOWN)))


def numeric_id(key: Column) -> Column:
    """The key as a number, else its first run of digits, else 999999."""
    first = F.nullif(F.regexp_extract(key, "\\d+", 0), F.lit(""))
    return F.coalesce(key.try_cast("bigint"), first.try_cast("bigint"), F.lit(UNKNOWN)).cast("bigint")


def sample_number(custom_id: Column) -> Column:
    return F.element_at(F.split(custom_id, "_"), -1).try_cast("int")


def key_parts(custom_id: Column) -> Column:
    """struct(problem_id, variant, sample_idx) of a key with or without a sample number."""
    p = "^(.+)_(original|simple|hard)(?:_(\\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(custom_id, p, i), F.lit(""))
    return F.struct(part(1).alias("problem_id"), part(2).alias("variant"), part(3).try_cast("int").alias("sample_idx"))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
