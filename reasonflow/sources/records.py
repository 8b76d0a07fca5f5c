"""JSON-lines and CSV sources and sinks.

``position`` orders rows as their files do (file by name, block, place in the block), which
operators use to keep ties stable.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, blank_lines: bool = True, position: bool = False) -> DataFrame:
    """One row a line.  ``strict``: a bad line is an error; otherwise it is left out (see ``read_permissive``).

    Blank lines are skipped, or with ``blank_lines=False`` an error too.  ``position``: adds the column of that name.
    """
    if not strict:
        return read_permissive(spark, path, schema, position).where("_corrupt_record IS NULL").drop("_corrupt_record")
    if blank_lines:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        return with_position(rows) if position else rows
    lines = with_position(spark.read.text(path))
    line = F.when(F.trim("value") == "", F.raise_error(F.lit("a blank line"))).otherwise(F.col("value"))
    rows = lines.select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("r"), "position")
    return rows.select("r.*", *["position"] * position)


def read_permissive(spark: SparkSession, path: str, schema: str, position: bool = False) -> DataFrame:
    """Bad lines keep their text in ``_corrupt_record``, so that they can be counted or logged.  Blank lines are skipped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    lines = with_position(spark.read.text(path)).where(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{schema}, _corrupt_record string", options).alias("r"), "position").select("r.*", *["position"] * position)


def with_position(scan: DataFrame) -> DataFrame:
    """Adds ``position`` to a scan of files: a struct that sorts as the files' names and the rows in them do.

    Spark reads blocks in an order of its own, so a row's number alone doesn't tell where it stands.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return scan.select("*", place.alias("position"))


def head(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows; no limit or 0: all."""
    return df.limit(limit) if limit else df


def last_per_key(df: DataFrame, *keys: str, order: str = "position") -> DataFrame:
    """One row for each key, the last in order."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_per_key(df: DataFrame, *keys: str, order: str = "position") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order))
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def only_ids(df: DataFrame, ids: DataFrame, key: str = "problem_id") -> DataFrame:
    """Rows whose key is among ``ids``; Spark broadcasts these if they are small enough."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def read_similarity_csv(spark: SparkSession, path: str) -> DataFrame:
    """problem_id and both GED columns; blank and non-numeric values are null."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select("problem_id", *[F.expr(f"try_cast(trim(`{c}`) AS double)").alias(c) for c in ("original_vs_simple_ged", "original_vs_hard_ged")])


def comparisons(df: DataFrame, entries: str = "entries", keys: tuple[str, ...] = ("problem_id",)) -> DataFrame:
    """One row for each entry of a map column whose key ends in _vs_simple or _vs_hard: keys, comparison, entry."""
    wanted = F.map_filter(entries, lambda k, _: k.rlike("_vs_(simple|hard)$"))
    return df.select(*keys, F.explode(wanted).alias("comparison", "entry"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


# The lines below the rows of a problem's file, without their numbers.
SUMMARY, RIGHT, WRONG = "# Summary Statistics", "# Correct avg GED,", "# Incorrect avg GED,"


def write_csv_by_problem(df: DataFrame, path: str) -> None:
    """One file a problem: a header, its rows, and a summary of the mean GED by variant of correct and of other rows.

    ``df`` has problem_id, variant, correct and ged, as ``plans.analyses.ged_analysis`` gives them.
    A variant without rows of a kind has no line of it.
    """
    ok = F.coalesce("correct", F.lit(False))
    mean = lambda keep, v: F.avg(F.when(keep & (F.col("variant") == v), F.col("ged")))
    told = lambda x, mark: F.concat(F.lit(mark), F.format_string("%.4f", F.bround(x, 4)))  # noqa: E731  ties go to the even digit
    means = df.groupBy("problem_id").agg(*[mean(k, v).alias(f"{v}_{n}") for v in ("simple", "hard") for n, k in (("right", ok), ("wrong", ~ok))])
    foot = F.array(F.lit(""), F.lit(SUMMARY), *[x for v in ("simple", "hard") for x in (F.lit(f"# {v.capitalize()}"), told(F.col(f"{v}_right"), RIGHT), told(F.col(f"{v}_wrong"), WRONG))])
    head_ = F.array(F.lit(",".join(df.columns)))
    line = lambda part, lines: F.inline(F.transform(lines, lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("nth"), x.alias("value"))))
    ends = means.select("problem_id", line(0, head_)).unionByName(means.select("problem_id", line(2, F.filter(foot, lambda x: x.isNotNull()))))
    rows = df.select("problem_id", F.lit(1).alias("part"), F.lit(0).alias("nth"), F.to_csv(F.struct(*df.columns)).alias("value"))
    lines = ends.unionByName(rows).repartition("problem_id").sortWithinPartitions("problem_id", "part", "nth", "value")
    lines.drop("part", "nth").write.mode("overwrite").partitionBy("problem_id").text(path)


def append_unfinished(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """Appends those rows whose key isn't in ``path`` yet and returns them: a run may stop and be started again."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    todo = df.join(spark.read.schema(df.schema).json(path).select(*keys).distinct(), list(keys), "left_anti") if there else df
    write_jsonl(todo, path, mode="append")
    return todo


def split_errors(df: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, log of the others)."""
    log = df.where("error IS NOT NULL").select("problem_id", "variant", "sample_idx", "error", F.coalesce(now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("timestamp"))
    return df.where("error IS NULL").drop("error"), log


def write_summary(summary: DataFrame, config: dict, path: str) -> None:
    """A small JSON file of the settings and the (few) rows of a summary."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"config": config, "results": [r.asDict(recursive=True) for r in summary.collect()]}, f, indent=2, ensure_ascii=False, default=str)


def segmented_name(path: str) -> str:
    folder, name = os.path.split(path)
    return os.path.join(folder, name.replace("all_records", "segmented_records") if "all_records" in name else f"segmented_{name}")


def report_name(stem: str, comparison: str, category: str) -> str:
    return f"{stem}_{comparison}_{category}.html"


def write_report(df: DataFrame, path: str, title: str, most: int | None = None) -> None:
    """A static page with a table as JSON; ``most``: its first rows alone, else all that the caller chose to show.

    Rows are taken partition by partition and written as they come.
    """
    rows = head(df, most).select(F.to_json(F.struct(*df.columns))).toLocalIterator()
    body = "const rows=JSON.parse(document.getElementById('rows').textContent);const t=document.body.appendChild(document.createElement('table'));for(const r of rows){const tr=t.insertRow();for(const k in r){const c=tr.insertCell();c.title=k;c.textContent=typeof r[k]==='object'?JSON.stringify(r[k]):r[k]}}"
    with open(path if path.endswith(".html") else path + ".html", "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><script type=application/json id=rows>[")
        for i, r in enumerate(rows):
            f.write("," * (i > 0) + r[0].replace("</", "<\\/"))
        f.write(f"]</script><script>{body}</script>")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.RECORDS, position=True)


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    """custom_id, content and position of each result; bad lines are left out."""
    raw = read_jsonl(spark, path, schemas.BATCH_RESULT, strict=False, position=True)
    return raw.select("custom_id", F.col("response.body.choices")[0]["message"]["content"].alias("content"), "position")
