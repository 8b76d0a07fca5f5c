"""Records derived from the tables at hand, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import keys as K
from .schemas import TAGS

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

ATTEMPTS_SQL = f"""WITH attempts AS (
        SELECT *, problem_id || '_' || variant || '_' || sample_idx AS sample_id, problem_id * 1000 + code * 100 + sample_idx AS position FROM (
            SELECT l_orderkey AS problem_id, CASE l_returnflag WHEN 'A' THEN 'simple' WHEN 'R' THEN 'hard' ELSE 'original' END AS variant,
                   CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS code, l_linestatus = 'F' AS correct, floor(l_quantity) AS ged, l_discount >= 0.1 AS timed_out,
                   'Problem ' || l_orderkey AS problem, 'Part ' || l_partkey || ' by ' || l_suppkey AS response,
                   (row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {", ".join(LINE)}) - 1)::INTEGER AS sample_idx,
                   l_partkey, l_suppkey, l_quantity
            FROM lineitem))"""

FLAT_SQL = """WITH flat AS (
        SELECT user_id AS problem_id, CASE event_type WHEN 'view' THEN 'original' WHEN 'click' THEN 'simple' ELSE 'hard' END AS variant, value > 100 AS correct,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS sample_idx
        FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""

_DAGS = f"""entries AS (
        SELECT *, CASE WHEN deps = ['0'] THEN 'problem' WHEN list_contains(deps, 'External') THEN 'external' ELSE 'steps' END AS kind FROM (
            SELECT conv_id, turn AS ord, (turn + 1)::INTEGER AS step_id, {TAGS}[length(text) % 6 + 1] AS tag, text AS analysis,
                   list_concat(CASE WHEN turn = 0 THEN ['0'] WHEN (turn + 1) % 2 = 0 AND turn + 1 > 2 THEN [turn::VARCHAR, ((turn + 1) // 2)::VARCHAR] ELSE [turn::VARCHAR] END,
                               CASE WHEN length(text) % 5 = 0 THEN ['External'] ELSE [] END) AS deps
            FROM conversations)),
    tagged AS (SELECT conv_id, step_id, CASE WHEN step_id % 4 <> 0 THEN tag END AS tag FROM entries),
    edges AS (SELECT DISTINCT conv_id, unnest(deps) AS src, step_id::VARCHAR AS dst FROM entries),
    nodes AS (
        SELECT conv_id, step_id::VARCHAR AS node, 'step' AS kind, tag FROM entries
        UNION ALL SELECT DISTINCT conv_id, '0', 'problem', NULL FROM entries
        UNION ALL SELECT DISTINCT conv_id, 'External', 'external', NULL FROM edges WHERE src = 'External')"""
DAGS_SQL = f"WITH {_DAGS}"
DAGS_REC = f"WITH RECURSIVE {_DAGS}"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(x: Column, places: int) -> Column:
    """As SQL rounds doubles: the product with a power of ten, half away from zero.  ``F.round`` rounds the decimal text of a double instead."""
    y = x * 10.0**places
    return F.signum(y) * F.round(F.abs(y)) / 10.0**places


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Lines as attempts: an order is a problem, its return flag the variant."""
    flag = F.col("l_returnflag")
    code = F.when(flag == "A", 1).when(flag == "R", 2).otherwise(0)
    variant = F.when(flag == "A", "simple").when(flag == "R", "hard").otherwise("original")
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy(*LINE)) - 1
    text = lambda *x: F.concat(*[F.lit(v) if v.endswith(" ") else F.col(v).cast("string") for v in x])
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("problem_id"), variant.alias("variant"), code.alias("code"), (F.col("l_linestatus") == "F").alias("correct"), F.floor("l_quantity").cast("double").alias("ged"), (F.col("l_discount") >= 0.1).alias("timed_out"),
        text("Problem ", "l_orderkey").alias("problem"), text("Part ", "l_partkey", " by ", "l_suppkey").alias("response"), nth.alias("sample_idx"), "l_partkey", "l_suppkey", "l_quantity",
    )
    return rows.withColumn("sample_id", K.sample_key(F.col("problem_id"), F.col("variant"), F.col("sample_idx"))).withColumn("position", F.col("problem_id") * 1000 + F.col("code") * 100 + F.col("sample_idx"))


def by_supplier(spark: SparkSession, d: str) -> DataFrame:
    """Larger groups: the supplier is the problem."""
    return attempts(spark, d).withColumn("problem_id", F.col("l_suppkey"))


def flat(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) - 1
    rows = table(spark, d, "events").where(kind.isin("view", "click", "purchase"))
    return rows.select(F.col("user_id").alias("problem_id"), F.when(kind == "view", "original").when(kind == "click", "simple").otherwise("hard").alias("variant"), (F.col("value") > 100).alias("correct"), nth.alias("sample_idx"))


def ids(spark: SparkSession, d: str) -> DataFrame:
    """Keys of all shapes with the problem and number read from them."""
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    key = F.when(e % 4 == 0, F.concat_ws("_", u, "event_type", (e % 7).cast("string"))).when(e % 4 == 1, F.concat_ws("_", u, "event_type")).when(e % 4 == 2, F.concat(F.lit("x"), u))
    rows = table(spark, d, "events").select("event_id", key.alias("custom_id"), F.when(e % 8 == 3, F.col("user_id")).alias("pid"))
    rows = rows.withColumn("problem", K.problem_of(F.col("custom_id"), F.col("pid")))
    return rows.withColumn("number", K.numeric_id(F.col("problem"))).drop("pid")


def dags(spark: SparkSession, d: str) -> DataFrame:
    """conv_id and dag: a conversation's turns as the steps of a graph."""
    step = (F.col("turn") + 1).cast("int")
    tags = F.array(*map(F.lit, TAGS))
    t = F.col("turn").cast("string")
    deps = F.when(F.col("turn") == 0, F.array(F.lit("0"))).when((step % 2 == 0) & (step > 2), F.array(t, F.floor(step / 2).cast("string"))).otherwise(F.array(t))
    deps = F.concat(deps, F.when(F.length("text") % 5 == 0, F.array(F.lit("External"))).otherwise(F.array().cast("array<string>")))
    entry = F.struct(step.alias("step_id"), F.col("text").alias("analysis"), deps.alias("depends_on"), F.element_at(tags, F.length("text") % 6 + 1).alias("macro_action_tag"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("dag"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    from .operators.shape import dag_entries

    return dag_entries(dags(spark, d), "conv_id")


def dag_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each graph and that of the next conversation."""
    g = dags(spark, d)
    return g.select("conv_id", F.col("dag").alias("a")).join(g.select((F.col("conv_id") - 1).alias("conv_id"), F.col("dag").alias("b")), "conv_id")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct small numbers k, q and p to write answers with."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 9).alias("k"), F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_partkey") % 50).alias("p")).distinct()
