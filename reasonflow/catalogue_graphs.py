"""Registered queries of graph compression and edit distance on graphs whose results SQL can tell.

A conversation's turns make three kinds of graphs: a chain (each step depends on the one before), a
star (each step depends on the problem, so steps of one tag are twins) and small graphs of two
turns each, whose edit distance SQL finds by trying all assignments of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived as D
from .catalogue import query
from .operators import dags
from .plans import analyses
from .schemas import TAGS

STEPS = f"""WITH step AS (SELECT conv_id, turn, (turn + 1)::INTEGER AS s, {TAGS}[length(text) % 3 + 1] AS tag, text AS analysis FROM conversations)"""


def _graphs(spark: SparkSession, d: str, depends: Column, key: Column | None = None, number: Column | None = None) -> DataFrame:
    """conv_id (or ``key``) and dag: turns as steps that depend on ``depends`` (texts)."""
    step = number if number is not None else (F.col("turn") + 1).cast("int")
    tag = F.element_at(F.array(*map(F.lit, TAGS)), F.length("text") % 3 + 1)
    entry = F.struct(step.alias("step_id"), F.col("text").alias("analysis"), depends.alias("depends_on"), tag.alias("macro_action_tag"))
    keys = [F.col("conv_id")] if key is None else [F.col("conv_id"), key.alias("g")]
    return D.table(spark, d, "conversations").groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("dag"))


def _told(entries: Column) -> Column:
    """A compressed graph as text: steps with label, tag, dependencies and analysis."""
    lines = F.transform(entries, lambda e: F.concat_ws("|", e["step_id"].cast("string"), e["merged_label"], e["macro_action_tag"], F.array_join(e["depends_on"], ","), e["analysis"]))
    return F.array_join(lines, "\x02")


def _compressed(graphs: DataFrame) -> DataFrame:
    c = graphs.select("conv_id", dags.compress(F.col("dag")).alias("c"))
    return c.select("conv_id", "c.nodes_before", "c.edges_before", "c.nodes_after", "c.edges_after", "c.absorbed", "c.folded", F.round("c.ratio", 9).alias("ratio"), _told(F.col("c.dag")).alias("steps"))


_COUNTS = "(n + 1)::INTEGER AS nodes_before, n::INTEGER AS edges_before, (m + 1)::INTEGER AS nodes_after, m::INTEGER AS edges_after, {absorbed} AS absorbed, {folded} AS folded, round((m + 1)::DOUBLE / (n + 1), 9) AS ratio, steps"


@query(
    f"""{STEPS},
    cut AS (SELECT *, CASE WHEN lag(tag) OVER w IS DISTINCT FROM tag THEN 1 ELSE 0 END AS b FROM step WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    run AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM cut),
    one AS (SELECT conv_id, r, min(s) AS s, string_agg(s, ',' ORDER BY s) AS label, any_value(tag) AS tag, string_agg(analysis, ' | ' ORDER BY s) AS analysis, count(*) AS k FROM run GROUP BY ALL),
    line AS (SELECT *, s || '|' || label || '|' || tag || '|' || coalesce(lag(s) OVER (PARTITION BY conv_id ORDER BY s), 0) || '|' || analysis AS t FROM one),
    g AS (SELECT conv_id, sum(k) AS n, count(*) AS m, string_agg(t, chr(2) ORDER BY s) AS steps FROM line GROUP BY 1)
    SELECT conv_id, {_COUNTS.format(absorbed="(n - m)::INTEGER", folded="0::INTEGER")} FROM g"""
)
def compress_chains(spark: SparkSession, d: str) -> DataFrame:
    """In a chain, runs of steps with one tag become their first step."""
    return _compressed(_graphs(spark, d, F.array(F.col("turn").cast("string"))))


@query(
    f"""{STEPS},
    one AS (SELECT conv_id, tag, min(s) AS s, string_agg(s, ',' ORDER BY s) AS label, string_agg(analysis, ' | ' ORDER BY s) AS analysis, count(*) AS k FROM step GROUP BY ALL),
    g AS (SELECT conv_id, sum(k) AS n, count(*) AS m, string_agg(s || '|' || label || '|' || tag || '|0|' || analysis, chr(2) ORDER BY s) AS steps FROM one GROUP BY 1)
    SELECT conv_id, {_COUNTS.format(absorbed="0::INTEGER", folded="(n - m)::INTEGER")} FROM g"""
)
def compress_stars(spark: SparkSession, d: str) -> DataFrame:
    """Steps that all depend on the problem alone are folded by tag."""
    return _compressed(_graphs(spark, d, F.array(F.lit("0"))))


@query(f"""{STEPS}, m AS (SELECT conv_id, s AS node, min(s) OVER (PARTITION BY conv_id, tag) AS "into" FROM step) SELECT conv_id, node, "into" FROM m WHERE node <> "into" """)
def fold_once(spark: SparkSession, d: str) -> DataFrame:
    """One round of folding on tables: stars have twins."""
    rows = _graphs(spark, d, F.array(F.lit("0")))
    entries = rows.select("conv_id", F.posexplode("dag").alias("ord", "e")).select("conv_id", "ord", "e.step_id", F.col("e.macro_action_tag").alias("tag"), "e.depends_on")
    return dags.fold_signatures(dags.nodes(entries, "conv_id"), dags.edges(entries, "conv_id"), "conv_id")


#: Two turns a graph: the second step depends on the first or on the problem, and on outside knowledge now and then.
_SMALL = f"""{STEPS},
    mini AS (SELECT conv_id, turn // 2 AS g, (turn % 2 + 1)::INTEGER AS s, tag, CASE WHEN turn % 2 = 0 OR length(analysis) % 2 = 0 THEN '0' ELSE '1' END AS dep, length(analysis) % 5 = 0 AS ext FROM step),
    packed AS (
        SELECT conv_id, g, count(*) AS k, bool_or(s = 2 AND dep = '1') AS chained, bool_or(s = 1 AND ext) AS e1, bool_or(s = 2 AND ext) AS e2, min(tag) = max(tag) AS alike FROM mini GROUP BY ALL),
    merged AS (SELECT *, k = 2 AND alike AND (chained OR e1 = e2) AS gone FROM packed),
    node AS (
        SELECT conv_id, g, '0' AS x, 'problem' AS kind FROM merged UNION ALL SELECT conv_id, g, '1', 'step' FROM merged
        UNION ALL SELECT conv_id, g, '2', 'step' FROM merged WHERE k = 2 AND NOT gone UNION ALL SELECT conv_id, g, 'E', 'external' FROM merged WHERE e1 OR e2),
    edge AS (
        SELECT conv_id, g, '0' AS a, '1' AS b FROM merged UNION ALL SELECT conv_id, g, CASE WHEN chained THEN '1' ELSE '0' END, '2' FROM merged WHERE k = 2 AND NOT gone
        UNION ALL SELECT conv_id, g, 'E', '1' FROM merged WHERE e1 OR (e2 AND gone) UNION ALL SELECT conv_id, g, 'E', '2' FROM merged WHERE e2 AND NOT gone),
    shape AS (
        SELECT n.conv_id, n.g, n.xs, n.kinds, coalesce(e.es, []) AS es FROM (SELECT conv_id, g, list(x ORDER BY x) AS xs, list(kind ORDER BY x) AS kinds FROM node GROUP BY ALL) n
        LEFT JOIN (SELECT conv_id, g, list(a || b ORDER BY a || b) AS es FROM edge GROUP BY ALL) e USING (conv_id, g)),
    slot AS (SELECT unnest(['', '0', '1', '2', 'E']) AS y),
    pair AS ({{pairs}}),
    tried AS (
        SELECT p.*, [p1.y, p2.y, p3.y, p4.y][1 : len(p.xs)] AS t FROM pair p, slot p1, slot p2, slot p3, slot p4
        WHERE (p1.y = '' OR list_contains(p.ys, p1.y)) AND (p2.y = '' OR list_contains(p.ys, p2.y)) AND (p3.y = '' OR list_contains(p.ys, p3.y)) AND (p4.y = '' OR list_contains(p.ys, p4.y))
          AND (len(p.xs) >= 3 OR p3.y = '') AND (len(p.xs) >= 4 OR p4.y = '')
          AND (p1.y = '' OR (p1.y <> p2.y AND p1.y <> p3.y AND p1.y <> p4.y)) AND (p2.y = '' OR (p2.y <> p3.y AND p2.y <> p4.y)) AND (p3.y = '' OR p3.y <> p4.y)),
    cost AS (
        SELECT conv_id, i, xs, ys, es, fs,
               list_sum(list_transform(range(1, len(xs) + 1), lambda n: CASE WHEN t[n] = '' THEN 1 WHEN kinds[n] <> kinds2[list_position(ys, t[n])] THEN 1 ELSE 0 END))
               + len(ys) - len(list_filter(t, lambda y: y <> '')) AS nodes,
               len(list_filter(es, lambda e: t[list_position(xs, e[1])] <> '' AND t[list_position(xs, e[2])] <> '' AND list_contains(fs, t[list_position(xs, e[1])] || t[list_position(xs, e[2])]))) AS kept
        FROM tried),
    ged AS (SELECT conv_id, i, min(nodes + len(es) + len(fs) - 2 * kept)::DOUBLE AS ged, any_value(greatest(len(xs), len(ys)) + greatest(len(es), len(fs))) AS norm FROM cost GROUP BY ALL)"""
_PAIR = "SELECT a.conv_id, b.g AS i, a.xs, a.kinds, a.es, b.xs AS ys, b.kinds AS kinds2, b.es AS fs FROM shape a JOIN shape b ON a.conv_id = b.conv_id AND {on}"


def _small(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, g and dag of graphs of two turns each."""
    second = (F.col("turn") % 2 == 1) & (F.length("text") % 2 == 1)
    depends = F.concat(F.array(F.when(second, "1").otherwise("0")), F.when(F.length("text") % 5 == 0, F.array(F.lit("External"))).otherwise(F.array().cast("array<string>")))
    return _graphs(spark, d, depends, F.floor(F.col("turn") / 2), (F.col("turn") % 2 + 1).cast("int"))


@query(_SMALL.format(pairs=_PAIR.format(on="b.g = a.g + 1")) + " SELECT conv_id, i, ged, round(1 - ged / norm, 4) AS similarity_normalized, round(1 / (1 + ged), 4) AS similarity_inverse FROM ged")
def ged_of_small_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Compressed small graphs against the next one of their conversation; SQL tries every assignment of nodes."""
    g = _small(spark, d)
    b = g.select("conv_id", F.col("g").alias("i"), (F.col("g") - 1).alias("g"), F.col("dag").alias("b"))
    rows = g.withColumnRenamed("dag", "a").join(b, ["conv_id", "g"]).withColumn("s", dags.ged_similarity()("a", "b"))
    return rows.select("conv_id", "i", "s.ged", "s.similarity_normalized", "s.similarity_inverse")


@query(
    _SMALL.format(pairs=_PAIR.format(on="a.g = 0 AND b.g > 0"))
    + """,
    named AS (SELECT conv_id::VARCHAR AS problem_id, CASE WHEN i % 2 = 0 THEN 'hard' ELSE 'simple' END AS variant, i, ged FROM ged),
    best AS (
        SELECT *, max(ged) OVER w - min(ged) OVER w AS span, row_number() OVER (PARTITION BY problem_id, variant ORDER BY CASE WHEN variant = 'simple' THEN ged ELSE -ged END, i) AS rank
        FROM named WINDOW w AS (PARTITION BY problem_id, variant)),
    top AS (SELECT * FROM best WHERE span >= 1 AND rank <= 5),
    ids AS (SELECT DISTINCT problem_id FROM top),
    hashed AS (SELECT problem_id, row_number() OVER (ORDER BY md5('42:' || problem_id), problem_id) AS r, count(*) OVER () AS n FROM ids),
    split AS (SELECT problem_id, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM hashed)
    SELECT problem_id, 'p' AS problem, 'r' AS response, variant AS variant_type, CASE WHEN variant = 'simple' THEN 0.0 ELSE 1.0 END::DOUBLE AS target_alpha, ged AS ged_score, problem_id || '_' || variant || '_' || i AS sample_id, split
    FROM top JOIN split USING (problem_id)"""
)
def training_set_of_small_graphs(spark: SparkSession, d: str) -> DataFrame:
    """From graphs to selected and split training rows: the first graph of a conversation is the original, the others are its variants."""
    g = _small(spark, d)
    graphs = g.select(F.col("conv_id").cast("string").alias("problem_id"), F.when(F.col("g") == 0, "original").when(F.col("g") % 2 == 0, "hard").otherwise("simple").alias("variant"), F.when(F.col("g") > 0, F.col("g")).otherwise(0).alias("sample_idx"), "dag", F.col("g").alias("position"))
    labels = graphs.select("problem_id", "variant", "sample_idx", F.lit("p").alias("problem"), F.lit("r").alias("response"), F.lit(True).alias("correct"))
    return analyses.training_set(analyses.ged_analysis(graphs, labels))
