"""Graphs as tables and graph kernels as columns.

Kernels get whole graphs in Arrow batches, one graph a row, so skew between problems does not
matter: rows are dealt evenly before the heavy ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ged as ged_kernel
from ..functions import graphs as kernel
from ..functions.dagjson import dependency_kind
from ..schemas import DAG, TAGS

ENTRY = "array<struct<step_id:int,merged_ids:array<int>,merged_label:string,macro_action_tag:string,depends_on:array<string>,analysis:string>>"
COMPRESSED = f"struct<nodes_before:int,edges_before:int,nodes_after:int,edges_after:int,absorbed:int,folded:int,rounds:int,skipped:string,ratio:double,dag:{ENTRY},error:string>"
SIMILARITY = "struct<ged:double,similarity_normalized:double,similarity_inverse:double,timed_out:boolean,error:string>"


def edges(entries: DataFrame, key: str, external: bool = True) -> DataFrame:
    """Distinct edges (key, src, dst) of entry rows; nodes are texts: a number or External."""
    rows = entries.select(key, F.explode("depends_on").alias("src"), F.col("step_id").cast("string").alias("dst"))
    return (rows if external else rows.where("src <> 'External'")).distinct()


def nodes(entries: DataFrame, key: str, external: bool = True) -> DataFrame:
    """(key, node, kind, tag) with tag and kind of the first sight of each node.

    The problem is always there.  A step first named as a dependency has no tag.
    """
    step = entries.select(key, F.col("step_id").cast("string").alias("node"), F.struct(F.col("ord"), F.lit(0).alias("within")).alias("at"), "tag")
    dep = entries.select(key, "ord", F.posexplode("depends_on").alias("within", "node")).select(key, "node", F.struct("ord", (F.col("within") + 1).alias("within")).alias("at"), F.lit(None).cast("string").alias("tag"))
    root = entries.select(key).distinct().select(key, F.lit("0").alias("node"), F.struct(F.lit(-1).alias("ord"), F.lit(0).alias("within")).alias("at"), F.lit(None).cast("string").alias("tag"))
    seen = step.unionByName(dep).unionByName(root)
    if not external:
        seen = seen.where("node <> 'External'")
    kind = F.when(F.col("node") == "0", "problem").when(F.col("node") == "External", "external").otherwise("step")
    return seen.groupBy(key, "node").agg(F.min_by(F.struct("tag"), "at")["tag"].alias("tag")).select(key, "node", kind.alias("kind"), "tag")


def longest_paths(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, depth, width) from tables; (0, 0) for cyclic graphs.

    Layers are found in the exact kernel: a recursive query has a row for each path, which
    Spark ends at a million rows of all graphs together.
    """
    steps = nodes.groupBy(key).agg(F.collect_list("node").alias("nodes"))
    links = edges.groupBy(key).agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))
    found = F.pandas_udf(_table_depth_width, "struct<depth:int,width:bigint>")("nodes", "src", "dst")
    return steps.join(links, key, "left").select(key, found.alias("x")).select(key, "x.*")


def _table_depth_width(tables: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for batch in tables:
        out = []
        for nodes, src, dst in zip(*batch, strict=True):
            g = kernel.Graph()
            for node in nodes:
                g.add(node, kernel.Node(None))
            for a, b in zip(_rows(src), _rows(dst), strict=True):
                g.link(a, b)
            out.append(kernel.depth_width(g))
        yield pd.DataFrame(out, columns=["depth", "width"])


def _rows(dag: list | None) -> list[dict]:
    return [] if dag is None else list(dag)


def compress(dag: Column) -> Column:
    """Contraction, then folding, of each graph; a graph that can't be built has ``error`` alone."""
    return F.pandas_udf(_compress, COMPRESSED)(dag)


def _compress(dags: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [f.split(":")[0] for f in "nodes_before edges_before nodes_after edges_after absorbed folded rounds skipped ratio dag error".split()]
    for batch in dags:
        out = []
        for dag in batch:
            row = dict.fromkeys(names)
            try:
                g, stats = kernel.compress(_rows(dag))
                row |= stats | {"dag": kernel.entries(g)}
            except (KeyError, TypeError, ValueError) as e:
                row["error"] = str(e)
            out.append(row)
        yield pd.DataFrame(out, columns=names)


def depth_width(dag: Column) -> Column:
    """struct(depth, width) of each graph, without an implicit problem node."""
    return F.pandas_udf(_depth_width, "struct<depth:int,width:int>")(dag)


def _depth_width(dags: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in dags:
        yield pd.DataFrame([kernel.depth_width(kernel.build(_rows(d), root=False)) for d in batch], columns=["depth", "width"])


def ged_similarity(compressed: bool = True, most: int = 200_000):
    """A function of two graph columns: their edit distance and similarities, after compression or as they are."""

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in pairs:
            out = []
            for a, b in zip(left, right, strict=True):
                row = {"ged": None, "similarity_normalized": None, "similarity_inverse": None, "timed_out": False, "error": None}
                if a is not None and b is not None:
                    try:
                        g, h = ((kernel.compress(_rows(x))[0] if compressed else kernel.build(_rows(x))) for x in (a, b))
                        row |= ged_kernel.similarity(g, h, most)
                    except (KeyError, TypeError, ValueError, RecursionError) as e:
                        row["error"] = str(e)
                out.append(row)
            yield pd.DataFrame(out)

    return F.pandas_udf(run, SIMILARITY)


def ged_lower_bound(n1: Column, e1: Column, n2: Column, e2: Column) -> Column:
    """Operations on nodes leave the number of edges, and the other way round."""
    return F.abs(n1 - n2) + F.abs(e1 - e2)


def feature_vector(dag: Column, depth: Column, width: Column) -> Column:
    """Entries, dependencies, depth, width, entries of each tag and of each kind of dependency."""
    count = lambda keep: F.size(F.filter(dag, keep)).cast("double")
    deps = F.aggregate(dag, F.lit(0), lambda a, e: a + F.size(e["depends_on"])).cast("double")
    def tagged(t: str) -> Column:
        return count(lambda e: F.coalesce(e["macro_action_tag"] == t, F.lit(False)))
    def kind(k: str) -> Column:
        return count(lambda e: dependency_kind(e["depends_on"]) == k)
    return F.array(F.size(dag).cast("double"), deps, depth.cast("double"), width.cast("double"), *map(tagged, TAGS), *map(kind, ("problem", "external", "steps")))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def fold_signatures(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """One round of folding on tables: (key, node, into) for tagged steps with a twin of a lesser number."""
    parents = edges.groupBy(key, F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("parents"))
    children = edges.groupBy(key, F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("children"))
    none = F.array().cast("array<string>")
    rows = nodes.where("kind = 'step' AND tag IS NOT NULL").join(parents, [key, "node"], "left").join(children, [key, "node"], "left")
    rows = rows.select(key, F.col("node").cast("int").alias("node"), "tag", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))
    twin = Window.partitionBy(key, "tag", "parents", "children")
    return rows.withColumn("into", F.min("node").over(twin)).where("node <> `into`").select(key, "node", "into")


def mermaid(dag: Column) -> Column:
    """A diagram of an entry list as text."""
    label = lambda e: F.concat(F.lit("["), e["step_id"].cast("string"), F.lit("]"), F.when(F.coalesce(e["macro_action_tag"], F.lit("")) != "", F.concat(F.lit(" "), e["macro_action_tag"])).otherwise(""))
    boxes = F.transform(dag, lambda e: F.concat(F.lit("    Step"), e["step_id"].cast("string"), F.lit('["'), label(e), F.lit('"]')))
    def arrows(e: Column) -> Column:
        to = F.concat(F.lit("Step"), e["step_id"].cast("string"))
        return F.transform(e["depends_on"], lambda d: F.when(d == "0", F.concat(F.lit("    Problem --> "), to)).when(d == "External", F.concat(F.lit("    External -.-> "), to)).otherwise(F.concat(F.lit("    Step"), d, F.lit(" --> "), to)))
    lines = F.flatten(F.transform(dag, arrows))
    # the outside is declared once, before its first arrow
    at = F.array_position(F.transform(lines, lambda x: x.startswith("    External -.->")), True).cast("int")
    declared = F.when(at > 0, F.concat(F.slice(lines, F.lit(1), at - 1), F.array(F.lit('    External["[Ext] External"]')), F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)))).otherwise(lines)
    return F.array_join(F.concat(F.array(F.lit("graph TD"), F.lit('    Problem["[0] Problem"]')), boxes, declared, F.array(F.lit("    style Problem fill:#e1f5ff"), F.lit("    style External fill:#fff4e1"))), "\n")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def dependency_table(dag: Column) -> Column:
    """An entry list as the rows of an HTML table."""
    row = lambda e: F.concat(F.lit('<tr class="'), dependency_kind(e["depends_on"]), F.lit('"><td>'), e["step_id"].cast("string"), F.lit("</td><td>"), F.coalesce(escape_html(e["macro_action_tag"]), F.lit("")), F.lit("</td><td>"), F.array_join(e["depends_on"], ", "), F.lit("</td><td>"), F.coalesce(escape_html(e["analysis"]), F.lit("")), F.lit("</td></tr>"))
    return F.array_join(F.transform(dag, row), "\n")


def empty_dag() -> Column:
    return F.array().cast(DAG)
