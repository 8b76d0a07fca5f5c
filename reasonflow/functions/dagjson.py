"""Dependency graphs as JSON text in model replies: one parser, with a mode for each known producer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DAG, TAGS


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def unfenced(text: Column) -> Column:
    """Without code fences at the starts and ends of lines."""
    return stripped(F.regexp_replace(F.regexp_replace(text, "(?m)(?d)^```(?:json)?(?U:\\s*)", ""), "(?m)(?d)(?U:\\s*)```$", ""))


def _list(text: Column) -> Column:
    """The list in ``text``; null if it is no JSON list."""
    return F.when(text.startswith("[") & F.try_parse_json(text).isNotNull(), F.from_json(text, DAG))


def parse_dag(content: Column, repair: bool = True) -> Column:
    """The graph of a reply, null if there is none.

    ``repair``: a list cut off in the middle is closed after its last whole object.
    """
    text = unfenced(content)
    fixed = F.concat(F.regexp_extract(text, "(?s)^(.*\\})", 1), F.lit("]"))
    return F.coalesce(_list(text), _list(F.when(text.startswith("["), fixed))) if repair else _list(text)


def merge_error(content: Column) -> Column:
    """Null if the reply is JSON of any kind, else the error to be recorded."""
    text = stripped(F.regexp_replace(F.regexp_replace(stripped(content), "^```(?:json)?", ""), "```$", ""))
    return F.when(F.try_parse_json(text).isNull(), F.lit("JSON parse error"))


def validation_error(dag: Column, n_steps: Column) -> Column:
    """What is wrong with a graph of ``n_steps`` steps; null if nothing is."""
    untagged = F.filter(dag, lambda e: e["macro_action_tag"].isNull())
    unknown = F.filter(dag, lambda e: ~e["macro_action_tag"].isin(TAGS))
    return (
        F.when(F.size(dag) != n_steps, F.format_string("expected %s entries, got %s", n_steps, F.size(dag)))
        .when(F.size(untagged) > 0, F.format_string("step %s has no tag", F.get(untagged, F.lit(0))["step_id"]))
        .when(F.size(unknown) > 0, F.format_string("step %s has the unknown tag %s", F.get(unknown, F.lit(0))["step_id"], F.get(unknown, F.lit(0))["macro_action_tag"]))
    )


def dependency_kind(depends_on: Column) -> Column:
    """problem: on the problem alone; external: on outside knowledge; else steps (none counts as these)."""
    return F.when(depends_on == F.array(F.lit("0")), "problem").when(F.array_contains(depends_on, "External"), "external").otherwise("steps")
