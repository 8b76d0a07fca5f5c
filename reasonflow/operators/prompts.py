"""Requests to a model and what comes back; the model itself is a function that the caller gives."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dagjson import merge_error, parse_dag, validation_error
from ..functions.keys import sample_key
from ..schemas import TAGS

SYSTEM = (
    "You are given a problem and the numbered steps of a solution. For each step give one JSON object with its number (step_id), "
    "a short analysis, the list depends_on of what it uses (0 for the problem itself, a step's number, or \"External\" for outside "
    f"knowledge), and macro_action_tag, one of {', '.join(TAGS)}. Answer with a JSON list of these objects and nothing else."
)


def step_lines(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat(F.lit("["), s["index"].cast("string"), F.lit("] "), s["text"])), "\n")


def prompt(problem: Column, steps: Column) -> Column:
    return F.concat(F.lit("Problem:\n"), problem, F.lit("\n\nSteps:\n"), step_lines(steps))


def batch_requests(samples: DataFrame, model: str, temperature: float = 0.0, top_p: float = 1.0, max_tokens: int = 4096) -> DataFrame:
    """One request (custom_id, method, url, body) for each sample with steps."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(SYSTEM)), message("user", prompt(F.col("problem"), F.col("steps")))).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p"), F.lit(max_tokens).alias("max_tokens"))
    return samples.where("size(steps) > 0").select(sample_key(F.col("problem_id"), F.col("variant"), F.col("sample_idx")).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))


def merge_results(samples: DataFrame, results: DataFrame, model: str, at: Column) -> DataFrame:
    """``samples`` with dag_analysis, dag_error and dag_metadata from results (custom_id, content, position); the last reply to a request counts."""
    from ..sources.records import last_per_key

    replies = last_per_key(results, "custom_id").select("custom_id", "content")
    rows = samples.withColumn("custom_id", sample_key(F.col("problem_id"), F.col("variant"), F.col("sample_idx"))).join(replies, "custom_id", "left")
    error = merge_error(F.col("content"))
    there = F.col("content").isNotNull()
    meta = F.struct(at.alias("analyzed_at"), F.lit(model).alias("model"), F.lit(None).cast("int").alias("processing_time_ms"))
    return rows.withColumns({"dag_analysis": parse_dag(F.col("content")), "dag_error": F.when(there, error), "dag_metadata": F.when(there & error.isNull(), meta)}).drop("content", "custom_id")


@dataclass(frozen=True)
class ModelConfig:
    """Settings of a connection; the key comes from the environment alone."""

    provider: str = "openai"
    model: str = ""
    key: str | None = None
    temperature: float = 0.0
    top_p: float = 1.0
    max_tokens: int = 4096
    timeout: float = 60.0
    per_minute: int = 60
    tries: int = 3

    @classmethod
    def from_env(cls, provider: str = "openai", **settings: float) -> ModelConfig:
        env = os.environ
        named = {"model": env.get("LLM_MODEL", ""), "key": env.get(f"{provider.upper()}_API_KEY")}
        return cls(provider=provider, **named | settings)


class RateLimit:
    """At most ``per_minute`` calls in any 60 seconds."""

    def __init__(self, per_minute: float):
        self.most, self.calls = max(1, int(per_minute)), []

    def wait(self, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.calls = [t for t in self.calls if now() - t < 60]
        if len(self.calls) >= self.most:
            sleep(max(0.0, 60 - (now() - self.calls[0])))
        self.calls.append(now())


def ask(rows: DataFrame, call: Callable[[str, str], str], per_minute: int = 60, tries: int = 3, delay: float = 1.0, partitions: int = 1) -> DataFrame:
    """Adds ``reply``, ``error`` and ``milliseconds`` of ``call(system, user)`` for each ``prompt``.

    The rate is shared out to ``partitions`` tasks.  A TimeoutError or ConnectionError is tried again
    after a growing pause; any other error is recorded at once.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", reply string, error string, milliseconds int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = RateLimit(per_minute / partitions)
        for pdf in batches:
            found = []
            for text in pdf["prompt"]:
                reply = error = None
                began = time.monotonic()
                for n in range(1, tries + 1):
                    limit.wait()
                    try:
                        reply, error = call(SYSTEM, text), None
                        break
                    except (TimeoutError, ConnectionError) as e:
                        error = str(e) or type(e).__name__
                        if n < tries:
                            time.sleep(delay * n)
                    except Exception as e:  # noqa: BLE001  the caller's function may raise anything
                        error = str(e) or type(e).__name__
                        break
                found.append((reply, error, int((time.monotonic() - began) * 1000)))
            yield pdf.assign(reply=[x[0] for x in found], error=[x[1] for x in found], milliseconds=[x[2] for x in found])

    return rows.repartition(partitions).mapInPandas(run, schema)


def analyse(samples: DataFrame, call: Callable[[str, str], str], **options: float) -> DataFrame:
    """``samples`` with steps, asked one by one: adds dag_analysis, error and milliseconds."""
    asked = ask(samples.where("size(steps) > 0").withColumn("prompt", prompt(F.col("problem"), F.col("steps"))), call, **options)
    dag = parse_dag(F.col("reply"))
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(dag.isNull(), "JSON parse error").otherwise(validation_error(dag, F.size("steps")))
    return asked.withColumns({"dag_analysis": F.when(wrong.isNull(), dag), "error": wrong}).drop("prompt", "reply")


def generate(problems: DataFrame, call: Callable[[str, int, float, float], list[str]]) -> DataFrame:
    """Adds ``responses`` of ``call(problem, n, temperature, top_p)`` with the columns of ``sampling``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in problems.schema) + ", responses array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(responses=[call(p, int(s["n"]), float(s["temperature"]), float(s["top_p"])) for p, s in zip(pdf["problem"], pdf["sampling"], strict=True)])

    return problems.mapInPandas(run, schema)
