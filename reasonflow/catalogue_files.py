"""Registered queries that write record files to the shared folder and read them back, and joins and selections on such records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived as D
from . import schemas
from .catalogue import query
from .operators import model, prompts, select, shape
from .plans import analyses
from .sources import records
from .sources.shared import new_path


def _samples(a: DataFrame) -> DataFrame:
    """Attempts as records: an entry of one sample of an even problem is written flat, as older files have it."""
    per = shape.nested(a, ["problem_id", "variant"], ["response", "correct"])
    flat = (F.size("samples") == 1) & (F.col("problem_id") % 2 == 0)
    none = F.lit(None)
    entry = F.struct(F.lit("p").alias("problem"), none.cast("string").alias("ground_truth"), F.when(flat, F.col("samples")[0]["response"]).alias("response"), F.when(flat, F.col("samples")[0]["correct"]).alias("correct"), F.when(~flat, F.col("samples")).alias("samples"))
    rows = per.groupBy("problem_id").pivot("variant", schemas.VARIANTS).agg(F.first(entry))
    return rows.select("problem_id", none.cast("string").alias("type"), none.cast("string").alias("level"), *schemas.VARIANTS)


@query(f"{D.ATTEMPTS_SQL} SELECT problem_id, variant, sample_idx, response, correct FROM attempts")
def records_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines, read strictly and opened again: both shapes of entries."""
    path = new_path(spark, "records")
    records.write_jsonl(_samples(D.attempts(spark, d)), path)
    rows = records.read_jsonl(spark, path, schemas.RECORDS, blank_lines=False)
    return shape.attempts(rows).select("problem_id", "variant", "sample_idx", "response", "correct")


LINES = """WITH l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN '{"problem_id": ' || event_id || ', "type"' ELSE '{"problem_id":' || event_id || ',"type":"' || event_type || '"}' END AS line FROM events)"""


@query(f"{LINES} SELECT CASE WHEN event_id % 5 = 1 THEN NULL ELSE event_id END AS problem_id, CASE WHEN event_id % 5 = 1 THEN NULL ELSE (SELECT event_type FROM events e WHERE e.event_id = l.event_id) END AS type, CASE WHEN event_id % 5 = 1 THEN line END AS bad FROM l WHERE event_id % 5 <> 0")
def permissive_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of which some are blank and some are cut off: blank ones are skipped, bad ones keep their text."""
    e = F.col("event_id")
    line = F.when(e % 5 == 0, F.lit("  ")).when(e % 5 == 1, F.concat(F.lit('{"problem_id": '), e.cast("string"), F.lit(', "type"'))).otherwise(F.to_json(F.struct(e.alias("problem_id"), F.col("event_type").alias("type"))))
    path = new_path(spark, "lines")
    D.table(spark, d, "events").select(line.alias("value")).write.text(path)
    return records.read_permissive(spark, path, "problem_id bigint, type string").select("problem_id", "type", F.col("_corrupt_record").alias("bad"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events written in several files by their number, and read in file order."""
    path = new_path(spark, "events")
    rows = D.table(spark, d, "events").select("event_id", "user_id", "event_type")
    # files of very unlike sizes: the first ones are small
    part = F.when(F.col("event_id") < 10, F.col("event_id")).otherwise(F.lit(10) + F.floor(F.col("event_id") / 1000))
    records.write_jsonl(rows.withColumn("p", part).repartitionByRange(7, "p", "event_id").sortWithinPartitions("p", "event_id").drop("p"), path)
    return records.read_jsonl(spark, path, "event_id bigint, user_id bigint, event_type string", position=True)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def file_order_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each user in the order of the files."""
    return records.last_per_key(_events(spark, d), "user_id").select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 25")
def limited_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 records in file order: the limit is the feature."""
    return records.head(_events(spark, d).orderBy("position"), 25).select("event_id", "user_id")


CELL = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE (event_id % 7)::DOUBLE END"


@query(f"SELECT event_id::VARCHAR AS problem_id, 'original_vs_simple' AS comparison, {CELL} AS ged FROM events WHERE {CELL} <= 2 UNION ALL SELECT event_id::VARCHAR, 'original_vs_hard', (event_id % 5)::DOUBLE FROM events WHERE event_id % 5 <= 2")
def similarity_csv(spark: SparkSession, d: str) -> DataFrame:
    """A CSV of similarities with blank and non-numeric cells, read back and cut at a distance."""
    e = F.col("event_id")
    simple = F.when(e % 4 == 0, F.lit(" ")).when(e % 4 == 1, F.lit("n/a")).otherwise((e % 7).cast("string"))
    path = new_path(spark, "similarity")
    D.table(spark, d, "events").select(e.alias("problem_id"), simple.alias("original_vs_simple_ged"), F.concat(F.lit(" "), (e % 5).cast("string"), F.lit(".0")).alias("original_vs_hard_ged")).write.option("header", True).csv(path)
    return select.low_ged(records.read_similarity_csv(spark, path), 2.0)


FILES = f"""{D.ATTEMPTS_SQL},
    r AS (SELECT l_suppkey AS problem_id, variant, ged, correct FROM attempts WHERE variant <> 'original'),
    m AS (SELECT problem_id, variant, printf('%.4f', avg(ged) FILTER (correct)) AS yes, printf('%.4f', avg(ged) FILTER (NOT correct)) AS no FROM r GROUP BY ALL),
    p AS (SELECT DISTINCT problem_id FROM r),
    v AS (SELECT problem_id, variant, rank FROM p, (VALUES ('simple', 0), ('hard', 1)) t(variant, rank)),
    foot AS (
        SELECT problem_id, string_agg('# ' || upper(variant[1]) || variant[2:] || coalesce('|# Correct avg GED,' || yes, '') || coalesce('|# Incorrect avg GED,' || no, ''), '|' ORDER BY rank) AS t
        FROM v LEFT JOIN m USING (problem_id, variant) GROUP BY 1)"""


@query(f"""{FILES} SELECT problem_id, (SELECT count(*) FROM r WHERE r.problem_id = foot.problem_id) + 2 AS n_lines, 'problem_id,variant,ged,correct' AS head, '# Summary Statistics|' || t AS foot FROM foot""")
def files_by_problem(spark: SparkSession, d: str) -> DataFrame:
    """CSV files by problem with their summaries, read back as lines: how many are not of the summary, the first one, and the summary."""
    a = D.by_supplier(spark, d).where("variant <> 'original'").select("problem_id", "variant", "ged", "correct")
    path = new_path(spark, "by-problem")
    records.write_csv_by_problem(a, path)
    lines = records.with_position(spark.read.text(path))
    per = lines.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("position", "value")))["value"].alias("v"))
    mark = lambda x: x.startswith("#")
    return per.select(F.col("problem_id").cast("bigint").alias("problem_id"), F.size(F.filter("v", lambda x: ~mark(x))).cast("bigint").alias("n_lines"), F.col("v")[0].alias("head"), F.array_join(F.filter("v", mark), "|").alias("foot"))


@query(f"{D.ATTEMPTS_SQL} SELECT problem_id, variant, sample_idx, CASE WHEN timed_out THEN 'cut short' WHEN ged > 45 THEN 'too far' END AS error, CASE WHEN timed_out OR ged > 45 THEN 'now' ELSE '' END AS timestamp FROM attempts")
def error_log(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an error go to a log with the time, the others stay."""
    a = D.attempts(spark, d).select("problem_id", "variant", "sample_idx", F.when(F.col("timed_out"), "cut short").when(F.col("ged") > 45, "too far").alias("error"))
    good, log = records.split_errors(a, F.lit("now"))
    return log.unionByName(good.select("*", F.lit(None).cast("string").alias("error"), F.lit("").alias("timestamp")))


@query(f"{D.ATTEMPTS_SQL} SELECT problem_id, variant, sample_idx, ged FROM attempts")
def appended_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run that stopped after the even problems and was started again: each row is there once."""
    a = D.attempts(spark, d).select("problem_id", "variant", "sample_idx", "ged")
    path = new_path(spark, "appended")
    records.append_unfinished(a.where("problem_id % 2 = 0"), path, "problem_id", "variant", "sample_idx")
    records.append_unfinished(a, path, "problem_id", "variant", "sample_idx")
    return spark.read.schema(a.schema).json(path)


@query(f"{D.DAGS_SQL}, c AS (SELECT conv_id, count(*) AS n FROM entries GROUP BY 1) SELECT (conv_id // 3)::VARCHAR AS problem_id, max(n) FILTER (conv_id % 3 = 0) AS original, max(n) FILTER (conv_id % 3 = 1) AS simple, max(n) FILTER (conv_id % 3 = 2) AS hard FROM c GROUP BY 1")
def graphs_by_variant(spark: SparkSession, d: str) -> DataFrame:
    """Batch results written as JSON lines, read back, parsed and put side by side by variant."""
    c = F.col("conv_id")
    variant = F.element_at(F.array(*map(F.lit, schemas.VARIANTS)), (c % 3 + 1).cast("int"))
    key = F.concat_ws("_", F.floor(c / 3).cast("string"), variant, F.lit("0"))
    message = F.struct(F.struct(F.to_json("dag").alias("content")).alias("message"))
    path = new_path(spark, "results")
    records.write_jsonl(D.dags(spark, d).select(key.alias("custom_id"), F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response")), path)
    graphs = analyses.graphs_of_results(records.read_batch_results(spark, path))
    return graphs.groupBy("problem_id").pivot("variant", schemas.VARIANTS).agg(F.max(F.size("dag")).cast("bigint"))


@query(f"{D.ATTEMPTS_SQL} SELECT problem_id, variant, sample_idx, CASE WHEN l_partkey % 3 > 0 THEN ged END AS ged, timed_out FROM attempts WHERE l_partkey % 3 > 0 OR timed_out")
def compared_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples without a distance count only if their search was cut short."""
    return select.compared(D.attempts(spark, d).select("problem_id", "variant", "sample_idx", F.when(F.col("l_partkey") % 3 > 0, F.col("ged")).alias("ged"), "timed_out"))


@query(f"{D.ATTEMPTS_SQL} SELECT variant, sample_idx, response FROM attempts WHERE problem_id = 7")
def one_problem(spark: SparkSession, d: str) -> DataFrame:
    return D.attempts(spark, d).where("problem_id = 7").select("variant", "sample_idx", "response")


@query("SELECT c_custkey % 3 AS g, 'original_vs_' || k AS comparison, c_custkey AS entry FROM customer, (VALUES ('simple'), ('hard')) t(k) WHERE k = 'simple' OR c_custkey % 2 = 0")
def comparison_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a map whose names end in one of the two comparisons."""
    c = F.col("c_custkey")
    named = F.map_from_arrays(F.when(c % 2 == 0, F.array(*map(F.lit, ("note", "original_vs_simple", "original_vs_hard", "simple_vs_x")))).otherwise(F.array(*map(F.lit, ("note", "original_vs_simple", "x", "y")))), F.array(c, c, c, c))
    return records.comparisons(D.table(spark, d, "customer").select((c % 3).alias("g"), named.alias("entries")), keys=("g",))


@query("SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 ORDER BY id")
def union_of_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of either table, once each, in order."""
    a, b = D.table(spark, d, "orders").select(F.col("o_custkey").alias("id")), D.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return a.union(b).distinct().orderBy("id")


@query("WITH c AS (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1) SELECT event_type, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM c")
def frequency_order(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by how often they come, ties by which came first; the rank is for the check of the order."""
    found = select.by_frequency(D.table(spark, d, "events"), "event_type", "event_id")
    return found.coalesce(1).select("event_type", "n", (F.monotonically_increasing_id() + 1).alias("rank"))  # a row a kind


@query(f"""{D.DAGS_SQL}, n AS (SELECT conv_id, count(*) AS n FROM entries GROUP BY 1)
    SELECT conv_id::VARCHAR AS problem_id, conv_id % 2 = 0 AS has_graph, CASE WHEN conv_id % 2 = 0 THEN n END AS n_rows, CASE WHEN conv_id % 2 = 0 THEN 'graph TD' END AS begins FROM n""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Segmented samples, all of them, with the graphs that there are."""
    g = D.dags(spark, d)
    kept = F.lit("original").alias("variant"), F.lit(0).alias("sample_idx")
    samples = g.select(F.col("conv_id").alias("problem_id"), *kept, F.array().cast("array<string>").alias("steps"))
    graphs = g.where("conv_id % 2 = 0").select(F.col("conv_id").cast("string").alias("problem_id"), *kept, "dag")
    rows = analyses.report_rows(samples, graphs)
    return rows.select("problem_id", F.col("dag").isNotNull().alias("has_graph"), F.size(F.split("dependencies", "</tr>", -1)).cast("bigint").alias("n"), F.substring_index("diagram", "\n", 1).alias("begins")).select("problem_id", "has_graph", F.when(F.col("has_graph"), F.col("n") - 1).alias("n_rows"), "begins")


@query("SELECT conv_id || '_original_0' AS custom_id, count(*) AS n FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def requests_of_samples_with_steps(spark: SparkSession, d: str) -> DataFrame:
    """Samples without steps, or with none at all known, make no request."""
    turns = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).cast("int").alias("index"), "text"))).alias("steps"))
    c = F.col("conv_id")
    steps = F.when(c % 6 == 0, F.lit(None)).when(c % 3 == 0, F.slice("steps", 1, 0)).otherwise(F.col("steps"))
    samples = turns.select(c.alias("problem_id"), F.lit("original").alias("variant"), F.lit(0).alias("sample_idx"), F.lit("p").alias("problem"), steps.alias("steps"))
    lines = F.split(F.col("body.messages")[1]["content"], r"\n(?=\[[0-9]+\] )", -1)
    return prompts.batch_requests(samples, "model").select("custom_id", (F.size(lines) - 1).cast("bigint").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
    SELECT conv_id, list({'index': i::INTEGER, 'text': text} ORDER BY turn) AS steps, count(*)::INTEGER AS num_steps FROM t GROUP BY 1""")
def numbered_steps(spark: SparkSession, d: str) -> DataFrame:
    turns = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("t"))
    return turns.select("conv_id", shape.numbered_steps(F.col("t")).alias("steps")).withColumn("num_steps", F.size("steps"))


@query(f"""{D.DAGS_SQL}, e AS (SELECT *, replace(replace(replace(replace(replace(analysis, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS told FROM entries)
    SELECT conv_id, '[' || string_agg('{{"step_id":' || step_id || ',"analysis":"' || told || '","depends_on":["' || array_to_string(deps, '","') || '"],"macro_action_tag":"' || tag || '"}}', ',' ORDER BY ord) || ']' AS json
    FROM e GROUP BY 1""")
def graphs_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Graphs as compact JSON with all characters as they are."""
    return D.dags(spark, d).select("conv_id", F.to_json("dag").alias("json"))


@query("SELECT vec_id, embedding[greatest(1, vec_id % 70)::INTEGER]::DOUBLE AS state FROM (SELECT vec_id, list_concat(embedding, list_transform(range(6), lambda i: 0::FLOAT)) AS embedding FROM embeddings)")
def last_state(spark: SparkSession, d: str) -> DataFrame:
    """The state at the last token that a mask counts; the first if it counts none."""
    e = D.table(spark, d, "embeddings")
    states = F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 6))
    mask = F.transform(F.sequence(F.lit(0), F.lit(69)), lambda i: (i < F.col("vec_id") % 70).cast("int"))
    return e.select("vec_id", model.last_unmasked(states, mask).cast("double").alias("state"))


def _stub(system: str, text: str) -> str:
    """Stands for a model: its reply depends on the prompt alone."""
    import json
    import re

    n = len(re.findall(r"^\[[0-9]+\] ", text, re.MULTILINE))
    c = int(re.search(r"Conversation ([0-9]+)", text)[1])
    if c % 4 == 1:
        raise ValueError("refused")
    if c % 4 == 2:
        return "no list"
    return json.dumps([{"step_id": i + 1, "analysis": "a", "depends_on": [i], "macro_action_tag": "Derive"} for i in range(n - (c % 4 == 3))])


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
    SELECT conv_id AS problem_id, CASE conv_id % 4 WHEN 1 THEN 'refused' WHEN 2 THEN 'JSON parse error' WHEN 3 THEN 'expected ' || n || ' entries, got ' || (n - 1) END AS error, CASE WHEN conv_id % 4 = 0 THEN n END AS n_entries
    FROM n""")
def analysed_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples asked one by one: replies are parsed and checked, errors kept."""
    turns = D.table(spark, d, "conversations")
    text = F.concat(F.lit("x"), F.regexp_replace("text", r"[\[\n]", " "))
    steps = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).cast("int").alias("index"), text.alias("text")))).alias("steps"))
    samples = steps.select(F.col("conv_id").alias("problem_id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("problem"), "steps")
    out = prompts.analyse(samples, _stub, per_minute=10**9, partitions=4)
    return out.select("problem_id", "error", F.size("dag_analysis").cast("bigint").alias("n_entries")).withColumn("n_entries", F.when(F.col("n_entries") >= 0, F.col("n_entries")))


def _answers(problem: str, n: int, temperature: float, top_p: float) -> list[str]:
    k = int(problem.split()[-1])
    return [f"So \\boxed{{{k + i}}}" for i in range(n)]


@query("""WITH p AS (SELECT c_custkey AS problem_id, v AS variant, CASE v WHEN 'original' THEN 1 ELSE 3 END AS n FROM customer, (VALUES ('original'), ('simple'), ('hard')) t(v))
    SELECT problem_id, variant, i::INTEGER AS sample_idx, 'So \\boxed{' || (problem_id + i) || '}' AS response, i = problem_id % 4 AS is_correct FROM (SELECT *, unnest(range(n)) AS i FROM p)""")
def evaluated_problems(spark: SparkSession, d: str) -> DataFrame:
    """Problems sampled by variant, checked and laid out as attempts."""
    c = F.col("c_custkey")
    problems = D.table(spark, d, "customer").select(c.alias("problem_id"), F.explode(F.array(*map(F.lit, schemas.VARIANTS))).alias("variant"), F.concat(F.lit("What is "), c.cast("string")).alias("problem"))
    truth: Column = F.col("problem_id") + F.col("problem_id") % 4
    text = F.when(F.col("variant") == "original", F.concat(F.lit("\\boxed{"), truth.cast("string"), F.lit("}"))).otherwise(truth.cast("string"))
    return analyses.evaluation(problems.withColumn("ground_truth", text), _answers, n=3).select("problem_id", "variant", "sample_idx", "response", "is_correct")
