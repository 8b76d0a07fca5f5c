"""The registered queries and the SQL that checks each.

The tables at hand stand for records: ``lineitem`` for scored attempts, ``events`` for flat
attempts, ``conversations`` for dependency graphs, ``documents`` for responses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import derived as D
from .functions import answers as A
from .functions import equality as E
from .functions import keys as K
from .functions import normalize as N
from .functions import segment as S
from .functions.dagjson import dependency_kind, merge_error, parse_dag, validation_error
from .operators import dags, metrics, model, prompts, select, shape
from .plans import analyses
from .sources import records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


RATIO = "CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {a}::DOUBLE / {b} END"


def _ratio(a: str, b: str) -> str:
    return RATIO.format(a=a, b=b)


GROUPS = f"""{D.ATTEMPTS_SQL},
    grp AS (
        SELECT problem_id, variant, arg_min(correct, sample_idx) AS first, bool_or(correct) AS any_ok,
               count(*) FILTER (correct) AS n_ok, count(*) AS n
        FROM attempts GROUP BY ALL)"""
ACCURACY = f"""SELECT variant, count(*) AS total, {_ratio("count(*) FILTER (first)", "count(*)")} AS first_acc,
        {_ratio("count(*) FILTER (any_ok)", "count(*)")} AS any_acc, {_ratio("sum(n_ok)", "sum(n)")} AS sample_acc
    FROM grp GROUP BY variant"""


@query(f"{GROUPS} {ACCURACY}")
def metrics_by_variant(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(D.attempts(spark, d))


@query(
    f"""{D.ATTEMPTS_SQL},
    grp0 AS (
        SELECT l_partkey % 2 AS run, problem_id, variant, arg_min(correct, sample_idx) AS first, bool_or(correct) AS any_ok,
               count(*) FILTER (correct) AS n_ok, count(*) AS n
        FROM attempts GROUP BY ALL),
    acc AS (
        SELECT run, variant, {_ratio("count(*) FILTER (first)", "count(*)")} AS first_acc,
               {_ratio("count(*) FILTER (any_ok)", "count(*)")} AS any_acc, {_ratio("sum(n_ok)", "sum(n)")} AS sample_acc
        FROM grp0 GROUP BY ALL),
    diff AS (
        SELECT a.variant, a.first_acc - b.first_acc AS f, a.any_acc - b.any_acc AS y, a.sample_acc - b.sample_acc AS s
        FROM acc a JOIN acc b ON a.variant = b.variant AND a.run = 1 AND b.run = 0)
    SELECT variant, round(f, 9) AS first_acc_delta, round(y, 9) AS any_acc_delta, round(s, 9) AS sample_acc_delta,
           printf('%+.2f%%', f * 100) AS first_acc_text, printf('%+.2f%%', y * 100) AS any_acc_text,
           printf('%+.2f%%', s * 100) AS sample_acc_text
    FROM diff"""
)
def metrics_delta(spark: SparkSession, d: str) -> DataFrame:
    a = D.attempts(spark, d)
    out = metrics.delta(metrics.accuracy(a.where("l_partkey % 2 = 1")), metrics.accuracy(a.where("l_partkey % 2 = 0")))
    return out.withColumns({c: D.rounded(F.col(c), 9) for c in out.columns if c.endswith("_delta")})


@query(
    f"""{GROUPS},
    per AS (SELECT problem_id, bool_and(any_ok) AS ok FROM grp GROUP BY 1),
    joined AS (SELECT coalesce(ok, true) AS ok FROM (SELECT DISTINCT o_orderkey AS problem_id FROM orders) LEFT JOIN per USING (problem_id))
    SELECT count(*) AS records, count(*) FILTER (ok) AS passed, {_ratio("count(*) FILTER (ok)", "count(*)")} AS all_variant_any_acc
    FROM joined"""
)
def all_variant_pass(spark: SparkSession, d: str) -> DataFrame:
    problems = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("problem_id"))
    return metrics.all_variants_pass(D.attempts(spark, d), problems)


@query(
    f"""{GROUPS}, per AS (SELECT problem_id, count(*) FILTER (any_ok) = 3 AS ok FROM grp GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (ok) AS all_pass, count(*) FILTER (NOT ok) AS errors FROM per"""
)
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_counters(D.attempts(spark, d))


@query(
    f"""{D.FLAT_SQL}
    SELECT variant, count(*) AS present, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS incorrect
    FROM flat WHERE sample_idx = 0 GROUP BY ROLLUP (variant)"""
)
def response_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.responses(D.flat(spark, d))


@query(
    f"""{D.FLAT_SQL},
    v AS (
        SELECT problem_id, coalesce(bool_or(correct) FILTER (variant = 'original'), false) AS o,
               coalesce(bool_or(correct) FILTER (variant = 'simple'), false) AS s, coalesce(bool_or(correct) FILTER (variant = 'hard'), false) AS h
        FROM flat WHERE sample_idx = 0 GROUP BY 1)
    SELECT problem_id, p AS pattern FROM v, (VALUES ('original_not_simple'), ('original_hard_not_simple'), ('easier_not_hard')) t(p)
    WHERE CASE p WHEN 'original_not_simple' THEN o AND NOT s WHEN 'original_hard_not_simple' THEN o AND NOT s AND h ELSE (o OR s) AND NOT h END"""
)
def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    v = select.verdicts(D.flat(spark, d))
    hits = F.array(*[F.when(select.pattern(p), F.lit(p)) for p in select.PATTERN_NAMES])
    return v.select("problem_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("pattern"))


SUPPLIERS = f"""{D.ATTEMPTS_SQL},
    sup AS (SELECT l_suppkey AS problem_id, variant, correct, ged, timed_out, problem, response, sample_id, position FROM attempts),
    good AS (
        SELECT *, max(ged) OVER g - min(ged) OVER g AS span,
               row_number() OVER (PARTITION BY problem_id, variant ORDER BY CASE WHEN variant = 'simple' THEN ged ELSE -ged END, position) AS rank
        FROM sup WHERE correct AND ged IS NOT NULL AND NOT timed_out WINDOW g AS (PARTITION BY problem_id, variant)),
    top AS (SELECT * FROM good WHERE span >= 1 AND rank <= 5)"""
TRAIN = """SELECT problem_id, problem, response, variant AS variant_type, CASE WHEN variant = 'simple' THEN 0.0 ELSE 1.0 END::DOUBLE AS target_alpha,
    ged AS ged_score, sample_id FROM top"""


@query(f"{SUPPLIERS} {TRAIN}")
def trajectory_topk(spark: SparkSession, d: str) -> DataFrame:
    return select.training_rows(select.top_k(D.by_supplier(spark, d)))


@query(
    f"""{SUPPLIERS},
    g2 AS (
        SELECT problem_id, variant, count(*) FILTER (correct AND NOT timed_out) AS n,
               max(ged) FILTER (correct AND NOT timed_out) - min(ged) FILTER (correct AND NOT timed_out) AS span
        FROM sup GROUP BY ALL),
    r AS (SELECT *, CASE WHEN n = 0 THEN 'no_correct' WHEN span < 1 THEN 'low_range' ELSE 'selected' END AS reason FROM g2)
    SELECT reason, count(*) AS n_groups, sum(CASE WHEN reason = 'selected' THEN least(n, 5) ELSE 0 END)::BIGINT AS n_rows FROM r GROUP BY 1"""
)
def filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    return select.filter_reasons(D.by_supplier(spark, d))


@query(
    f"""{D.ATTEMPTS_SQL},
    p AS (SELECT l_suppkey AS problem_id, variant, position AS sample_idx, ged FROM attempts WHERE NOT timed_out),
    n AS (SELECT *, row_number() OVER (PARTITION BY problem_id, variant ORDER BY sample_idx) AS r FROM p)
    SELECT problem_id, variant, sample_idx, ged FROM n WHERE r <= 20"""
)
def first_n_samples(spark: SparkSession, d: str) -> DataFrame:
    a = D.attempts(spark, d).select(F.col("l_suppkey").alias("problem_id"), "variant", F.col("position").alias("sample_idx"), "ged", F.when(~F.col("timed_out"), F.array(F.lit(1))).alias("dag"))
    return select.first_n(a, 20).drop("dag")


SLICES = f"""{D.ATTEMPTS_SQL},
    s AS (SELECT l_suppkey AS problem_id, ged, position AS sample,
                 row_number() OVER (PARTITION BY l_suppkey ORDER BY ged, position) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n
          FROM attempts WHERE variant = 'simple')"""


@query(
    f"""{SLICES}
    SELECT problem_id, ged, sample, 'low' AS category FROM s WHERE rn <= greatest(1, floor(n * 10 / 100.0))
    UNION ALL SELECT problem_id, ged, sample, 'high' FROM s WHERE rn > n - greatest(1, floor(n * 10 / 100.0))"""
)
def ged_percentile_slices(spark: SparkSession, d: str) -> DataFrame:
    a = D.attempts(spark, d).where("variant = 'simple'").select(F.col("l_suppkey").alias("problem_id"), "ged", F.col("position").alias("sample"))
    return select.percentile_slices(a, "sample", by=["problem_id"])


WIDE = f"""{D.ATTEMPTS_SQL},
    wide AS (SELECT problem_id, min(ged) FILTER (variant = 'simple') AS s, min(ged) FILTER (variant = 'hard') AS h FROM attempts GROUP BY 1)"""


@query(
    f"""{WIDE} SELECT problem_id, 'original_vs_simple' AS comparison, s AS ged FROM wide WHERE s <= 3
    UNION ALL SELECT problem_id, 'original_vs_hard', h FROM wide WHERE h <= 3"""
)
def low_ged(spark: SparkSession, d: str) -> DataFrame:
    a = D.attempts(spark, d)
    wide = a.groupBy("problem_id").agg(*[F.min(F.when(F.col("variant") == v, F.col("ged"))).alias(f"original_vs_{v}_ged") for v in ("simple", "hard")])
    return select.low_ged(wide, 3.0)


@query(f"{D.ATTEMPTS_SQL} SELECT variant, correct, avg(ged) AS mean_ged, count(*) AS n FROM attempts GROUP BY ALL")
def ged_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ged_summary(D.attempts(spark, d))


SPLIT = """ids AS (SELECT DISTINCT c_custkey AS problem_id FROM customer),
    hashed AS (SELECT problem_id, row_number() OVER (ORDER BY md5('42:' || problem_id), problem_id) AS r, count(*) OVER () AS n FROM ids),
    split AS (SELECT problem_id, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM hashed)"""


@query(f"WITH {SPLIT} SELECT * FROM split")
def dataset_split(spark: SparkSession, d: str) -> DataFrame:
    return select.split_ids(D.table(spark, d, "customer").select(F.col("c_custkey").alias("problem_id")))


@query(
    f"""WITH {SPLIT}, rows AS (SELECT o_custkey AS problem_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'simple' ELSE 'hard' END AS v FROM orders)
    SELECT split, coalesce(v, 'unknown') AS variant_type, count(*) AS n FROM rows JOIN split USING (problem_id) GROUP BY ALL"""
)
def split_variant_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = D.table(spark, d, "orders").select(F.col("o_custkey").alias("problem_id"), F.when(F.col("o_orderkey") % 3 == 1, "simple").when(F.col("o_orderkey") % 3 == 2, "hard").alias("variant_type"))
    return metrics.variants_by_split(rows.join(dataset_split(spark, d), "problem_id"))


IDS = """k AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id || '_' || event_type || '_' || (event_id % 7) WHEN 1 THEN user_id || '_' || event_type WHEN 2 THEN 'x' || user_id ELSE NULL END AS custom_id,
        CASE WHEN event_id % 8 = 3 THEN user_id END AS pid FROM events),
    p AS (SELECT event_id, custom_id, coalesce(CASE WHEN contains(custom_id, '_') THEN regexp_extract(custom_id, '^(.*)_[^_]*$', 1) ELSE custom_id END, pid::VARCHAR, '999999') AS problem FROM k),
    n AS (SELECT *, coalesce(try_cast(CASE WHEN regexp_matches(problem, '^-?[0-9]+$') THEN problem END AS BIGINT), try_cast(nullif(regexp_extract(problem, '[0-9]+', 0), '') AS BIGINT), 999999) AS number FROM p)"""


@query(
    f"""WITH {IDS} SELECT event_id, custom_id, problem, number, CASE WHEN regexp_matches(split_part(custom_id, '_', -1), '^[0-9]+$') THEN split_part(custom_id, '_', -1)::INTEGER END AS sample_number FROM n"""
)
def parse_sample_key(spark: SparkSession, d: str) -> DataFrame:
    return D.ids(spark, d).select("event_id", "custom_id", "problem", "number", K.sample_number(F.col("custom_id")).alias("sample_number"))


@query(f"WITH {IDS} SELECT event_id, problem, number, row_number() OVER (ORDER BY number, event_id) AS rank FROM n ORDER BY rank")
def sorted_ids(spark: SparkSession, d: str) -> DataFrame:
    """The rank is for the check of the order; sorting itself needs none."""
    rows = D.ids(spark, d)
    spread = rows.groupBy("number").agg(F.count("*").alias("n"))
    before = spread.select("number", (F.sum("n").over(Window.orderBy("number")) - F.col("n")).alias("before"))
    ranked = rows.join(before, "number").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("number").orderBy("event_id")))
    return ranked.select("event_id", "problem", "number", "rank").orderBy("rank")


@query(f"WITH {IDS} SELECT count(*) AS total, count(DISTINCT problem) AS n_distinct, arg_min(problem, (number, problem)) AS min_id, arg_max(problem, (number, problem)) AS max_id FROM n")
def id_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.id_statistics(D.ids(spark, d), "problem", "number")


@query(f"{D.ATTEMPTS_SQL} SELECT problem_id, variant, sample_idx, response, correct FROM attempts")
def explode_attempts(spark: SparkSession, d: str) -> DataFrame:
    nested = shape.records(D.attempts(spark, d), ["response", "correct"])
    structs = nested.select("problem_id", *[F.when(F.col(v).isNotNull(), F.struct(F.lit(None).cast("string").alias("problem"), F.lit(None).cast("string").alias("ground_truth"), F.lit(None).cast("string").alias("response"), F.lit(None).cast("boolean").alias("correct"), F.col(v).alias("samples"))).alias(v) for v in ("original", "simple", "hard")])
    return shape.attempts(structs).select("problem_id", "variant", "sample_idx", "response", "correct")


@query(
    f"""{D.ATTEMPTS_SQL}
    SELECT problem_id, variant, count(*) AS n, string_agg(response, ';' ORDER BY sample_idx) AS texts FROM attempts GROUP BY ALL"""
)
def renest_attempts(spark: SparkSession, d: str) -> DataFrame:
    per = shape.nested(D.attempts(spark, d), ["problem_id", "variant"], ["response"])
    return per.select("problem_id", "variant", F.size("samples").cast("bigint").alias("n"), F.array_join("samples.response", ";").alias("texts"))


@query(
    f"""{D.ATTEMPTS_SQL}
    SELECT a.problem_id, a.variant, a.sample_idx, coalesce(b.response, '') AS response, b.correct
    FROM attempts a LEFT JOIN (SELECT * FROM attempts WHERE sample_idx % 2 = 0) b USING (problem_id, variant, sample_idx)"""
)
def label_attach(spark: SparkSession, d: str) -> DataFrame:
    a = D.attempts(spark, d)
    labels = a.where("sample_idx % 2 = 0").select("problem_id", "variant", "sample_idx", "response", "correct")
    return analyses.with_labels(a.select("problem_id", "variant", "sample_idx"), labels)


@query(f"{D.ATTEMPTS_SQL} SELECT a.problem_id, a.variant, a.sample_idx AS i, b.sample_idx AS j, a.ged AS a, b.ged AS b FROM attempts a JOIN attempts b USING (problem_id, variant) WHERE a.sample_idx < b.sample_idx")
def pair_join(spark: SparkSession, d: str) -> DataFrame:
    a = D.attempts(spark, d).withColumn("g", F.struct("problem_id", "variant"))
    return metrics.iteration_pairs(a, "g", value="ged").select("g.*", "i", "j", "a", "b")


@query(
    """WITH s AS (SELECT conv_id, string_agg('[' || (turn + 1) || '] ' || text, chr(10) ORDER BY turn) AS lines FROM conversations GROUP BY 1)
    SELECT conv_id || '_original_0' AS custom_id, 'Problem:' || chr(10) || 'Conversation ' || conv_id || chr(10) || chr(10) || 'Steps:' || chr(10) || lines AS prompt, 2::BIGINT AS n_messages FROM s"""
)
def batch_requests(spark: SparkSession, d: str) -> DataFrame:
    turns = D.table(spark, d, "conversations")
    steps = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).cast("int").alias("index"), "text"))).alias("steps"))
    samples = steps.select(F.col("conv_id").alias("problem_id"), F.lit("original").alias("variant"), F.lit(0).alias("sample_idx"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("problem"), "steps")
    return prompts.batch_requests(samples, "model").select("custom_id", F.col("body.messages")[1]["content"].alias("prompt"), F.size("body.messages").cast("bigint").alias("n_messages"))


@query(
    f"""{D.DAGS_SQL}
    SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN 'JSON parse error' END AS dag_error,
           CASE WHEN conv_id % 5 > 1 THEN count(*) END AS n_entries
    FROM entries GROUP BY conv_id"""
)
def merge_batch(spark: SparkSession, d: str) -> DataFrame:
    graphs = D.dags(spark, d)
    text = F.when(F.col("conv_id") % 5 == 1, F.lit("no json here")).otherwise(F.concat(F.lit("```json\n"), F.to_json("dag"), F.lit("\n```")))
    results = graphs.where("conv_id % 5 <> 0").select(F.concat(F.col("conv_id").cast("string"), F.lit("_simple_0")).alias("custom_id"), text.alias("content"), F.lit(1).alias("position"))
    stale = results.select("custom_id", F.lit("[]").alias("content"), F.lit(0).alias("position"))
    samples = graphs.select(F.col("conv_id").alias("problem_id"), F.lit("simple").alias("variant"), F.lit(0).alias("sample_idx"))
    merged = prompts.merge_results(samples, results.unionByName(stale), "model", F.lit("2024-01-01"))
    return merged.select(F.col("problem_id").alias("conv_id"), "dag_error", F.when(F.size("dag_analysis") > 0, F.size("dag_analysis")).cast("bigint").alias("n_entries"))


@query(
    f"""{D.DAGS_SQL},
    g AS (SELECT conv_id, count(*) AS n FROM entries GROUP BY 1)
    SELECT conv_id, CASE conv_id % 4 WHEN 3 THEN NULL WHEN 2 THEN nullif(n - 1, 0) ELSE n END AS n_repaired,
           CASE WHEN conv_id % 4 < 2 THEN n END AS n_strict
    FROM g"""
)
def parse_dag_json(spark: SparkSession, d: str) -> DataFrame:
    whole = F.to_json("dag")
    cut = F.concat(F.regexp_replace(F.to_json(F.slice("dag", F.lit(1), F.size("dag") - 1)), r"\]$", ""), F.lit(',{"step_id":99,"dep'))
    cut = F.when(F.size("dag") == 1, F.lit('[{"step_id":1')).otherwise(cut)
    text = F.when(F.col("conv_id") % 4 == 0, whole).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("  ```json\n"), whole, F.lit("\n```  "))).when(F.col("conv_id") % 4 == 2, cut).otherwise(F.lit('{"a": 1}'))
    n = lambda repair: F.nullif(F.size(parse_dag(F.col("content"), repair)), F.lit(-1)).cast("bigint")
    return D.dags(spark, d).withColumn("content", F.trim(text)).select("conv_id", n(True).alias("n_repaired"), n(False).alias("n_strict"))


@query(
    f"""{D.DAGS_SQL},
    g AS (SELECT conv_id, count(*) AS n, min(step_id) FILTER (tag IS NULL) AS untagged FROM tagged GROUP BY 1)
    SELECT conv_id, CASE WHEN n <> n + (conv_id % 3 = 0)::INTEGER THEN 'expected ' || (n + 1) || ' entries, got ' || n
           WHEN untagged IS NOT NULL THEN 'step ' || untagged || ' has no tag' END AS error
    FROM g"""
)
def validate_dag(spark: SparkSession, d: str) -> DataFrame:
    untag = lambda e: F.struct(e["step_id"].alias("step_id"), e["analysis"].alias("analysis"), e["depends_on"].alias("depends_on"), F.when(e["step_id"] % 4 != 0, e["macro_action_tag"]).alias("macro_action_tag"))
    g = D.dags(spark, d).withColumn("dag", F.transform("dag", untag))
    return g.select("conv_id", validation_error(F.col("dag"), F.size("dag") + (F.col("conv_id") % 3 == 0).cast("int")).alias("error"))


@query(
    r"""WITH s AS (SELECT doc_id, CASE WHEN length(text) <= 300 THEN [text] ELSE list_filter(string_split(regexp_replace(text, '\.\s+([A-Z])', '.' || chr(1) || '\1', 'g'), chr(1)), lambda x: length(trim(x, chr(32) || chr(10) || chr(9) || chr(13))) > 0) END AS p FROM documents)
    SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS i FROM s"""
)
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "documents").select("doc_id", F.posexplode(S.sentence_split(F.col("text"))).alias("i", "sentence")).withColumn("i", F.col("i").cast("bigint"))


@query(
    r"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '') AS p FROM documents),
    f AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, b: CASE WHEN length(a[-1]) < 200 THEN list_concat(a[:-2], [a[-1] || chr(10) || b[1]]) ELSE list_concat(a, b) END) AS s FROM c WHERE len(p) > 0),
    g AS (SELECT doc_id, CASE WHEN len(s) > 1 AND length(s[-1]) < 200 THEN list_concat(s[:-3], [s[-2] || chr(10) || s[-1]]) ELSE s END AS s FROM f)
    SELECT doc_id, len(s)::BIGINT AS n_steps, array_to_string(s, chr(2)) AS steps FROM g"""
)
def short_step_merge(spark: SparkSession, d: str) -> DataFrame:
    out = D.table(spark, d, "documents").select("doc_id", S.merge_short(F.split("text", "\n", -1), 200).alias("s")).where("size(s) > 0")
    return out.select("doc_id", F.size("s").cast("bigint").alias("n_steps"), F.array_join("s", "\x02").alias("steps"))


@query()
def segment_full(spark: SparkSession, d: str) -> DataFrame:
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("problem_id"), F.lit("original").alias("variant"), F.lit(0).alias("sample_idx"), F.col("text").alias("response"))
    return analyses.segmented(docs).drop("response")


@query(
    r"""WITH s AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || '# '), chr(10))) AS x FROM documents),
    n AS (SELECT doc_id, count(*) AS n FROM s WHERE length(trim(x, chr(32) || chr(10) || chr(9) || chr(13))) > 0 GROUP BY 1)
    SELECT count(*) AS samples, sum(n)::BIGINT AS total_steps, sum(n)::DOUBLE / count(*) AS mean_steps FROM n"""
)
def header_totals(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit("\n# ")), S.HEADER, -1), lambda p: ~S.blank(p))
    return metrics.segmentation_totals(D.table(spark, d, "documents").select(parts.alias("steps")).where("size(steps) > 0"))


@query(f"{D.DAGS_SQL} SELECT conv_id, node, kind, tag FROM nodes")
def dag_nodes(spark: SparkSession, d: str) -> DataFrame:
    return dags.nodes(D.entries(spark, d), "conv_id")


@query(f"{D.DAGS_SQL} SELECT conv_id, src, dst FROM edges")
def dag_edges(spark: SparkSession, d: str) -> DataFrame:
    return dags.edges(D.entries(spark, d), "conv_id")


DEPTH = f"""{D.DAGS_REC},
    level AS (
        SELECT conv_id, node, 0 AS d FROM nodes
        UNION SELECT l.conv_id, e.dst, l.d + 1 FROM level l JOIN edges e ON e.conv_id = l.conv_id AND e.src = l.node),
    deepest AS (SELECT conv_id, node, max(d) AS d FROM level GROUP BY ALL),
    wide AS (SELECT conv_id, d, count(*) AS n FROM deepest GROUP BY ALL)
    SELECT conv_id, max(d)::INTEGER AS depth, max(n)::BIGINT AS width FROM wide GROUP BY 1"""


@query(DEPTH)
def dag_depth_width(spark: SparkSession, d: str) -> DataFrame:
    e = D.entries(spark, d)
    return dags.longest_paths(dags.nodes(e, "conv_id"), dags.edges(e, "conv_id"), "conv_id")


@query(DEPTH.replace("max(n)::BIGINT", "max(n)::INTEGER"))
def dag_depth_width_kernel(spark: SparkSession, d: str) -> DataFrame:
    return D.dags(spark, d).select("conv_id", dags.depth_width(F.col("dag")).alias("x")).select("conv_id", "x.*")


@query(
    f"""{D.DAGS_SQL}
    SELECT count(DISTINCT conv_id) AS variants, count(*) AS n_steps, sum(len(deps))::BIGINT AS n_deps, count(*) FILTER (kind = 'problem') AS n_problem,
           count(*) FILTER (kind = 'external') AS n_external, count(*) FILTER (kind = 'steps') AS n_steps_only,
           count(*)::DOUBLE / count(DISTINCT conv_id) AS mean_steps, sum(len(deps))::DOUBLE / count(*) AS mean_deps
    FROM entries"""
)
def dag_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dag_statistics(D.dags(spark, d))


@query(
    f"""{D.DAGS_SQL}
    SELECT tag, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share, count(*) FILTER (kind = 'problem') AS on_problem,
           count(*) FILTER (kind = 'external') AS on_external, count(*) FILTER (kind = 'steps') AS on_steps
    FROM entries WHERE tag IS NOT NULL GROUP BY tag"""
)
def tag_distribution(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tag_distribution(D.entries(spark, d))


@query()
def dag_compress(spark: SparkSession, d: str) -> DataFrame:
    return D.dags(spark, d).select("conv_id", dags.compress(F.col("dag")).alias("c")).select("conv_id", "c.*")


@query(
    """WITH c AS (SELECT l_quantity / 50 AS ratio, (l_linenumber - 1)::BIGINT AS absorbed, l_discount AS before, l_tax AS after FROM lineitem)
    SELECT count(ratio) AS n, round(avg(ratio), 9) AS ratio_mean, median(ratio) AS ratio_median, min(ratio) AS ratio_min, max(ratio) AS ratio_max, round(stddev_samp(ratio), 9) AS ratio_stdev,
           round(avg(absorbed), 9) AS absorbed_mean, sum(absorbed)::BIGINT AS absorbed_total, round(avg(after - before), 9) AS change_mean, round(median(after - before), 9) AS change_median,
           count(*) FILTER (after - before > 0) AS improved, count(*) FILTER (after - before < 0) AS degraded, count(*) FILTER (after - before = 0) AS unchanged
    FROM c"""
)
def compression_effect(spark: SparkSession, d: str) -> DataFrame:
    c = D.table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("ratio"), (F.col("l_linenumber") - 1).cast("bigint").alias("absorbed"), F.col("l_discount").alias("before"), F.col("l_tax").alias("after"))
    out = metrics.compression_effect(c)
    return out.withColumns({n: D.rounded(F.col(n), 9) for n in ("ratio_mean", "ratio_stdev", "absorbed_mean", "change_mean", "change_median")})


@query(
    f"""{D.DAGS_SQL},
    boxes AS (SELECT conv_id, string_agg('    Step' || step_id || '["[' || step_id || '] ' || tag || '"]', chr(10) ORDER BY ord) AS t FROM entries GROUP BY 1),
    deps AS (SELECT conv_id, ord, step_id, unnest(deps) AS dep, unnest(range(len(deps))) AS k FROM entries),
    firsts AS (SELECT *, dep = 'External' AND row_number() OVER (PARTITION BY conv_id, dep ORDER BY ord, k) = 1 AS declares FROM deps),
    arrows AS (
        SELECT conv_id, string_agg(CASE WHEN declares THEN '    External["[Ext] External"]' || chr(10) ELSE '' END ||
               CASE dep WHEN '0' THEN '    Problem --> Step' WHEN 'External' THEN '    External -.-> Step' ELSE '    Step' || dep || ' --> Step' END || step_id, chr(10) ORDER BY ord, k) AS t
        FROM firsts GROUP BY 1)
    SELECT conv_id, 'graph TD' || chr(10) || '    Problem["[0] Problem"]' || chr(10) || b.t || chr(10) || a.t || chr(10) ||
           '    style Problem fill:#e1f5ff' || chr(10) || '    style External fill:#fff4e1' AS diagram
    FROM boxes b JOIN arrows a USING (conv_id)"""
)
def mermaid(spark: SparkSession, d: str) -> DataFrame:
    return D.dags(spark, d).select("conv_id", dags.mermaid(F.col("dag")).alias("diagram"))


@query(
    f"""{D.DAGS_SQL}
    SELECT conv_id, string_agg('<tr class="' || kind || '"><td>' || step_id || '</td><td>' || tag || '</td><td>' || array_to_string(deps, ', ') || '</td><td>' ||
           replace(replace(replace(replace(replace(analysis, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</td></tr>', chr(10) ORDER BY ord) AS html
    FROM entries GROUP BY 1"""
)
def dependency_table(spark: SparkSession, d: str) -> DataFrame:
    return D.dags(spark, d).select("conv_id", dags.dependency_table(F.col("dag")).alias("html"))


@query()
def ged_similarity(spark: SparkSession, d: str) -> DataFrame:
    return D.dag_pairs(spark, d).withColumn("s", dags.ged_similarity()("a", "b")).select("conv_id", "s.*")


@query(
    f"""{D.DAGS_SQL},
    s AS (SELECT n.conv_id, n.n, e.e FROM (SELECT conv_id, count(*) AS n FROM nodes GROUP BY 1) n JOIN (SELECT conv_id, count(*) AS e FROM edges GROUP BY 1) e USING (conv_id))
    SELECT a.conv_id, abs(a.n - b.n) + abs(a.e - b.e) AS lower_bound FROM s a JOIN s b ON b.conv_id = a.conv_id + 1"""
)
def ged_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    e = D.entries(spark, d)
    n = dags.nodes(e, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"))
    s = n.join(dags.edges(e, "conv_id").groupBy("conv_id").agg(F.count("*").alias("e")), "conv_id")
    b = s.select((F.col("conv_id") - 1).alias("conv_id"), F.col("n").alias("n2"), F.col("e").alias("e2"))
    return s.join(b, "conv_id").select("conv_id", dags.ged_lower_bound(F.col("n"), F.col("e"), F.col("n2"), F.col("e2")).alias("lower_bound"))


@query(
    f"""{D.DAGS_REC},
    level AS (
        SELECT conv_id, node, 0 AS d FROM nodes WHERE node <> '0' OR EXISTS (SELECT 1 FROM edges x WHERE x.conv_id = nodes.conv_id AND x.src = '0')
        UNION SELECT l.conv_id, e.dst, l.d + 1 FROM level l JOIN edges e ON e.conv_id = l.conv_id AND e.src = l.node),
    deepest AS (SELECT conv_id, node, max(d) AS d FROM level GROUP BY ALL),
    wide AS (SELECT conv_id, d, count(*) AS n FROM deepest GROUP BY ALL),
    dw AS (SELECT conv_id, max(d) AS depth, max(n) AS width FROM wide GROUP BY 1),
    v AS (
        SELECT conv_id, [count(*)::DOUBLE, sum(len(deps))::DOUBLE, any_value(depth)::DOUBLE, any_value(width)::DOUBLE,
               count(*) FILTER (tag = 'Define')::DOUBLE, count(*) FILTER (tag = 'Recall')::DOUBLE, count(*) FILTER (tag = 'Derive')::DOUBLE,
               count(*) FILTER (tag = 'Calculate')::DOUBLE, count(*) FILTER (tag = 'Verify')::DOUBLE, count(*) FILTER (tag = 'Conclude')::DOUBLE,
               count(*) FILTER (kind = 'problem')::DOUBLE, count(*) FILTER (kind = 'external')::DOUBLE, count(*) FILTER (kind = 'steps')::DOUBLE] AS f
        FROM entries JOIN dw USING (conv_id) GROUP BY conv_id)
    SELECT a.conv_id, round(list_cosine_similarity(a.f, b.f), 6) AS cosine FROM v a JOIN v b ON b.conv_id = a.conv_id + 1"""
)
def feature_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = D.dag_pairs(spark, d).withColumn("x", dags.depth_width(F.col("a"))).withColumn("y", dags.depth_width(F.col("b")))
    f = lambda g, w: dags.feature_vector(F.col(g), F.col(f"{w}.depth"), F.col(f"{w}.width"))
    return rows.select("conv_id", f("a", "x").alias("f"), f("b", "y").alias("g")).select("conv_id", D.rounded(dags.cosine(F.col("f"), F.col("g")), 6).alias("cosine"))


@query(
    f"""{D.ATTEMPTS_SQL},
    pairs AS (SELECT a.problem_id, CASE WHEN a.timed_out OR b.timed_out THEN NULL ELSE 1 - abs(a.ged - b.ged) / 100 END AS s
              FROM attempts a JOIN attempts b USING (problem_id, variant) WHERE a.sample_idx < b.sample_idx AND variant = 'hard'),
    r AS (SELECT problem_id, count(*) AS pairs, count(*) FILTER (s IS NULL) AS failed, avg(s) AS mean, median(s) AS median, stddev_samp(s) AS stdev, min(s) AS min, max(s) AS max FROM pairs GROUP BY ROLLUP (problem_id))
    SELECT problem_id, pairs, failed, round(mean, 9) AS mean, round(median, 9) AS median, round(stdev, 9) AS stdev, round(min, 9) AS min, round(max, 9) AS max,
           CASE WHEN round(mean, 9) > 0.95 THEN 'high' WHEN round(mean, 9) > 0.85 THEN 'moderate' WHEN mean IS NOT NULL THEN 'low' END AS band
    FROM r"""
)
def stability_summary(spark: SparkSession, d: str) -> DataFrame:
    a = D.attempts(spark, d).where("variant = 'hard'").withColumn("v", F.when(~F.col("timed_out"), F.col("ged")))
    pairs = metrics.iteration_pairs(a, value="v").withColumn("similarity", 1 - F.abs(F.col("a") - F.col("b")) / 100)
    return metrics.stability(pairs).withColumns({c: D.rounded(F.col(c), 9) for c in ("mean", "median", "stdev", "min", "max")})


@query(
    r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS k, l_quantity::BIGINT AS q, l_partkey AS p FROM lineitem),
    u AS (SELECT DISTINCT k, q, p % 50 AS p FROM t)
    SELECT k, q, p, CASE k WHEN 0 THEN q::VARCHAR WHEN 1 THEN '\frac{' || q || '}{' || p || '}' WHEN 2 THEN '0.' || p WHEN 3 THEN q::VARCHAR || '\text{ cm}'
        WHEN 4 THEN q || '%' WHEN 5 THEN '\sqrt{' || q || '}' WHEN 6 THEN '\infty' WHEN 7 THEN q::VARCHAR ELSE q || 'i' END AS clean
    FROM u"""
)
def strip_string(spark: SparkSession, d: str) -> DataFrame:
    rows = D.answers(spark, d)
    q, p = F.col("q").cast("string"), F.col("p").cast("string")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    raw = F.element_at(F.array(cat(" ", q, ".000 "), F.when(F.col("p") > 0, cat(q, "/", p)).otherwise(cat("\\dfrac{", q, "}{0}")), cat(".", p), cat("$", q, "\\text{ cm}$"), cat(q, "\\%"), cat("\\sqrt", q), F.lit("infinity."), cat(q, "^{\\circ}"), cat(q, "j")), (F.col("k") + 1).cast("int"))
    return rows.select("k", "q", "p", N.strip_string(raw).alias("clean"))


@query(
    r"""WITH u AS (SELECT DISTINCT l_partkey % 9 AS k, l_quantity::BIGINT AS q, l_partkey % 50 AS p FROM lineitem)
    SELECT k, q, p, CASE WHEN q < 10 THEN '\frac{' || q || '}{' || k || '}+' || p ELSE '\frac{' || (q // 10) || '}{' || (q % 10) || '}' || k || '+' || p END AS clean FROM u"""
)
def fix_fracs(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return D.answers(spark, d).select("k", "q", "p", N.fix_fracs(F.concat(F.lit("\\frac"), s("q"), s("k"), F.lit("+"), s("p"))).alias("clean"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN printf('%.2f', value) WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN '-' || user_id ELSE '' END AS number
    FROM events"""
)
def last_number(spark: SparkSession, d: str) -> DataFrame:
    v, u = F.format_string("%.2f", "value"), F.col("user_id").cast("string")
    text = F.element_at(F.array(F.concat(F.lit("from 1,000 then "), v, F.lit(" in all")), F.concat(F.lit("so "), u, F.lit(".")), F.concat(F.lit("7 and -"), u), F.lit("nothing")), (F.col("event_id") % 4 + 1).cast("int"))
    return D.table(spark, d, "events").select("event_id", A.last_number(text).alias("number"))


@query(
    r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN [user_id::VARCHAR] WHEN 1 THEN ['\frac{' || user_id || '}{7}', 'x'] WHEN 2 THEN ['(1,2)'] ELSE [] END::VARCHAR[] AS found FROM events"""
)
def boxed(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    text = F.element_at(F.array(F.concat(F.lit("so \\boxed {"), u, F.lit("}")), F.concat(F.lit("\\boxed{\\frac{"), u, F.lit("}{7}} and boxed{x}")), F.lit("boxed((1,2))"), F.lit("boxed{1")), (F.col("event_id") % 4 + 1).cast("int"))
    return D.table(spark, d, "events").select("event_id", A.boxed(text).alias("found"))


@query(
    r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN [user_id::VARCHAR, '7'] WHEN 1 THEN ['[' || user_id || ']', 'x'] WHEN 2 THEN ['(' || user_id || ', 7)'] ELSE [user_id::VARCHAR, '8'] END AS found FROM events"""
)
def split_answers(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    text = F.element_at(F.array(F.concat(u, F.lit(", 7")), F.concat(F.lit("["), u, F.lit("] \\text{ and } x")), F.concat(F.lit("("), u, F.lit(", 7)")), F.concat(u, F.lit(" or 8"))), (F.col("event_id") % 4 + 1).cast("int"))
    return D.table(spark, d, "events").select("event_id", A.split_answer(F.when(F.col("event_id") % 4 == 3, "list").otherwise("separated by commas"), text).alias("found"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'placeholder' ELSE chr((65 + user_id % 4)::INTEGER) END AS choice FROM events")
def multi_choice(spark: SparkSession, d: str) -> DataFrame:
    letter = F.char((F.lit(97) + F.col("user_id") % 4).cast("bigint"))
    text = F.when(F.col("event_id") % 5 == 0, F.lit("I don't know")).otherwise(F.concat(F.lit("The Final Answer is ("), letter, F.lit("). Problem: the final answer is (d)")))
    return D.table(spark, d, "events").select("event_id", A.multiple_choice(text).alias("choice"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, CASE l_partkey % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity * 100 WHEN 2 THEN l_quantity / 100 ELSE l_tax END AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           abs(x - y / 100) <= greatest(1e-9 * greatest(abs(x), abs(y / 100)), 1e-7) OR abs(x - y) <= greatest(1e-9 * greatest(abs(x), abs(y)), 1e-7)
           OR abs(x - y * 100) <= greatest(1e-9 * greatest(abs(x), abs(y * 100)), 1e-7) AS same
    FROM p"""
)
def math_equal_numeric(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("l_partkey") % 4 == 0, F.col("l_quantity")).when(F.col("l_partkey") % 4 == 1, F.col("l_quantity") * 100).when(F.col("l_partkey") % 4 == 2, F.col("l_quantity") / 100).otherwise(F.col("l_tax"))
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", E.quick_equal(F.col("l_quantity").cast("string"), y.cast("string")).alias("same"))


@query(f"{D.ATTEMPTS_SQL} SELECT problem_id, variant, sample_idx, l_quantity = l_partkey % 50 + 1 AS is_correct FROM attempts")
def answer_check(spark: SparkSession, d: str) -> DataFrame:
    """Responses in many notations, so that both the built-in and the kernel branch decide."""
    a = D.attempts(spark, d)
    q, t = F.col("l_quantity").cast("bigint").cast("string"), (F.col("l_partkey") % 50 + 1).cast("string")
    said = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("So \\boxed{"), q, F.lit("}"))).otherwise(F.concat(F.lit("\\boxed{x^{"), q, F.lit("}}")))
    truth = F.when(F.col("l_partkey") % 2 == 0, t).otherwise(F.concat(F.lit("x * x^{"), t, F.lit("-1}")))
    rows = a.select("problem_id", F.lit("simple").alias("variant"), F.col("variant").alias("own"), "sample_idx", F.lit("Solve.").alias("problem"), truth.alias("ground_truth"), said.alias("response"))
    return analyses.checked(rows).select("problem_id", F.col("own").alias("variant"), "sample_idx", "is_correct")


@query(
    """WITH e AS (SELECT vec_id, [vec_id, label::BIGINT, 7] AS p, range(vec_id % 9) AS r FROM embeddings), b AS (SELECT vec_id, p, list_concat(p, r)[:8] AS x FROM e)
    SELECT vec_id, list_concat(x, list_transform(range(8 - len(x)), lambda i: 0::BIGINT)) AS input_ids,
           list_concat(list_transform(x, lambda i: 1::BIGINT), list_transform(range(8 - len(x)), lambda i: 0::BIGINT)) AS attention_mask,
           list_concat([-100::BIGINT, -100, -100], x[4:], list_transform(range(8 - len(x)), lambda i: -100::BIGINT)) AS labels
    FROM b"""
)
def pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    e = D.table(spark, d, "embeddings")
    prompt = F.array(F.col("vec_id"), F.col("label").cast("bigint"), F.lit(7).cast("bigint"))
    response = F.when(F.col("vec_id") % 9 > 0, F.sequence(F.lit(0).cast("bigint"), F.col("vec_id") % 9 - 1)).otherwise(F.array().cast("array<bigint>"))
    return e.select("vec_id", model.training_tensors(prompt, response, 8).alias("t")).select("vec_id", "t.input_ids", "t.attention_mask", "t.labels")


W1 = [[0.5 if (i + j) % 3 == 0 else -0.25 for j in range(64)] for i in range(4)]


def _sum64(row: list[float]) -> str:
    return " + ".join(f"embedding[{j + 1}]::DOUBLE * ({w})" for j, w in enumerate(row))


HIDDEN = ", ".join(f"greatest(0.0, {_sum64(r)} + 0.1) AS h{i}" for i, r in enumerate(W1))


@query(f"WITH h AS (SELECT vec_id, {HIDDEN} FROM embeddings) SELECT vec_id, round(1 / (1 + exp(-(h0 * 1.0 + h1 * -1.0 + h2 * 0.5 + h3 * 0.25 - 0.2))), 6) AS alpha FROM h")
def router_score(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "embeddings").select("vec_id", D.rounded(model.router_score(F.col("embedding"), W1, [0.1] * 4, [1.0, -1.0, 0.5, 0.25], -0.2), 6).alias("alpha"))


@query("SELECT vec_id, list_transform(range(1, 65), lambda i: round((1 - label / 10.0::DOUBLE) * embedding[i]::DOUBLE + label / 10.0::DOUBLE * embedding[65 - i]::DOUBLE, 6)) AS prefix FROM embeddings")
def prefix_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed = model.mixed_prefix(F.col("label") / 10.0, F.col("embedding"), F.reverse("embedding"))
    return D.table(spark, d, "embeddings").select("vec_id", F.transform(mixed, lambda x: D.rounded(x, 6)).alias("prefix"))


@query(
    """WITH a AS (SELECT l_quantity / 50 AS alpha, CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE 1.0 END AS target FROM lineitem),
    m AS (SELECT coalesce(avg(alpha) FILTER (target < 0.5), 0.0) AS lo, coalesce(avg(alpha) FILTER (target >= 0.5), 0.0) AS hi FROM a)
    SELECT round(lo, 9) AS low_alpha, round(hi, 9) AS high_alpha, round(hi - lo, 9) AS gap FROM m"""
)
def alpha_gap(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.alpha_gap(D.table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("alpha"), F.when(F.col("l_returnflag") == "A", 0.0).otherwise(1.0).alias("target")))
    return out.select(*[D.rounded(F.col(c), 9).alias(c) for c in out.columns])


@query(
    """WITH a AS (SELECT l_quantity / 50 AS a, CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE 1.0 END AS t, l_tax AS lm FROM lineitem),
    b AS (SELECT lm, -(t * CASE WHEN a <= 0 THEN -100.0 ELSE greatest(-100.0, ln(a)) END + (1 - t) * CASE WHEN 1 - a <= 0 THEN -100.0 ELSE greatest(-100.0, ln(1 - a)) END) AS bce FROM a)
    SELECT round(avg(lm), 9) AS lm_loss, round(avg(bce), 9) AS router_loss, round(avg(lm) + 0.5 * avg(bce), 9) AS loss FROM b"""
)
def router_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = D.table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("alpha"), F.when(F.col("l_returnflag") == "A", 0.0).otherwise(1.0).alias("target"), F.col("l_tax").alias("lm_loss"))
    out = model.training_loss(rows)
    return out.select(*[D.rounded(F.col(c), 9).alias(c) for c in out.columns])


@query("""SELECT run_id::INTEGER AS run_id, w AS weight, p AS prefix FROM (SELECT row_number() OVER (ORDER BY w, p) - 1 AS run_id, w, p FROM (VALUES (0.1::DOUBLE), (0.5), (1.0), (1.5), (2.0)) a(w), (VALUES (5.0::DOUBLE), (20.0), (50.0), (100.0)) b(p))""")
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    return model.parameter_grid(spark, weight=[0.1, 0.5, 1.0, 1.5, 2.0], prefix=[5, 20, 50, 100])


@query(
    f"""{D.ATTEMPTS_SQL}
    SELECT problem_id, variant, sample_idx, CASE WHEN variant = 'original' THEN 1 ELSE 50 END AS n, CASE WHEN variant = 'original' THEN 0.0 ELSE 1.0 END::DOUBLE AS temperature, 1.0::DOUBLE AS top_p,
           coalesce(nullif(CASE WHEN ged > 25 THEN '' ELSE response END, ''), CASE WHEN correct THEN 'yes' END, 'None') AS ground_truth,
           CASE WHEN variant = 'original' THEN 'original' ELSE 'perturb' END AS dataset_type, CASE WHEN length(response) > 12 THEN response[:12] || '...' ELSE response END AS preview
    FROM attempts"""
)
def problem_projection(spark: SparkSession, d: str) -> DataFrame:
    a = D.attempts(spark, d)
    truth = shape.ground_truth(F.when(F.col("ged") > 25, F.lit("")).otherwise(F.col("response")), F.when(F.col("correct"), "yes"))
    p = shape.sampling_parameters(F.col("variant"))
    return a.select("problem_id", "variant", "sample_idx", p.alias("p"), truth.alias("ground_truth"), shape.dataset_type(F.col("variant")).alias("dataset_type"), K.preview(F.col("response"), 12).alias("preview")).select("problem_id", "variant", "sample_idx", "p.*", "ground_truth", "dataset_type", "preview")


@query("SELECT c_custkey, md5('42:' || c_custkey) AS h FROM customer ORDER BY h, c_custkey LIMIT 100")
def random_subset(spark: SparkSession, d: str) -> DataFrame:
    rows = select.random_subset(D.table(spark, d, "customer").select("c_custkey"), 100, "c_custkey")
    return rows.withColumn("h", F.md5(F.concat(F.lit("42:"), F.col("c_custkey").cast("string"))))


@query(f"{D.ATTEMPTS_SQL} SELECT a.* FROM (SELECT problem_id, variant, sample_idx, ged FROM attempts) a SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0) ON o_orderkey = problem_id")
def semi_join_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = D.table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("problem_id"))
    return records.only_ids(D.attempts(spark, d).select("problem_id", "variant", "sample_idx", "ged"), ids)


@query(f"{D.ATTEMPTS_SQL} SELECT problem_id, variant, arg_max(ged, position) AS ged FROM attempts GROUP BY ALL")
def last_record_wins(spark: SparkSession, d: str) -> DataFrame:
    return records.last_per_key(D.attempts(spark, d), "problem_id", "variant").select("problem_id", "variant", "ged")


@query(
    f"""{D.DAGS_SQL}
    SELECT conv_id, step_id, kind, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'JSON parse error' END AS json_error FROM entries"""
)
def dependency_kinds(spark: SparkSession, d: str) -> DataFrame:
    content = F.when(F.col("conv_id") % 3 == 0, F.lit('```json\n{"a": 1}\n```')).otherwise(F.lit("```json\n[1, ```"))
    return D.entries(spark, d).select("conv_id", "step_id", dependency_kind(F.col("depends_on")).alias("kind"), merge_error(content).alias("json_error"))


@query()
def ged_training_set(spark: SparkSession, d: str) -> DataFrame:
    """Graphs of conversations through edit distances to selected and split training rows; 51 conversations, an original and its variants, are a problem."""
    g = D.dags(spark, d).withColumn("p", F.floor(F.col("conv_id") / 51))
    g = g.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("conv_id")) - 1).withColumn("p", F.col("p").cast("string"))
    graphs = g.select(F.col("p").alias("problem_id"), F.when(F.col("i") == 0, "original").when(F.col("i") % 2 == 0, "simple").otherwise("hard").alias("variant"), F.col("i").alias("sample_idx"), "dag", F.col("conv_id").alias("position"))
    labels = graphs.select("problem_id", "variant", "sample_idx", F.lit("p").alias("problem"), F.lit("r").alias("response"), F.lit(True).alias("correct"))
    return analyses.training_set(analyses.ged_analysis(graphs, labels), min_range=0.0)
