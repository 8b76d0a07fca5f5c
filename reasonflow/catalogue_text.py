"""Registered queries of the answer extractors and of comparisons between lists of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived as D
from .catalogue import query
from .functions import answers as A
from .functions import equality as E
from .functions import normalize as N
from .functions import segment as S


def _cat(*x: str | Column) -> Column:
    return F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])


def _pick(number: Column, *texts: Column | str) -> Column:
    """One of the texts by a number from 0."""
    return F.element_at(F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts]), (number % len(texts) + 1).cast("int"))


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    return D.table(spark, d, "events"), F.col("event_id"), F.col("user_id").cast("string")


@query(r"SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN '' WHEN 2 THEN 'a ' || user_id ELSE '' END AS output FROM events")
def program_output(spark: SparkSession, d: str) -> DataFrame:
    rows, e, u = _events(spark, d)
    text = _pick(e, _cat("x\n```output\n1\n```\n```output\n", u, "\n```\nend"), "no output", _cat("```output\na ", u), "```python\n5\n```")
    return rows.select("event_id", A.program_output(text).alias("output"))


@query(r"SELECT event_id, CASE event_id % 6 WHEN 0 THEN [user_id::VARCHAR] WHEN 1 THEN ['1', user_id::VARCHAR] WHEN 2 THEN [user_id::VARCHAR] WHEN 3 THEN [user_id::VARCHAR] WHEN 4 THEN ['-' || user_id] ELSE [] END::VARCHAR[] AS found FROM events")
def answer_branches(spark: SparkSession, d: str) -> DataFrame:
    """Each way to state an answer: between dollar signs, in boxes, in words, as output, as the last number, not at all."""
    rows, e, u = _events(spark, d)
    text = _pick(e, _cat("The final answer is $ ", u, " $. I hope it is right; \\boxed{9}"), _cat("\\boxed{1} and \\boxed{:", u, "./}"), _cat("the answer is 1. The answer is: ", u, ".\nnext 8"), _cat("so 3\n```output\n", u, "\n```"), _cat("from 1,000 to -", u), "nothing")
    return rows.select("event_id", A.answers(text).alias("found"))


@query(r"SELECT event_id, CASE event_id % 3 WHEN 0 THEN [user_id::VARCHAR, '2'] WHEN 1 THEN [user_id::VARCHAR] ELSE ['(' || user_id || ',2)'] END AS perturbed, CASE event_id % 3 WHEN 0 THEN [user_id::VARCHAR, '2'] WHEN 1 THEN [user_id::VARCHAR, '5'] ELSE [] END::VARCHAR[] AS few_shot, CASE event_id % 3 WHEN 0 THEN '2' WHEN 1 THEN user_id || '.5' ELSE '[invalid]' END AS gsm FROM events")
def few_shot_answers(spark: SparkSession, d: str) -> DataFrame:
    """Truths of changed problems, and answers that end where the next example begins."""
    rows, e, u = _events(spark, d)
    truth = _pick(e, _cat(u, " or 2"), u, _cat("(", u, ",2)"))
    shot = _pick(e, _cat("\\boxed{", u, "} \\boxed{2} Problem: \\boxed{3}"), _cat("\\boxed{", u, " or 5}"), "no idea Problem: 7")
    gsm = _pick(e, _cat(u, " and 2 Q: 9"), _cat("it is ", u, ".5"), "none Q: 4")
    return rows.select("event_id", A.perturbed_truth(F.lit("Give all."), truth).alias("perturbed"), A.few_shot_math(F.lit("Give all."), shot).alias("few_shot"), A.few_shot_gsm(gsm).alias("gsm"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN '$' || user_id || '$' ELSE 'placeholder' END AS exam, CASE event_id % 3 WHEN 2 THEN ['placeholder'] ELSE [user_id::VARCHAR] END AS cloze, CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN '[invalid]' ELSE user_id::VARCHAR END AS cmath FROM events")
def exam_answers_zh(spark: SparkSession, d: str) -> DataFrame:
    rows, e, u = _events(spark, d)
    exam = _pick(e, _cat("所以答案是 ", u, "\n完"), _cat("答案是$", u, "$\n问题 答案是7"), "不知道")
    cmath = _pick(e, _cat("答案是：3 或 ", u, "。\n4"), "答案是甲", _cat("the answer is ", u, ". 问题：9"))
    return rows.select("event_id", A.exam_zh(exam).alias("exam"), A.exam_zh(exam, cloze=True).alias("cloze"), A.cmath(cmath).alias("cmath"))


@query("SELECT event_id, CASE event_id % 2 WHEN 0 THEN user_id || ' m' ELSE '[invalid]' END AS course, 'lemma ' || user_id AS statement FROM events")
def course_answers(spark: SparkSession, d: str) -> DataFrame:
    rows, e, u = _events(spark, d)
    course = _pick(e, _cat("So the final answer is ", u, " m. I hope it is correct. Problem: the final answer is 1. I hope it is correct."), "the final answer is 3")
    return rows.select("event_id", A.course_answer(course).alias("course"), A.formal_statement(_cat(" lemma ", u, " Informal: so")).alias("statement"))


@query(r"SELECT event_id, 'print(' || user_id || ')' || chr(10) || 'x' || chr(10) AS last, chr(10) || '# ========' || chr(10) || 'a = 1' || chr(10) || chr(10) || '# ========' || chr(10) || 'print(' || user_id || ')' || chr(10) || 'x' || chr(10) AS every FROM events")
def programs(spark: SparkSession, d: str) -> DataFrame:
    rows, _, u = _events(spark, d)
    text = _cat("say\n```python\na = 1\n```\nthen\n```python\nprint(", u, ")\nx\n```\nend")
    return rows.select("event_id", A.program(text).alias("last"), A.program(text, last_only=False).alias("every"))


@query("""WITH t AS (SELECT event_id, user_id, unnest(['gsm8k', 'gsm-hard', 'svamp', 'asdiv', 'mawps', 'math', 'fraction', 'comma', 'percent', 'text']) AS dataset FROM events)
    SELECT event_id, dataset, CASE dataset WHEN 'gsm8k' THEN 'because' WHEN 'gsm-hard' THEN 'code' WHEN 'svamp' THEN '1 + 2' WHEN 'asdiv' THEN '1+2=3' WHEN 'mawps' THEN 'None' WHEN 'math' THEN 'so \\boxed{' || user_id || '}' ELSE 'how' END AS reasoning,
           CASE dataset WHEN 'fraction' THEN (user_id / 4)::DOUBLE::VARCHAR WHEN 'comma' THEN (1000000 + user_id)::VARCHAR WHEN 'percent' THEN '0.5' WHEN 'text' THEN 'yes ' || user_id ELSE user_id::VARCHAR END AS answer
    FROM t WHERE dataset <> 'fraction'""")
def benchmark_truths(spark: SparkSession, d: str) -> DataFrame:
    """Reasoning and answer of benchmark examples, by the fields of each."""
    rows, _, u = _events(spark, d)
    s = lambda **x: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in x.items()])
    tab = lambda a, kind: A.truth_of(s(solution="how", answer=a, ans_type=kind), "tabmwp")
    found = {
        "gsm8k": A.truth_of(s(answer=_cat("because #### ", u)), "gsm8k"), "gsm-hard": A.truth_of(s(code="code", target=F.col("user_id")), "gsm-hard"), "svamp": A.truth_of(s(Equation="1 + 2", Answer=F.col("user_id")), "svamp"),
        "asdiv": A.truth_of(s(formula="1+2=3", answer=_cat(u, " (apples)")), "asdiv"), "mawps": A.truth_of(s(target=F.col("user_id")), "mawps"), "math": A.truth_of(s(solution=_cat("so \\boxed{", u, "}")), "math"),
        "comma": tab(F.format_number(F.col("user_id") + 1000000, 0), "integer_number"), "percent": tab(F.lit("50%"), "decimal_number"), "text": tab(_cat("yes ", u), "extractive_text"),
    }
    long = F.array(*[F.struct(F.lit(k).alias("dataset"), v["reasoning"].alias("reasoning"), v["answer"].alias("answer")) for k, v in found.items()])
    return rows.select("event_id", F.inline(long))


@query("""SELECT event_id, 'Tom has ' || user_id || '. How many?' AS svamp, 'He ran. Why ' || user_id || '?' AS asdiv, CASE WHEN event_id % 2 = 0 THEN 'Q' || user_id ELSE 'P' || user_id END AS plain,
    'Read the following table ' || CASE WHEN event_id % 2 = 0 THEN 'regarding "T" ' ELSE '' END || 'and answer a question:' || chr(10) || 'a|b' || chr(10) || 'Which ' || user_id || '?' || CASE WHEN event_id % 3 = 0 THEN ' Please select from the following options: [''x'', ''y'']' ELSE '' END AS tabmwp FROM events""")
def benchmark_questions(spark: SparkSession, d: str) -> DataFrame:
    rows, e, u = _events(spark, d)
    plain = F.struct(F.when(e % 2 == 0, _cat(" Q", u, " ")).alias("question"), _cat("P", u).alias("problem"))
    table = F.struct(F.when(e % 2 == 0, "T").otherwise("").alias("table_title"), F.lit("a|b").alias("table"), _cat("Which ", u, "?").alias("question"), F.when(e % 3 == 0, F.array(F.lit("x"), F.lit("y"))).alias("choices"))
    return rows.select(
        "event_id", A.question_of(F.struct(_cat("Tom has ", u).alias("Body"), F.lit(" How many? ").alias("Question")), "svamp").alias("svamp"),
        A.question_of(F.struct(F.lit(" He ran. ").alias("body"), _cat("Why ", u, "?").alias("question")), "asdiv").alias("asdiv"), A.question_of(plain, "other", ["question", "problem"]).alias("plain"), A.question_of(table, "tabmwp").alias("tabmwp"),
    )


@query(r"SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN '7' WHEN 2 THEN NULL ELSE NULL END AS answer FROM events")
def run_answers(spark: SparkSession, d: str) -> DataFrame:
    """What a run's program printed, or what the run says; nothing for a failed run."""
    rows, e, u = _events(spark, d)
    text = _pick(e, _cat("```output\n", u, "\n```"), "```output\n 7. \n```", "error", "")
    return rows.select("event_id", A.run_answer(text, "program_only").alias("answer"))


@query(r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '\sqrt{(' || user_id || ')}' WHEN 1 THEN 'x_{1}' || user_id WHEN 2 THEN '0' || user_id || '9' WHEN 3 THEN user_id || '^{2}\cdot \pi ' WHEN 4 THEN '\sqrt[3]{' || user_id || '}' ELSE '\infty -' || user_id || '\frac{1}{2}' END AS plain FROM events""")
def unicode_symbols(spark: SparkSession, d: str) -> DataFrame:
    rows, e, u = _events(spark, d)
    text = _pick(e, _cat("√(", u, ")"), _cat("x₁", u), _cat("𝟬", u, "𝟵"), _cat(u, "²·π"), _cat("∛", u), _cat("∞−", u, "½"))
    return rows.select("event_id", N.plain_symbols(text).alias("plain"))


@query(r"SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id || '.5' WHEN 1 THEN user_id || ',x' ELSE '\frac' || user_id || '2' END AS plain FROM events")
def plain_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows, e, u = _events(spark, d)
    return rows.select("event_id", N.plain_prediction(_pick(e, _cat(u, ".50"), _cat("[", u, ",x]"), _cat("\\frac{", u, "}{2}"))).alias("plain"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN [user_id::VARCHAR, '1'] ELSE ['1', user_id::VARCHAR] END AS found, CASE event_id % 3 WHEN 0 THEN ['2', '3'] WHEN 1 THEN ['1', '2', '3'] ELSE ['3'] END AS last FROM events WHERE user_id > 1")
def distinct_and_last(spark: SparkSession, d: str) -> DataFrame:
    """Answers without those said before, and as many of the last ones as there are truths."""
    rows, e, u = _events(spark, d)
    text = F.when(F.col("user_id") % 2 == 0, _cat("\\boxed{", u, "} \\boxed{1} \\boxed{", u, "}")).otherwise(_cat("\\boxed{1} \\boxed{1} \\boxed{", u, "}"))
    truths = F.when(e % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(e % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    return rows.where("user_id > 1").select("event_id", A.predictions(F.lit("q"), text).alias("found"), E.tail(F.array(*map(F.lit, "123")), truths).alias("last"))


@query("""WITH l AS (SELECT k, q, p, [k, q, p] AS a, CASE (k + q + p) % 4 WHEN 0 THEN [p, k, q] WHEN 1 THEN [q * 100, k, p] WHEN 2 THEN [k, q] ELSE [k, k, q, p] END AS b FROM (SELECT DISTINCT l_partkey % 9 AS k, l_quantity::BIGINT AS q, l_partkey % 50 AS p FROM lineitem))
    SELECT k, q, p, (SELECT bool_and(ok) FROM (SELECT bool_or(x = y OR x = y * 100 OR x * 100 = y) AS ok FROM (SELECT unnest(a) AS x) CROSS JOIN (SELECT unnest(b) AS y) GROUP BY x))
           AND (SELECT bool_and(ok) FROM (SELECT bool_or(x = y OR x = y * 100 OR x * 100 = y) AS ok FROM (SELECT unnest(a) AS x) CROSS JOIN (SELECT unnest(b) AS y) GROUP BY y)) AS same
    FROM l""")
def answer_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of answers, each of which has to fit one of the other list: a matrix of comparisons."""
    k, q, p = (F.col(c) for c in "kqp")
    b = F.when((k + q + p) % 4 == 0, F.array(p, k, q)).when((k + q + p) % 4 == 1, F.array(q * 100, k, p)).when((k + q + p) % 4 == 2, F.array(k, q)).otherwise(F.array(k, k, q, p))
    text = lambda x: F.transform(x, lambda v: v.cast("string"))
    return D.answers(spark, d).select("k", "q", "p", E.lists_match(text(F.array(k, q, p)), text(b)).alias("same"))


@query("""WITH u AS (SELECT DISTINCT l_partkey % 9 AS k, l_quantity::BIGINT AS q, l_partkey % 50 AS p FROM lineitem) SELECT k, q, p, CASE k WHEN 0 THEN true WHEN 1 THEN q = p + 1 WHEN 2 THEN q = p WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN q = p WHEN 7 THEN true ELSE q = p END AS same FROM u""")
def symbolic_equality(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of expressions, equations, names, tuples, unions and matrices, by what they mean."""
    k, q, p = F.col("k"), F.col("q").cast("string"), F.col("p").cast("string")
    one = F.col("p") + 1
    a = _pick(k, _cat("(x+", q, ")^2"), _cat("x^{", q, "}"), _cat("y=", q, "x+1"), _cat("[0,", q, ")\\cup(100,200]"), _cat("\\alpha+", q), _cat("\\begin{pmatrix}", q, "\\\\", p, "\\end{pmatrix}"), _cat("x_{", q, "}"), _cat("\\frac{", q, "}{7}"), _cat("(", q, ",z)"))
    b = _pick(k, _cat("x^2+2*x*", q, "+", q, "*", q), _cat("x*x^{", one.cast("string"), "-1}"), _cat("1+", p, "x-y=0"), _cat("(100,200]\\cup[0,", q, ")"), _cat("n+", q), _cat("\\begin{bmatrix}", q, "\\\\ ", p, "\\end{bmatrix}"), _cat("x_{", p, "}"), _cat(q, "/7"), _cat("(", p, ",z)"))
    return D.answers(spark, d).select("k", "q", "p", E.lists_match(F.array(a), F.array(b)).alias("same"))


_SPLIT = "list_filter(string_split({x}, chr(1)), lambda p: {keep})"
_BLANK = r"NOT regexp_matches(p, '^\s*$')"
_WORDS = S.CONNECTORS.replace("(?:", "(")


def _each(x: str, marked: str, keep: str = _BLANK, own: bool = False, long: bool = False) -> str:
    """SQL of a list of chunks, each cut where ``marked`` puts a mark; ``own``: a chunk that nothing is left of stays; ``long``: only long chunks are cut."""
    parts = _SPLIT.format(x=marked, keep=keep)
    if own:
        parts = f"CASE WHEN len({parts}) = 0 THEN [c] ELSE {parts} END"
    if long:
        parts = f"CASE WHEN length(c) <= {S.THRESHOLD} THEN [c] ELSE {parts} END"
    return f"flatten(list_transform({x}, lambda c: {parts}))"


_TEXT = r"CASE doc_id % 5 WHEN 0 THEN replace(t, '. ', '. Therefore ') WHEN 1 THEN replace(t, '. ', '.' || chr(10) || ' ' || chr(10)) WHEN 2 THEN replace(t, '. ', '.' || chr(10) || '## ') WHEN 3 THEN replace(replace(t, '. ', '.' || chr(10) || '- '), ', ', chr(10) || '12. ') ELSE t END"


@query(
    rf"""WITH t AS (SELECT doc_id, {_TEXT} AS t FROM (SELECT doc_id, replace(replace(text, '$', ''), '\', '') AS t FROM documents)),
    h AS (SELECT doc_id, {_SPLIT.format(x="regexp_replace(t, '(?m)^(#{1,4}" + chr(92) + "s)', chr(1) || '" + chr(92) + "1', 'g')", keep="p <> ''")} AS p FROM t WHERE NOT regexp_matches(t, '^\s*$')),
    b AS (SELECT doc_id, {_each("p", "regexp_replace(c, '" + chr(92) + "n" + chr(92) + "s*" + chr(92) + "n', chr(1), 'g')")} AS p FROM h),
    n AS (SELECT doc_id, {_each("p", "regexp_replace(regexp_replace(c, '(?m)^([0-9]+[.]" + chr(92) + "s)', chr(1) || '" + chr(92) + "1', 'g'), '(?m)^(- )', chr(1) || '" + chr(92) + "1', 'g')", own=True)} AS p FROM b),
    k AS (SELECT doc_id, {_each("p", "regexp_replace(c, '([.]" + chr(92) + "s|" + chr(92) + "n|:" + chr(92) + "s)(" + _WORDS + ")', '" + chr(92) + "1' || chr(1) || '" + chr(92) + "2', 'g')", own=True, long=True)} AS p FROM n),
    s AS (SELECT doc_id, {_each("p", "regexp_replace(c, '[.]" + chr(92) + "s+([A-Z])', '.' || chr(1) || '" + chr(92) + "1', 'g')", own=True, long=True)} AS p FROM k),
    c AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM s),
    f AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, b: CASE WHEN length(a[-1]) < {S.MIN_STEP} THEN list_concat(a[:-2], [a[-1] || chr(10) || b[1]]) ELSE list_concat(a, b) END) AS s FROM c WHERE len(p) > 0),
    g AS (SELECT doc_id, CASE WHEN len(s) > 1 AND length(s[-1]) < {S.MIN_STEP} THEN list_concat(s[:-3], [s[-2] || chr(10) || s[-1]]) ELSE s END AS s FROM f)
    SELECT doc_id, len(s)::BIGINT AS n_steps, array_to_string(s, chr(2)) AS steps FROM g"""
)
def segment_plain(spark: SparkSession, d: str) -> DataFrame:
    """All rules of segmentation but those on formulas, on texts with connectors, blank lines, headers and lists put in; their dollar signs and backslashes go."""
    t, e = F.replace(F.replace("text", F.lit("$"), F.lit("")), F.lit("\\"), F.lit("")), F.col("doc_id") % 5
    put = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    text = F.when(e == 0, put(t, ". ", ". Therefore ")).when(e == 1, put(t, ". ", ".\n \n")).when(e == 2, put(t, ". ", ".\n## ")).when(e == 3, put(put(t, ". ", ".\n- "), ", ", "\n12. ")).otherwise(t)
    out = D.table(spark, d, "documents").select("doc_id", S.segment(text).alias("s")).where("size(s) > 0")
    return out.select("doc_id", F.size("s").cast("bigint").alias("n_steps"), F.array_join("s", "\x02").alias("steps"))
