"""Golden cases of the text functions; expected values are worked out by hand from the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reasonflow.functions import answers as A
from reasonflow.functions import equality as E
from reasonflow.functions import keys as K
from reasonflow.functions import normalize as N
from reasonflow.functions import segment as S
from reasonflow.functions.dagjson import merge_error, parse_dag, validation_error


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


STEPS = {
    None: [],
    " \n ": [],
    "First we define x as the unknown value.\n\nThen we compute x = 4 by solving.": ["First we define x as the unknown value.", "Then we compute x = 4 by solving."],
    "Short.\n\nThis sentence is certainly longer than twenty.": ["Short.\nThis sentence is certainly longer than twenty."],
    "This first step is long enough here.\n\nDone.": ["This first step is long enough here.\nDone."],
    "We write the equation below:\n\n\\[ x = 1 \\]\n\nand continue with the next part.": ["We write the equation below:\n\\[ x = 1 \\]", "and continue with the next part."],
    "# Title of part one here\ntext\n## Part two of the answer\nmore": ["# Title of part one here\ntext", "## Part two of the answer\nmore"],
    "1. compute the first value now\n2. compute the second value now": ["1. compute the first value now", "2. compute the second value now"],
    "- alpha is the first item here\n- beta is the second item here": ["- alpha is the first item here", "- beta is the second item here"],
}


def test_segments(spark):
    assert apply(spark, S.segment, list(STEPS)) == list(STEPS.values())


def test_long_paragraphs_split_before_connectors_and_sentences(spark):
    text = "We know that " + "a" * 290 + ". Therefore it holds for now. Next we go on " + "b" * 300 + ". Final words stand here now."
    steps = apply(spark, S.segment, [text])[0]
    assert [s[:9] for s in steps] == ["We know t", "Therefore", "Next we g", "Final wor"]
    assert "".join("".join(steps).split()) == "".join(text.split())


def test_formulas_are_not_split(spark):
    text = "We use \\[ a\n\nb \\] as it stands, with $$c\n\nd$$ and \\(e\n\nf\\) all in one step."
    assert "\x00" not in "".join(apply(spark, S.segment, [text])[0])
    assert sum("a\n\nb" in s for s in apply(spark, S.segment, [text])[0]) == 1


CLEAN = {
    "\\dfrac12": "\\frac{1}{2}", "3/4": "\\frac{3}{4}", "x\\in[0,1)": "[0,1)", "5.000": "5", ".5": "0.5", "10\\text{ cm}": "10", "2^{\\circ}": "2", "\\$50": "50",
    "3j": "3i", "\\sqrt3": "\\sqrt{3}", "50\\%": "50%", "": "", "\\frac1": "\\frac1", "\\text{yes}": "yes", "12 t": "12", "-3/4": "\\frac{-3}{4}", "03/4": "03/4",
    "√(x)": "\\sqrt{(x)}", "½": "\\frac{1}{2}", "x₂": "x_{2}", "infinity": "\\infty", " 7. ": "7", "'a'": "'a'", "\\left(1\\right)": "(1)", "9 p.m.": "9 p.m",
}


def test_strip_string(spark):
    assert apply(spark, N.strip_string, list(CLEAN)) == list(CLEAN.values())
    assert apply(spark, N.strip_string, [None]) == [None]


def test_numbers(spark):
    cases = {"1,234.5": 1234.5, "18{,}000": 18000.0, "50%": 0.5, "50\\%": 0.5, "1e3": 1000.0, "x": None, "": None, None: None, "-.5": -0.5, "1_000": 1000.0, "inf": float("inf")}
    assert apply(spark, N.parse_number, list(cases)) == list(cases.values())




BOXES = {"\\boxed{1+\\frac{1}{2}}": ["1+\\frac{1}{2}"], "\\boxed {3}": ["3"], "boxed{1} and boxed{2}": ["1", "2"], "boxed{50}%": ["50}"], "boxed(3,4)": ["3,4"], "boxed{1": [], "": []}


def test_boxes(spark):
    cases = BOXES
    assert apply(spark, A.boxed, list(cases)) == list(cases.values())


def test_answers(spark):
    cases = {"the answer is 42.": "42", "values 1,234 then 7.5": "7.5", "nothing": "", "The final answer is $x$. I hope it": "x", "```output\n5\n```": "5", "so \\boxed{2} or \\boxed{3}": "3", "the answer is: 7/": "7"}
    assert apply(spark, A.answer, list(cases)) == list(cases.values())


def test_exam_answers(spark):
    assert apply(spark, A.multiple_choice, ["The final answer is (B).", "none", "Problem: the final answer is a"]) == ["B", "placeholder", "placeholder"]
    assert apply(spark, A.few_shot_gsm, ["so 3 and 4.5 Q: 9", "no"]) == ["4.5", "[invalid]"]
    assert apply(spark, A.course_answer, ["final answer is 5. I hope it is correct.", "5"]) == ["5", "[invalid]"]
    assert apply(spark, A.cmath, ["答案是：12。", "答案是x", "the answer is 3"]) == ["12", "[invalid]", "3"]
    assert apply(spark, lambda x: A.exam_zh(x, cloze=True), ["答案是$3$\nx", "y"]) == [["3"], ["placeholder"]]
    assert apply(spark, A.formal_statement, [" a Informal: b"]) == ["a"]
    assert apply(spark, A.program, ["x\n```python\na\n```\n```python\nb\nc\n```\nd"]) == ["b\nc\n"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("50%", "0.5", True), ("50", "0.5", True), ("1,000", "1000", True), ("3", "4", False), ("(1, 2)", "(1,2)", True), ("x=5", "5", True), ("", "5", False),
        ("1 - \\sqrt[4]{x + 1}", "1 - (x + 1)^{\\frac14}", True), ("\\frac{1}{2}", "0.5", True), ("2x", "x*2", True), ("x+1", "x+2", False), ("\\begin{pmatrix}1\\\\2\\end{pmatrix}", "\\begin{bmatrix}1\\\\ 2\\end{bmatrix}", True),
        ("y=2x", "2x-y=0", True), ("\\sin^2 x + \\cos^2 x", "1", True), ("abc def", "abc deg", False), ("\\pi/2", "\\frac{\\pi}{2}", True),
    ],
)
def test_equal(a, b, same):
    assert E.equal(a, b) is same


def test_lists_cover_each_other():
    assert E.all_match(["1", "2"], ["2", "1"])
    assert not E.all_match(["1"], ["1", "2"])
    assert E.all_match([], [])
    assert not E.all_match(["5"], [])
    assert E.matches("[0,1)\\cup(2,3]", "(2,3]\\cup[0,1)")


def test_tail(spark):
    rows = spark.createDataFrame([(["3", "1", "2"], ["1", "2"]), (["5"], []), (["1"], ["1", "2"])], "p array<string>, a array<string>")
    assert [r[0] for r in rows.select(E.tail(F.col("p"), F.col("a"))).collect()] == [["1", "2"], ["5"], ["1"]]


def test_keys(spark):
    assert apply(spark, K.problem_of, ["12_simple_3", "12", None]) == ["12_simple", "12", "999999"]
    assert apply(spark, K.numeric_id, ["12_simple", "x", "7"]) == [12, 999999, 7]
    assert [tuple(x) for x in apply(spark, K.key_parts, ["12_simple_3", "a_b_hard", "zz"])] == [("12", "simple", 3), ("a_b", "hard", None), (None, None, None)]


def test_dag_replies(spark):
    whole = '[{"step_id":1,"depends_on":[0,"External"],"macro_action_tag":"Define"}]'
    cut = '[{"step_id":1,"depends_on":[0]},{"step_id":2,"dep'
    got = apply(spark, parse_dag, [f"```json\n{whole}\n```", cut, '{"a":1}', '[{"step_id":1', "", None])
    assert got[0][0].depends_on == ["0", "External"]
    assert len(got[1]) == 1 and got[2:] == [None] * 4
    assert apply(spark, merge_error, ['{"a":1}', "oops"]) == [None, "JSON parse error"]
    assert apply(spark, lambda x: validation_error(parse_dag(x), F.lit(2)), [whole])[0] == "expected 2 entries, got 1"


def test_small_forms(spark):
    assert apply(spark, N.plain_prediction, ["[1,2]", "3.50", "(x)", "\\frac{1}{2}", None]) == ["1,2", "3.5", "x", "\\frac12", None]
    assert apply(spark, lambda x: A.run_answer(x, "cot"), ["so \\boxed{2}", "error", "", None]) == ["2", None, None, None]
    assert apply(spark, lambda x: A.run_answer(x, "program_only"), ["```output\n7.\n```"]) == ["7"]
    assert apply(spark, lambda x: K.preview(x, 3), ["abcd", "abc"]) == ["abc...", "abc"]


def test_names_and_sizes_in_expressions():
    for a, b, same in (("\\alpha", "n", False), ("x_{12}", "x_{21}", False), ("2\\alpha+1", "2n+1", False), ("x+y=1", "1=y+x", True), ("a=b", "c=d", False), ("\\binom{5}{2}", "10", True), ("\\binom{10^8}{5\\cdot 10^7}", "3", False), ("x" * 30_000, "y" * 30_000, False)):
        assert E.equal(a, b) is same


def test_numbers_of_truths_have_no_exponent(spark):
    truth = lambda x: A.truth_of(F.struct(F.lit("how").alias("solution"), x.alias("answer"), F.lit("decimal_number").alias("ans_type")), "tabmwp")["answer"]
    assert apply(spark, truth, ["12,345,678", "1,234,567,890.25", "0.0005", "-20,000,000", "1/4", "50%", "7", "0.1"]) == ["12345678", "1234567890.25", "0.0005", "-20000000", "0.25", "0.5", "7", "0.1"]
