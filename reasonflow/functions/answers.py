"""Finding the final answers in a response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import strip, strip_string

STRINGS = "array<string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _before(x: Column, mark: str) -> Column:
    return F.substring_index(x, mark, 1)


def _after(x: Column, mark: str) -> Column:
    """What follows the first mark; only for texts that have it."""
    return F.substring(x, F.instr(x, mark) + len(mark), F.length(x))


def _last(items: Column, default: str) -> Column:
    return F.coalesce(F.get(items, F.size(items) - 1), F.lit(default))


def _closed(piece: Column, opens: str, closes: str) -> Column:
    """What stands before the bracket that closes ``piece``; with that bracket if a per cent sign follows; null if none does."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))
    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.isin(*opens), 1).when(c.isin(*closes), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (a["at"] + 1).alias("at"), F.when((a["end"] < 0) & (depth < 0), a["at"]).otherwise(a["end"]).alias("end"))
    def cut(e: Column) -> Column:
        per_cent = F.substring(piece, e + 2, F.lit(1)) == "%"
        return F.when(e >= 0, F.substring(piece, F.lit(1), e + F.when(per_cent, 1).otherwise(0)))
    chars = F.filter(F.split(piece, ""), lambda c: c != "")
    return _let(F.aggregate(chars, start, step)["end"], cut)


def boxed(text: Column) -> Column:
    """Contents of all boxes; round and square ones count only if there is no other."""
    text = F.regexp_replace(text, r"(?U)boxed\s+([\{\[\(])", "boxed$1")
    def found(t: Column, mark: str, opens: str, closes: str) -> Column:
        pieces = F.split(t, f"boxed\\{mark}", -1)
        return F.filter(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: _closed(p, opens, closes)), lambda p: p.isNotNull())
    def all_(t: Column) -> Column:
        odd = F.concat(found(t, "(", "([{", ")]}"), found(t, "[", "([{", ")]}"))
        return _let(found(t, "{", "{", "}"), lambda b: F.when(F.size(b) > 0, b).otherwise(odd))
    return _let(text, all_)


def program_output(text: Column) -> Column:
    """What the last output block holds; empty if there is none."""
    return F.when(text.contains("```output"), strip(_before(F.substring_index(text, "```output", -1), "```"))).otherwise("")


def last_number(text: Column) -> Column:
    """The last number, thousands marks left out; empty if there is none."""
    return _last(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(?U)-?\d*\.?\d+"), F.lit(0)), "")


def tidy(answer: Column) -> Column:
    x = F.get(F.split(strip(answer), "\n", 2), F.lit(0))
    return strip_string(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^:+", ""), r"\.+$", ""), "/+$", ""))


def answers(text: Column) -> Column:
    """All answers of a response, by the first rule that applies."""
    said = _after(text, "final answer is $")
    output = program_output(text)
    single = lambda x: F.when(x == "", F.array().cast(STRINGS)).otherwise(F.array(x))
    raw = (
        F.when(text.contains("final answer is $") & text.contains("$. I hope"), F.array(strip(_before(said, "$. I hope"))))
        .when(text.contains("boxed"), boxed(text))
        .when(text.contains("he answer is"), F.array(strip(F.substring_index(text, "he answer is", -1))))
        .when(output != "", F.array(output))
        .otherwise(_let(last_number(text), single))
    )
    return F.transform(raw, tidy)


def answer(text: Column) -> Column:
    return _last(answers(text), "")


def _cut(a: Column, pattern: str) -> Column:
    return F.transform(F.split(a, pattern, -1), strip)


def split_answer(question: Column, a: Column) -> Column:
    """Several answers given as one."""
    return (
        F.when(F.coalesce(question.contains("separated by commas"), F.lit(False)) & ~a.rlike(r"[()\[\]]"), _cut(a, ","))
        .when(a.rlike(r"(?U)\\text\{\s*and\s*\}"), _cut(a, r"(?U)\\text\{\s*and\s*\}"))
        .when(a.rlike(r"(?U)\\text\{\s*or\s*\}"), _cut(a, r"(?U)\\text\{\s*or\s*\}"))
        .when(a.rlike(r"(?U)\s+and\s+"), _cut(a, r"(?U)\s+and\s+"))
        .when(a.rlike(r"(?U)\s+or\s+"), _cut(a, r"(?U)\s+or\s+"))
        .otherwise(F.array(strip(a)))
    )


def math_answers(question: Column, text: Column) -> Column:
    return F.flatten(F.transform(answers(text), lambda a: split_answer(question, a)))


def perturbed_truth(question: Column, truth: Column) -> Column:
    """Answers of a truth of a changed problem, which is an answer itself."""
    def cut(a: Column) -> Column:
        return F.when(F.coalesce(question.contains("separated by commas"), F.lit(False)) & ~a.rlike(r"[()\[\]]"), _cut(a, ",")).when(a.rlike(r"(?U)\\text\{\s*and\s*\}"), _cut(a, r"(?U)\\text\{\s*and\s*\}")).when(a.contains(" or "), _cut(a, " or ")).otherwise(F.array(strip(a)))
    return F.flatten(F.transform(answers(F.concat(F.lit("\\boxed{"), truth, F.lit("}"))), cut))


def truths(question: Column, truth: Column, dataset_type: Column) -> Column:
    return F.when(dataset_type == "perturb", perturbed_truth(question, truth)).otherwise(math_answers(question, truth))


def predictions(question: Column, text: Column) -> Column:
    return F.array_distinct(math_answers(question, text))


def few_shot_math(question: Column, text: Column) -> Column:
    return math_answers(question, _before(text, "Problem:"))


def few_shot_gsm(text: Column) -> Column:
    return _last(F.regexp_extract_all(_before(text, "Q: "), F.lit(r"(?U)-?\d+\.?\d*"), F.lit(0)), "[invalid]")


def _said_zh(text: Column) -> Column:
    return F.get(F.split(strip(_after(text, "答案是")), "\n", 2), F.lit(0))


def exam_zh(text: Column, cloze: bool = False) -> Column:
    """The stated answer of an exam; cloze: without dollar signs, as a list."""
    x = _let(_before(text, "问题 "), lambda t: F.when(t.contains("答案是"), strip(_said_zh(t))).otherwise("placeholder"))
    return F.array(F.regexp_replace(x, r"^\$+|\$+$", "")) if cloze else x


def cmath(text: Column) -> Column:
    def found(t: Column) -> Column:
        said = F.regexp_replace(F.regexp_replace(_said_zh(t), "^：+|：+$", ""), "^。+|。+$", "")
        return F.when(t.contains("答案是"), _last(F.regexp_extract_all(said, F.lit(r"(?U)-?\d+\.?\d*"), F.lit(0)), "[invalid]")).otherwise(answer(t))
    return _let(_before(text, "问题："), found)


def multiple_choice(text: Column) -> Column:
    found = F.upper(F.regexp_extract(F.lower(_before(text, "Problem:")), r"the final answer is \(?([abcd])\)?", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("placeholder"))


def course_answer(text: Column) -> Column:
    p = r"(?d)final answer is (.*)\. I hope it is correct."
    x = _before(text, "Problem:")
    return F.when(x.rlike(p), F.regexp_extract(x, p, 1)).otherwise("[invalid]")


def formal_statement(text: Column) -> Column:
    return strip(_before(text, "Informal:"))


def program(text: Column, last_only: bool = True) -> Column:
    """Lines of the python blocks: of the last one, or of all under a separator each."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("on"))
    def step(a: Column, line: Column) -> Column:
        opens, fence = line.startswith("```python"), line.startswith("```")
        begun = F.lit("") if last_only else F.concat(a["out"], F.lit("\n# ========\n"))
        return F.struct(F.when(opens, begun).when(~fence & a["on"], F.concat(a["out"], line, F.lit("\n"))).otherwise(a["out"]).alias("out"), F.when(opens, True).when(fence, False).otherwise(a["on"]).alias("on"))
    return F.aggregate(F.split(text, "\n", -1), start, step)["out"]


def _plain(x: Column) -> Column:
    """A double's digits without an exponent from 1e-4 up to 1e16, as Python writes them."""
    digits = x.cast("string").try_cast("decimal(38,21)").cast("string")
    return F.when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")).otherwise(x.cast("string"))


def truth_of(e: Column, dataset: str) -> Column:
    """struct(reasoning, answer) of a benchmark's example, by its own fields."""
    if dataset in ("math", "ocw"):
        how, what = e["solution"], answer(e["solution"])
    elif dataset == "gsm8k":
        how, what = _before(e["answer"], "####"), F.substring_index(e["answer"], "####", -1)
    elif dataset == "gsm-hard":
        how, what = e["code"], e["target"].cast("string")
    elif dataset == "svamp":
        how, what = e["Equation"], e["Answer"].cast("string")
    elif dataset == "asdiv":
        how, what = e["formula"], F.regexp_replace(e["answer"], r"(?d)\(.*?\)", "")
    elif dataset in ("mawps", "bbh"):
        how, what = F.lit("None"), e["target"].cast("string")
    elif dataset == "tabmwp":
        a = e["answer"]
        number = F.when(a.contains("/"), _before(a, "/").try_cast("int") / F.get(F.split(a, "/"), F.lit(1)).try_cast("int")).when(a.contains(","), F.replace(a, F.lit(","), F.lit("")).try_cast("double")).when(a.contains("%"), _before(a, "%").try_cast("double") / 100).otherwise(a.try_cast("double"))
        how, what = e["solution"], F.when(e["ans_type"].isin("integer_number", "decimal_number"), _let(number, _plain)).otherwise(a)
    else:
        raise NotImplementedError(dataset)
    return F.struct(strip(how).alias("reasoning"), strip_string(what).alias("answer"))


def question_of(e: Column, dataset: str, names: list[str] | None = None) -> Column:
    """The question of a benchmark's example; ``names``: which of the usual fields it has."""
    if dataset == "asdiv":
        out = F.concat_ws(" ", strip(e["body"]), strip(e["question"]))
    elif dataset == "svamp":
        out = F.concat(_let(strip(e["Body"]), lambda b: F.when(b.endswith("."), b).otherwise(F.concat(b, F.lit(".")))), F.lit(" "), strip(e["Question"]))
    elif dataset == "tabmwp":
        title = F.when(e["table_title"] != "", F.concat(F.lit('regarding "'), e["table_title"], F.lit('" '))).otherwise("")
        pick = F.when(F.size(e["choices"]) > 0, F.concat(F.lit(" Please select from the following options: ['"), F.array_join(e["choices"], "', '"), F.lit("']"))).otherwise("")
        out = F.concat(F.lit("Read the following table "), F.coalesce(title, F.lit("")), F.lit("and answer a question:\n"), e["table"], F.lit("\n"), e["question"], F.coalesce(pick, F.lit("")))
    else:
        out = F.coalesce(*[e[n] for n in names or ["question", "problem", "Question", "input"]])
    return strip(out)


def run_answer(text: Column, prompt_type: str) -> Column:
    """The answer of a run: what its program printed, or what it says.  Programs themselves aren't run; null for a failed run."""
    found = program_output(text) if "program_only" in prompt_type else answer(text)
    return F.when(text.isNotNull() & ~text.isin("", "error"), strip_string(found))
