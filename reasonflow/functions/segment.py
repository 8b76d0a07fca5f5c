"""Splitting responses into reasoning steps, as one expression over arrays of texts.

Formulas are replaced by numbered placeholders first, so no split falls into one and
lengths count a formula as a few characters.  Java's ``\\s`` and line ends are set to
Unicode's and to the newline alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# From what length on a chunk is cut further, and what length a step has at least.
THRESHOLD, MIN_STEP = 300, 20
NUL = "\x00"
# What opens and closes formulas, in the order of replacement.
FORMULAS = [
    ("DISPLAY", r"(?s)\\\[.*?\\\]"),
    ("DISPLAY", r"(?s)\$\$.*?\$\$"),
    ("INLINE", r"(?s)\\\(.*?\\\)"),
    ("INLINE", r"(?U)(?d)(?<!\$)\$(?!\$)(?!\s)(.+?)(?<!\s|\$)\$(?!\$)"),
]
# Words that open a new thought.
CONNECTORS = r"Therefore|Thus|Hence|So,?\s|Now,?\s|Next,?\s|First,?\s|Then,?\s|Since\s|Because\s|Note\sthat\s|We\s(?:can|need|know|have|get|see|find|note|observe|use|compute|calculate)"
CONNECTORS_ZH = "因此|所以|那么|接下来|首先|由于|已知"
# Where chunks are cut, from headers to sentences, and what is a display formula alone.
HEADER = r"(?m)(?d)(?U)(?=^#{1,4}\s)"
BLANK_LINE = r"(?U)\n\s*\n"
NUMBERED = r"(?m)(?d)(?U)(?=^\d+\.\s)"
BULLET = r"(?m)(?d)(?=^- )"
CONNECTOR = rf"(?U)(?:(?<=\.\s)|(?<=\n)|(?<=:\n)|(?<=:\s))(?=(?:{CONNECTORS}))"
SENTENCE = r"(?U)(?<=\.)\s+(?=[A-Z])"
DISPLAY_ONLY = r"(?s)(?U)^\s*(\\\[.*?\\\]|\$\$.*?\$\$)\s*$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    return F.length(strip(x)) == 0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _each(chunks: Column, split: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(chunks, split))


def _or_self(parts: Column, chunk: Column) -> Column:
    return _let(parts, lambda p: F.when(F.size(p) == 0, F.array(chunk)).otherwise(p))


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda p: ~blank(p))


def protect(text: Column) -> Column:
    """struct(text, found): formulas replaced by placeholders, and (key, formula) pairs in order of replacement."""
    state = F.struct(text.alias("text"), F.array().cast("array<struct<k:string,v:string>>").alias("found"))
    for kind, pattern in FORMULAS:
        state = _let(state, _replacer(kind, pattern))
    return state


def _replacer(kind: str, pattern: str) -> Callable[[Column], Column]:
    def step(s: Column) -> Column:
        hits = F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0))
        return _let(F.struct(F.split(s["text"], pattern, -1).alias("gaps"), hits.alias("hits"), s["found"].alias("found")), lambda x: _numbered(x, kind))

    return step


def _numbered(x: Column, kind: str) -> Column:
    base = F.size(x["found"])
    keys = F.transform(x["hits"], lambda h, i: F.concat(F.lit(f"{NUL}{kind}_"), (base + i).cast("string"), F.lit(NUL)))
    text = F.array_join(F.flatten(F.zip_with(x["gaps"], keys, lambda g, k: F.array(g, F.coalesce(k, F.lit(""))))), "")
    return F.struct(text.alias("text"), F.concat(x["found"], F.zip_with(keys, x["hits"], lambda k, h: F.struct(k.alias("k"), h.alias("v")))).alias("found"))


def restore(chunks: Column, found: Column) -> Column:
    """Puts formulas back, the last found first, twice: a formula may hold placeholders of others."""
    once = lambda c, f: F.aggregate(F.reverse(f), c, lambda a, e: F.replace(a, e["k"], e["v"]))
    return F.transform(chunks, lambda c: F.when(c.contains(NUL), _let(once(c, found), lambda d: F.when(d.contains(NUL), once(d, found)).otherwise(d))).otherwise(c))


def connector_split(chunk: Column, threshold: int) -> Column:
    sub = lambda p: F.when(F.length(p) > threshold, _filled(F.split(p, f"(?=(?:{CONNECTORS_ZH}))", -1))).otherwise(_filled(F.array(p)))
    return F.when(F.length(chunk) <= threshold, F.array(chunk)).otherwise(_or_self(_each(F.split(chunk, CONNECTOR, -1), sub), chunk))


def sentence_split(chunk: Column, threshold: int = THRESHOLD) -> Column:
    return F.when(F.length(chunk) <= threshold, F.array(chunk)).otherwise(_or_self(_filled(F.split(chunk, SENTENCE, -1)), chunk))


def _joined(chunks: Column, joins: Callable[[Column, Column], Column]) -> Column:
    """Chunks, each one that ``joins`` (the step before it so far, the chunk) put below that step.

    Where steps end is found first; then each step's chunks are put together once.
    """
    size = F.size(chunks)
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<int>").alias("heads"), F.lit(1).alias("at"))

    def step(a: Column, c: Column) -> Column:
        on = a["last"].isNotNull() & joins(a["last"], c)
        return F.struct(F.when(on, F.concat(a["last"], F.lit("\n"), c)).otherwise(c).alias("last"), F.when(on, a["heads"]).otherwise(F.concat(a["heads"], F.array(a["at"]))).alias("heads"), (a["at"] + 1).alias("at"))

    def parts(heads: Column) -> Column:
        return F.transform(heads, lambda h, i: F.array_join(F.slice(chunks, h, F.coalesce(F.get(heads, i + 1), size + 1) - h), "\n"))

    return _let(F.aggregate(chunks, zero, step)["heads"], parts)


def merge_short(chunks: Column, min_step: int = MIN_STEP) -> Column:
    """Stripped non-empty chunks; one that follows a step still shorter than ``min_step`` joins it, and so does a short last one the step before it."""
    clean = F.filter(F.transform(chunks, strip), lambda c: c != "")
    def close(a: Column) -> Column:
        n = F.size(a)
        return F.when((n > 1) & (F.length(F.get(a, n - 1)) < min_step), F.concat(F.slice(a, F.lit(1), n - 2), F.array(F.concat(F.get(a, n - 2), F.lit("\n"), F.get(a, n - 1))))).otherwise(a)
    return _let(_let(clean, lambda c: _joined(c, lambda last, _: F.length(last) < min_step)), close)


def merge_display(chunks: Column) -> Column:
    """A chunk that is a display formula joins the one before it."""
    merged = lambda c: _joined(c, lambda _, x: x.rlike(DISPLAY_ONLY))
    shown = lambda c: F.exists(c, lambda x: x.startswith("\\[") | x.startswith("$$") | x.rlike(r"(?U)^\s+(\\\[|\$\$)"))
    return _let(chunks, lambda c: F.when(shown(c), merged(c)).otherwise(c))


def segment(text: Column, threshold: int = THRESHOLD, min_step: int = MIN_STEP) -> Column:
    """The steps of a response (array<string>); none for a null or blank text."""
    def chunks(t: Column) -> Column:
        out = F.filter(F.split(t, HEADER, -1), lambda p: p != "")
        out = _each(out, lambda c: _filled(F.split(c, BLANK_LINE, -1)))
        # display formulas alone: marked on both sides, then split at the marks
        marked = lambda c: F.regexp_replace(c, f"({NUL}DISPLAY_\\d+{NUL})", "\x01$1\x01")
        out = _each(out, lambda c: _filled(F.split(marked(c), "\x01", -1)))
        out = _each(out, lambda c: _or_self(_each(F.split(c, NUMBERED, -1), lambda p: _filled(F.split(p, BULLET, -1))), c))
        out = _each(out, lambda c: connector_split(c, threshold))
        return _each(out, lambda c: sentence_split(c, threshold))

    def whole(p: Column) -> Column:
        return merge_short(merge_display(restore(chunks(p["text"]), p["found"])), min_step)

    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | blank(text), empty).otherwise(_let(protect(text), whole))
