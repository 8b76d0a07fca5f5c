"""Canonical form of mathematical answers: an ordered chain of built-in replacements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sans-serif digits, bold and plain.
SANS_DIGITS = "𝟬𝟭𝟮𝟯𝟰𝟱𝟲𝟳𝟴𝟵𝟢𝟣𝟤𝟥𝟦𝟧𝟨𝟩𝟪𝟫"
# Subscripts and what they stand for.
SUBSCRIPTS = dict(zip("₀₁₂₃₄₅₆₇₈₉ₙ", "0123456789n", strict=True))
# Symbols and their LaTeX.
SYMBOLS = {
    "²": "^{2}", "³": "^{3}", "ⁿ": "^{n}", "π": "\\pi ", "∞": "\\infty ", "⎣": "\\lfloor ", "⎦": "\\rfloor ",
    "–": "-", "−": "-", "∪": "\\cup ", "∩": "\\cap ", "·": "\\cdot ", "×": "\\times ",
    "\u202f": " ", "⁄": "/", "\xa0": " ", "½": "\\frac{1}{2}", "∏": "\\prod ", "∑": "\\sum ",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _sub(pattern: str, by: str) -> Callable[[Column], Column]:
    return lambda x: F.regexp_replace(x, pattern, by)


def _put(old: str, new: str = "") -> Callable[[Column], Column]:
    return lambda x: F.replace(x, F.lit(old), F.lit(new))


# The patterns of roots, units and bare arguments, and the order of replacements, in the functions below.
def plain_symbols(x: Column) -> Column:
    """Roots, digits in other fonts, subscripts and symbols as LaTeX."""
    x = F.regexp_replace(x, r"√(\([^()]*\)|[A-Za-z0-9]+)", r"\\sqrt{$1}")
    x = F.regexp_replace(x, r"∛(\([^()]*\)|[A-Za-z0-9]+)", r"\\sqrt[3]{$1}")
    x = F.translate(x, SANS_DIGITS, "01234567890123456789")
    for k, v in SUBSCRIPTS.items():
        x = F.replace(x, F.lit(k), F.lit(f"_{{{v}}}"))
    for k, v in SYMBOLS.items():
        x = F.replace(x, F.lit(k), F.lit(v))
    return x


def fix_fracs(x: Column) -> Column:
    """Braces around bare arguments of ``\\frac``; unchanged if one has too few characters."""

    def whole(parts: Column) -> Column:
        tail = F.slice(parts, F.lit(2), F.size(parts))
        bare = F.exists(tail, lambda p: ~p.startswith("{") & (F.length(p) < 2))
        def fixed(p: Column) -> Column:
            a, b = F.substring(p, 1, 1), F.substring(p, 2, 1)
            more = F.substring(p, F.lit(3), F.length(p))
            return F.when(p.startswith("{"), p).when(b == "{", F.concat(F.lit("{"), a, F.lit("}{"), more)).otherwise(F.concat(F.lit("{"), a, F.lit("}{"), b, F.lit("}"), more))
        return F.when(bare, F.array_join(parts, "\\frac")).otherwise(F.array_join(F.concat(F.slice(parts, F.lit(1), F.lit(1)), F.transform(tail, fixed)), "\\frac"))

    return F.when(x.contains("\\frac"), let(F.split(x, r"\\frac", -1), whole)).otherwise(x)


def fix_slash(x: Column) -> Column:
    """a/b as a fraction if both sides are plain integers or hold a root."""
    side = r"(?:-?[1-9]\d*|0|[^/]*sqrt[^/]*)"
    return F.when(x.rlike(f"(?s)^{side}/{side}$"), F.regexp_replace(x, "(?s)^([^/]*)/([^/]*)$", r"\\frac{$1}{$2}")).otherwise(x)


def strip_string(x: Column) -> Column:
    """The canonical form; null stays null."""
    unit = lambda s: let(strip(F.regexp_replace(s, r"(?d)\\text\{.*?\}$", "")), lambda u: F.when(u == "", s).otherwise(u))
    infinite = lambda s: F.when(s.contains("\\infty"), s).otherwise(F.replace(s, F.lit("inf"), F.lit("\\infty")))
    imaginary = lambda s: F.when(s.contains("j") & ~s.contains("i"), F.replace(s, F.lit("j"), F.lit("i"))).otherwise(s)
    unwrapped = lambda s: F.when(s.startswith("\\text{") & s.endswith("}"), F.substring(s, F.lit(7), F.length(s) - 7)).otherwise(s)
    chain = [
        strip, _put("\n"), _sub(r"\.+$", ""), _put("\\!"), _sub(r"(?<!\\)\\ ", ""), _put("\\,"), _put("\\:"), _put("\\;"), _put("\\quad"),
        unwrapped, _put("tfrac", "frac"), _put("dfrac", "frac"), _put("cfrac", "frac"), _put("\\left"), _put("\\right"), unit,
        _put("^{\\circ}"), strip, _put("^\\circ"), strip, _sub(r"\{(c|m)?m\}(\^(2|3))?", ""), strip, _sub(r"p\.m\.$", ""), strip, _sub(r"(?U)(\d)\s*t$", "$1"), strip,
        plain_symbols, _put("\\$"), _put("$"), _put("x\\in"), _put("\\%", "%"), _put(" .", " 0."), _put("{.", "{0."),
        _put("infinity", "\\infty"), infinite, _put("+\\inity", "\\infty"), _put("\\mathbf"), _put("\\mathrm"), _sub(r"(?d)\\mbox\{.*?\}", ""), imaginary,
        _sub(r"(?U)(\d+)\.0+([^\d])", "$1$2"), _sub(r"(?U)(\d+)\.0+$", "$1"), _sub(r"^\.", "0."),
        _sub(r"\\sqrt(-?[0-9.a-zA-Z]+)", r"\\sqrt{$1}"), _sub(r"(?U)\\sqrt\s+(\w+)$", r"\\sqrt{$1}"), _sub(r"\\tan(-?[0-9.a-zA-Z]+)", r"\\tan{$1}"), _sub(r"(?U)\\tan\s+(\w+)$", r"\\tan{$1}"),
    ]
    # steps that name their input more than once take it as a lambda's variable, so the chain stays linear
    several = {unit, infinite, imaginary, unwrapped}
    for f in chain:
        x = let(x, f) if f in several else f(x)
    x = let(let(x, fix_fracs), fix_slash)
    return F.regexp_replace(x, r"(\\|,|\.)+$", "")


def parse_number(x: Column) -> Column:
    """The number in a text, with thousands marks and per cent; null if it is none."""

    def number(s: Column) -> Column:
        special = F.when(s.rlike(r"(?i)^[+-]?(inf|infinity)$"), F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(s.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan")))
        plain = s.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$")
        return F.when(plain, F.replace(s, F.lit("_"), F.lit("")).try_cast("double")).otherwise(special)

    def either(s: Column) -> Column:
        return F.coalesce(let(strip(s), number), F.when(s.endswith("%"), let(strip(F.regexp_replace(s, r"\\?%$", "")), number) / 100))

    return let(F.replace(F.replace(x, F.lit("{,}"), F.lit("")), F.lit(","), F.lit("")), either)


def plain_prediction(x: Column) -> Column:
    """A number to six places, else the text without outer brackets and braces."""
    number = F.replace(F.replace(x, F.lit("{,}"), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    bare = F.regexp_replace(strip(x), r"^(?:\[(?=.*\]$)|\((?=.*\)$))+|(?<=.)[\])]+$", "")
    return F.coalesce(F.round(number, 6).cast("string"), F.regexp_replace(bare, r"[{}()]", ""))
