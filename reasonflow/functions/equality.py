"""Whether two answers are the same: built-in tests first, a kernel for what they leave open."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .latex import same_equation, same_expression
from .normalize import let, parse_number

TOLERANCE = 1e-7
MATRIX = re.compile(r"^\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}$", re.DOTALL)
TUPLE = re.compile(r"[(\[].+[)\]]")


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(TOLERANCE))


def quick_equal(a: Column, b: Column) -> Column:
    """True or false where text or number decides it, else null.  A number may be off by a factor of 100 (per cent)."""


    def near(n: Column) -> Column:
        x, y = n["x"], n["y"]
        return F.when(x.isNotNull() & y.isNotNull(), close(x, y / 100) | close(x, y) | close(x, y * 100)).when(a == "", False)

    return F.when(a == b, True).otherwise(let(F.struct(parse_number(a).alias("x"), parse_number(b).alias("y")), near))


def number(s: str) -> float | None:
    s = s.replace("{,}", "").replace(",", "")
    for t, by in ((s, 1), (re.sub(r"\\?%$", "", s), 100)):
        if by == 1 or t != s:
            try:
                return float(t) / by
            except ValueError:
                pass
    return None


def equal(a: str, b: str) -> bool:
    """As ``quick_equal``, and then part by part, as equations, and as expressions."""
    if a == b:
        return True
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return any(math.isclose(v, x, abs_tol=TOLERANCE) for v in (y / 100, y, y * 100))
    if not a:
        return False
    a, b = a.strip(), b.strip()
    if TUPLE.match(a) and TUPLE.match(b):
        p, q = a[1:-1].split(","), b[1:-1].split(",")
        if len(p) == len(q) and (len(p) > 1 or a[1:-1] != a) and all(map(equal, p, q)):
            return True
    m, n = MATRIX.match(a), MATRIX.match(b)
    if m and n:
        rows = [[line.strip().split("&") for line in x[1].split("\\\\") if line.strip()] for x in (m, n)]
        if [len(r) for r in rows[0]] == [len(r) for r in rows[1]] and all(equal(c, d) for r, s in zip(*rows, strict=True) for c, d in zip(r, s, strict=True)):
            return True
    sides = [s.split("=") for s in (a, b)]
    if len(sides[0]) == len(sides[1]) == 2:
        return same_equation(tuple(sides[0]), tuple(sides[1]))
    if len(sides[0]) == 2 and len(sides[0][0].strip()) <= 2 and len(sides[1]) == 1:
        return equal(sides[0][1], b)
    if len(sides[1]) == 2 and len(sides[1][0].strip()) <= 2 and len(sides[0]) == 1:
        return equal(a, sides[1][1])
    return same_expression(a, b)


def matches(a: str, b: str, tolerance: float = TOLERANCE) -> bool:
    """One prediction against one answer; unions part by part."""
    if "\\cup" in a and "\\cup" in b:
        return all_match(a.split("\\cup"), b.split("\\cup"), tolerance)
    try:
        if abs(float(a.replace("{,}", "").replace(",", "")) - float(b.replace("{,}", "").replace(",", ""))) < tolerance:
            return True
    except ValueError:
        pass
    return bool(b and a == b) or equal(a, b)


def all_match(predictions: list[str], answers: list[str], tolerance: float = TOLERANCE) -> bool:
    """Each prediction fits some answer and each answer some prediction."""
    fits = [[matches(p, a, tolerance) for a in answers] for p in predictions]
    return all(map(any, fits)) and all(any(f[i] for f in fits) for i in range(len(answers)))


def tail(predictions: Column, answers: Column) -> Column:
    """As many of the last predictions as there are answers; all if there are none."""
    n, m = F.size(predictions), F.size(answers)
    return F.when(m == 0, predictions).otherwise(F.slice(predictions, F.greatest(F.lit(1), n - m + 1), F.greatest(m, F.lit(1))))


def lists_match(predictions: Column, answers: Column, in_order: bool = False) -> Column:
    """Kernel verdict on lists of predictions and answers; what it can't handle is false.

    Equal pairs that follow each other are checked once.  ``in_order``: Spark keeps the order of rows for
    that, as it drops a sort before functions that it takes to be deterministic.
    """
    kernel = F.pandas_udf(_lists_match, "boolean")
    return (kernel.asNondeterministic() if in_order else kernel)(predictions, answers)


def _lists_match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    last, same = None, None
    for predictions, answers in batches:
        out = []
        for p, a in zip(predictions, answers, strict=True):
            if p is None or a is None:
                out.append(None)
                continue
            pair = list(p), list(a)
            if pair != last:
                last = pair
                try:
                    same = all_match(*pair)
                except (ValueError, ArithmeticError, RecursionError):
                    same = False
            out.append(same)
        yield pd.Series(out, dtype="boolean")
