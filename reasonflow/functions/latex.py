"""Numbers from mathematical expressions in LaTeX or plain notation, for identity tests.

A small recursive parser evaluates an expression at given values of its names.  Two expressions
are taken as equal if they agree at several fixed points where both are defined.
"""

from __future__ import annotations

import cmath
import hashlib
import math
import re
from collections.abc import Callable

TOKEN = re.compile(r"\s*(\\[A-Za-z]+|\\.|\d+\.?\d*|\.\d+|\*\*|[A-Za-z]|[-+*/^(){}\[\]_=,|!<>])")
FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "log": cmath.log, "ln": cmath.log, "exp": cmath.exp, "sqrt": cmath.sqrt, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "asin": cmath.asin, "acos": cmath.acos, "atan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x)}
CONSTANTS = {"pi": math.pi, "infty": math.inf}
#: How many points names take values at, and how many tokens an expression may have: effort is bounded, not seconds.
POINTS, MOST_TOKENS, MOST_BINOMIAL = 6, 20_000, 1000


def point(name: str, seed: int) -> float:
    """The value of a name at a point, between 0.3 and 2.3: another one for each name."""
    return 0.3 + 2 * int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=8).digest()) / 2**64


class Unreadable(ValueError):
    """The text is no expression that this parser knows."""


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise Unreadable(text)
        out.append(m[1])
        if len(out) > MOST_TOKENS:
            raise Unreadable("too long")
        at = m.end()
    return [t for t in out if t not in ("\\left", "\\right", "\\,", "\\;", "\\!", "\\ ", "\\displaystyle", "\\mathrm", "\\mathbf")]


class Parser:
    """sum > product > signed > power > atom; names get values from ``names``."""

    def __init__(self, text: str, names: dict[str, float] | None = None, seed: int = 0):
        self.toks, self.at, self.seed, self.names, self.depth = tokens(text), 0, seed, names if names is not None else {}, 0

    def value(self) -> complex:
        out = self.sum()
        if self.at != len(self.toks):
            raise Unreadable(self.toks[self.at])
        return out

    def peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def next(self) -> str:
        self.at += 1
        return self.toks[self.at - 1] if self.at <= len(self.toks) else ""

    def expect(self, t: str) -> None:
        if self.next() != t:
            raise Unreadable(t)

    def sum(self) -> complex:
        self.depth += 1
        if self.depth > 60:
            raise Unreadable("too deep")
        out = self.product()
        while self.peek() in ("+", "-", "\\pm"):
            out = out - self.product() if self.next() == "-" else out + self.product()
        self.depth -= 1
        return out

    def product(self) -> complex:
        out = self.signed()
        while True:
            t = self.peek()
            if t in ("*", "\\cdot", "\\times"):
                self.next()
                out *= self.signed()
            elif t in ("/", "\\div"):
                self.next()
                out /= self.signed()
            elif t and (t[0].isalnum() or t in ("(", "{", "[", ".") or (t[0] == "\\" and t[1:2].isalpha() and t not in ("\\pm", "\\cup", "\\cap", "\\in", "\\rfloor", "\\rceil"))):
                out *= self.power()
            else:
                return out

    def signed(self) -> complex:
        if self.peek() in ("-", "+"):
            return -self.signed() if self.next() == "-" else self.signed()
        return self.power()

    def power(self) -> complex:
        out = self.atom()
        while self.peek() == "!":
            self.next()
            if out.imag or out.real < 0 or out.real != int(out.real) or out.real > 150:
                raise Unreadable("!")
            out = complex(math.factorial(int(out.real)))
        if self.peek() in ("^", "**"):
            self.next()
            sign = 1
            while self.peek() == "-":
                self.next()
                sign = -sign
            return out ** (sign * self.argument())
        return out

    def argument(self) -> complex:
        """A group, or one atom; of a bare number one digit, as LaTeX reads it."""
        t = self.peek()
        if t[:1].isdigit() and len(t) > 1:
            self.toks[self.at : self.at + 1] = [t[0], t[1:]]
        return self.atom()

    def group(self, close: str) -> complex:
        out = self.sum()
        self.expect(close)
        return out

    def atom(self) -> complex:
        t = self.next()
        if not t:
            raise Unreadable("end")
        if t in ("(", "{", "["):
            return self.group({"(": ")", "{": "}", "[": "]"}[t])
        if t == "|":
            return complex(abs(self.group("|")))
        if t[0].isdigit() or t[0] == ".":
            return complex(float(t))
        if t in ("\\frac", "\\dfrac", "\\tfrac", "\\cfrac"):
            a = self.argument()
            return a / self.argument()
        if t == "\\binom":
            n, k = self.argument(), self.argument()
            if n.imag or k.imag or n.real != int(n.real) or k.real != int(k.real) or not 0 <= k.real <= n.real <= MOST_BINOMIAL:
                raise Unreadable(t)
            return complex(math.comb(int(n.real), int(k.real)))
        if t == "\\sqrt":
            n = 2.0
            if self.peek() == "[":
                self.next()
                n = self.group("]")
            x = self.argument()
            return x ** (1 / n)
        name = t.lstrip("\\")
        if t.isalpha() and len(t) == 1:  # plain names of functions come letter by letter
            word = t
            for other in self.toks[self.at : self.at + 6]:
                if not (len(other) == 1 and other.isalpha()):
                    break
                word += other
            for n in range(len(word), 1, -1):
                if word[:n] in FUNCTIONS and self.toks[self.at + n - 1 : self.at + n] == ["("] or word[:n] == "pi":
                    self.at += n - 1
                    name = word[:n]
                    break
        if name in FUNCTIONS:
            expo = None
            if self.peek() == "^":
                self.next()
                expo = self.argument()
            out = FUNCTIONS[name](self.argument() if self.peek() in ("(", "{", "[") else self.power())
            return out if expo is None else out**expo
        if name in CONSTANTS:
            return complex(CONSTANTS[name])
        if name == "i":
            return 1j
        if name == "e":
            return complex(math.e)
        if t[0] == "\\" and t[1:].isalpha() and name not in ("alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "phi", "omega", "epsilon", "rho", "sigma", "tau"):
            raise Unreadable(t)
        if not (t.isalpha() or t[0] == "\\"):
            raise Unreadable(t)
        if self.peek() == "_":
            self.next()
            sub = self.next()
            while sub == "{" or sub[-1] not in "}" and "{" in sub:
                sub += self.next() or "}"
            name += "_" + sub
        return complex(self.names.setdefault(name, point(name, self.seed)))


def evaluate(text: str, seed: int = 0) -> complex:
    return Parser(text, {}, seed).value()


def _near(x: complex, y: complex, tolerance: float) -> bool:
    if cmath.isinf(x) or cmath.isinf(y):
        return x == y
    return abs(x - y) <= max(tolerance, 1e-9 * max(abs(x), abs(y)))


def _agree(texts: list[str], test: Callable[..., bool]) -> bool:
    """Whether ``test`` of the values holds at all fixed points at which all texts have one; false if any can't be read."""
    agreed = 0
    for seed in range(POINTS):
        try:
            values = [evaluate(t, seed) for t in texts]
        except (Unreadable, RecursionError):
            return False
        except (ZeroDivisionError, OverflowError, ValueError):
            continue
        if any(map(cmath.isnan, values)):
            continue
        if not test(*values):
            return False
        agreed += 1
    return agreed > 0


def same_expression(a: str, b: str, tolerance: float = 1e-7) -> bool:
    """Whether both have the same value wherever both have one."""
    return _agree([a, b], lambda x, y: _near(x, y, tolerance))


def same_equation(a: tuple[str, str], b: tuple[str, str], tolerance: float = 1e-7) -> bool:
    """Whether the two sides of one equation are everywhere as far apart as those of the other, in the same or in the other direction."""
    sides = [*a, *b]
    return any(_agree(sides, lambda w, x, y, z, sign=sign: _near(w - x, sign * (y - z), tolerance)) for sign in (1, -1))
