"""Secret scan by built-in functions only: fixed patterns, and a battery of randomness tests.

Candidates are runs of 20 or more letters, digits and ``+/_-``.  A candidate's encoding is the
smallest alphabet that holds it.  Three tests are made in that alphabet: chi-squared for
uniformity, runs of character classes, and lag-1 serial correlation.

A candidate is reported if none of the tests finds it unlike a random string (the least
of the three p-values, Bonferroni-corrected, is above ``ALPHA``) and if ordinary text of its length would
hardly look so random: the chi-squared and runs statistics are set against their mean and
spread for text with the corpus's own letter frequencies, which depend on the length, and the
p-value of their sum passes Benjamini-Hochberg at ``FDR`` among the candidates of its
length class.  The thresholds come from a histogram of all candidates' p-values, of a fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import let

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets, the smallest first; the last holds every candidate.
ENCODINGS = [("digits", DIGITS), ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("lower", LOWER), ("upper", UPPER), ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER), ("letters", UPPER + LOWER), ("base62", DIGITS + UPPER + LOWER), ("base64", UPPER + LOWER + DIGITS + "+/_-")]
LENGTHS = [20, 24, 32, 48, 64]  # where the length classes begin
ALPHA, FDR = 0.001, 0.01
BIN, BINS = 0.25, 400  # width and number of the classes of -log10(p)
#: Shares of text that aren't lower-case letters, and how often text changes class, at most.
TEXT_DIGIT, TEXT_UPPER, TEXT_SIGN, TEXT_CHANGES = 0.05, 0.05, 0.01, 0.25
#: Weight, in letters, of equally common letters in the estimate of the corpus's letter frequencies.
PRIOR = 26.0


def _places(pieces: Column, matches: Column, keep: Column, rank: int) -> Column:
    """Spans of the matches: pieces stand before, between and after them.  Sums run in blocks, so long lists stay cheap."""
    size = F.lit(128)
    n = F.size(matches)
    both = F.zip_with(F.slice(pieces, F.lit(1), n), matches, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))

    def spans(items: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct((a["at"] + x["p"] + x["m"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["p"]).alias("s"), (a["at"] + x["p"] + x["m"]).alias("e")))).alias("out")))["out"]

    def blocks(items: Column) -> Column:
        heads = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), size)
        sums = F.transform(heads, lambda h: F.aggregate(F.slice(items, h, size), F.lit(0), lambda a, x: a + x["p"] + x["m"]))
        firsts = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.flatten(let(firsts, lambda f: F.transform(heads, lambda h, i: spans(F.slice(items, h, size), F.get(f, i)))))

    kept = F.filter(F.zip_with(let(both, blocks), keep, lambda s, k: F.struct(s["s"].alias("s"), F.lit(rank).alias("kind"), s["e"].alias("e"), k.alias("k"))), lambda x: x["k"])
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))


def _none() -> Column:
    return F.array().cast("array<struct<s:int,kind:int,e:int>>")


def _matches(text: Column, pattern: str, rank: int, guard: Column, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters or more."""
    r = F.lit(pattern)
    every = F.regexp_extract_all(text, r, F.lit(0))
    keep = F.transform(F.regexp_extract_all(text, r, F.lit(group)), lambda g: F.length(g) >= least) if least else F.transform(every, lambda m: F.lit(True))
    return F.when(guard, _places(F.split(text, pattern, -1), every, keep, rank)).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans (s, kind, e) of the fixed patterns in order; ``text`` must not be null."""
    assign = _matches(text, ASSIGN, 0, text.rlike(ASSIGN), group=2, least=6)
    access = _matches(text, ACCESS, 1, text.contains("AKIA"))
    hexes = _matches(text, HEX, 2, text.rlike("[0-9a-f]{24}"))
    return F.array_sort(F.concat(assign, access, hexes))


def candidates(text: Column) -> Column:
    """struct(s, kind, e, t) of each candidate: its span and its characters, which are not cut out of the text again."""

    def told(every: Column) -> Column:
        spans = _places(F.split(text, CANDIDATE, -1), every, F.transform(every, lambda m: F.lit(True)), 3)
        return F.zip_with(spans, every, lambda x, t: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), t.alias("t")))

    none = F.array().cast("array<struct<s:int,kind:int,e:int,t:string>>")
    return F.when(text.rlike(CANDIDATE), let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), told)).otherwise(none)


def apart(items: Column, base: Column) -> Column:
    """Those of ``items`` (in order, none over another) that no span of ``base`` overlaps.

    Starts and ends are sorted together: at a start with as many ends as starts before it
    nothing is open, and nothing else begins in an item if the next start isn't before its end.
    """
    event = lambda p, o, e, i: F.struct(p.alias("p"), F.lit(o).alias("o"), e.alias("e"), i.alias("i"))
    ends = [F.transform(x, lambda b: event(b["e"], 0, b["e"], F.lit(-1))) for x in (base, items)]
    both = [*ends, F.transform(base, lambda b: event(b["s"], 1, b["e"], F.lit(-1))), F.transform(items, lambda b, i: event(b["s"], 1, b["e"], i))]
    starts = F.filter(F.transform(F.sort_array(F.concat(*both)), lambda x, t: F.struct(x["p"].alias("p"), x["o"].alias("o"), x["e"].alias("e"), x["i"].alias("i"), t.alias("t"))), lambda x: x["o"] == 1)

    def free(all_: Column) -> Column:
        return F.filter(all_, lambda x, r: (x["i"] >= 0) & (2 * r == x["t"]) & F.coalesce(F.get(all_, r + 1)["p"] >= x["e"], F.lit(True)))

    some = let(items, lambda own: F.transform(let(starts, free), lambda x: F.get(own, x["i"])))
    return F.when(F.size(items) == 0, items).otherwise(some)


def _upper_tail(z: Column) -> Column:
    """A bound on the normal upper tail."""
    return F.when(z > 0, F.exp(-z * z / 2) / 2).otherwise(F.lit(1.0))


class TextModel:
    """Mean and spread of the statistics for ordinary text, for each alphabet."""

    def __init__(self, letters: dict[str, int]):
        total = sum(letters.values()) + PRIOR
        share = {c: (letters.get(c, 0) + PRIOR / 26) / total for c in LOWER}
        self.moments = []
        for _, alphabet in ENCODINGS:
            p = [share[c] if c in LOWER else TEXT_UPPER * share[c.lower()] if c in UPPER else TEXT_DIGIT / 10 if c in DIGITS else TEXT_SIGN / 4 for c in alphabet]
            p = [x / sum(p) for x in p]
            two, three, k = sum(x * x for x in p), sum(x**3 for x in p), len(p)
            self.moments.append((k, k * two - 1, max(0.0, k * k * (three - two * two))))


def tests(token: Column, model: TextModel) -> Column:
    """struct(n, p_random, p_text) of a candidate."""

    def scored(x: Column) -> Column:
        body, e = x["body"], x["e"]
        n = F.length(body).cast("double")
        alphabet = F.get(F.array(*[F.lit(a) for _, a in ENCODINGS]), e)
        moment = [F.get(F.array(*[F.lit(float(m[i])) for m in model.moments]), e) for i in range(3)]
        return let(F.struct(n.alias("n"), alphabet.alias("a"), *[m.alias(f"m{i}") for i, m in enumerate(moment)], F.split(body, "").alias("c")), measured)

    def measured(x: Column) -> Column:
        chars = F.filter(x["c"], lambda c: c != "")
        at = let(x["a"], lambda a: F.transform(chars, lambda c: F.instr(a, c).cast("double")))
        kind = F.transform(chars, lambda c: F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3))
        zero = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        # sum of squared counts: the i-th of equal symbols adds 2 i - 1
        squares = F.aggregate(F.sort_array(at), zero, lambda a, v: let_run(a, v))["sum"]
        changes = let(kind, lambda k: F.aggregate(F.sequence(F.lit(1), F.size(k) - 1), F.lit(0.0), lambda a, i: a + F.when(F.get(k, i) != F.get(k, i - 1), 1.0).otherwise(0.0)))
        return let(F.struct(*[x[c].alias(c) for c in ("n", "a", "m0", "m1", "m2")], squares.alias("q"), changes.alias("changes"), let(at, correlation).alias("r")), verdict)

    def let_run(a: Column, v: Column) -> Column:
        run = F.when(a["last"] == v, a["run"] + 1).otherwise(1.0)
        return F.struct(v.alias("last"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum"))

    def correlation(v: Column) -> Column:
        n = F.size(v)
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        return let(mean, lambda m: F.try_divide(F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda a, i: a + (F.get(v, i) - m) * (F.get(v, i - 1) - m)), F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))))

    def verdict(x: Column) -> Column:
        n, k = x["n"], x["m0"]
        chi = k / n * x["q"] - n
        df = k - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2 / 9) / df)) / F.sqrt(F.lit(2 / 9) / df)
        share = [F.get(F.array(*[F.lit(sum(c in s for c in a) / len(a)) for _, a in ENCODINGS]), F.array_position(F.array(*[F.lit(a) for _, a in ENCODINGS]), x["a"]).cast("int") - 1) for s in (DIGITS, UPPER, LOWER, "+/_-")]
        turn = 1 - sum((s * s for s in share), F.lit(0.0))
        z_runs = F.when(turn > 0, (x["changes"] - (n - 1) * turn) / F.sqrt((n - 1) * turn * (1 - turn))).otherwise(F.lit(0.0))
        z_serial = F.coalesce(x["r"], F.lit(1.0)) * F.sqrt(n)
        p_random = F.least(F.lit(1.0), 3 * F.least(_upper_tail(z_chi), 2 * _upper_tail(F.abs(z_runs)), 2 * _upper_tail(F.abs(z_serial))))
        text_chi = (df + (n - 1) * x["m1"] - chi) / F.sqrt(2 * df + 4 * (n - 1) * x["m2"])
        text_runs = (x["changes"] - (n - 1) * TEXT_CHANGES) / F.sqrt((n - 1) * (TEXT_CHANGES * (1 - TEXT_CHANGES)))
        z = (text_chi + text_runs) / math.sqrt(2)
        return F.struct(n.cast("int").alias("n"), p_random.alias("p_random"), _upper_tail(z).alias("p_text"))

    body = F.rtrim(token, F.lit("="))
    which = F.coalesce(*[F.when(F.length(F.translate(body, a, "")) == 0, F.lit(i)) for i, (_, a) in enumerate(ENCODINGS)])
    return let(F.struct(body.alias("body"), which.alias("e")), scored)


def length_class(n: Column) -> Column:
    return sum((F.when(n >= x, 1).otherwise(0) for x in LENGTHS[1:]), F.lit(0))


def p_class(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(-F.log10(F.greatest(p, F.lit(1e-150))) / BIN).cast("int"))


def thresholds(counts: dict[tuple[int, int], int]) -> list[int]:
    """By length class the least p class that passes Benjamini-Hochberg (BINS: none does).

    ``counts`` is by length class and p class.  All of a class pass if the largest
    p-value it can hold does.
    """
    out = []
    for stratum in range(len(LENGTHS)):
        total = sum(c for (s, _), c in counts.items() if s == stratum)
        passed, upto = BINS, 0
        for b in range(BINS - 1, -1, -1):
            upto += counts.get((stratum, b), 0)
            if upto and 10 ** (-b * BIN) <= FDR * upto / total:
                passed = b
        out.append(passed)
    return out


class SecretScan:
    """What is learnt from all texts of a corpus, to scan any text with."""

    def __init__(self, model: TextModel, passed: list[int]):
        self.model, self.passed = model, passed

    @staticmethod
    def fit(docs: DataFrame, text_col: str = "text") -> SecretScan:
        """Letter frequencies of the candidates without digits, then the p-values of all candidates.  Both are small tables."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        found = docs.select(F.explode(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("t")).distinct()  # a string that many texts share is one test
        letters = found.where(~F.col("t").rlike("[^A-Za-z]")).select(F.explode(F.split(F.lower("t"), "")).alias("c")).where("c <> ''").groupBy("c").count()
        model = TextModel({r["c"]: r["count"] for r in letters.collect()})
        scored = found.select(tests(F.col("t"), model).alias("x"))
        # strings unlike random ones aren't candidates of a secret at all, but count among the tests made
        shown = F.when(F.col("x.p_random") > ALPHA, p_class(F.col("x.p_text"))).otherwise(0)
        counts = scored.groupBy(length_class(F.col("x.n")).alias("s"), shown.alias("b")).count()
        return SecretScan(model, thresholds({(r["s"], r["b"]): r["count"] for r in counts.collect()}))

    def random_spans(self, text: Column, base: Column) -> Column:
        """Spans of candidates that pass and touch no base span."""

        def passes(c: Column) -> Column:
            limit = F.array(*[F.lit(b) for b in self.passed])
            return let(tests(c["t"], self.model), lambda x: (x["p_random"] > ALPHA) & (p_class(x["p_text"]) >= F.get(limit, length_class(x["n"]))) & (p_class(x["p_text"]) > 0))

        own = let(F.struct(candidates(text).alias("c"), base.alias("b")), lambda x: F.filter(apart(x["c"], x["b"]), passes))
        return F.transform(own, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))

    def spans(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds base_spans and secret_spans, arrays of (s, kind, e): code points, end exclusive.  A null text has none."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        docs = docs.withColumn("base_spans", base_spans(text))
        return docs.withColumn("secret_spans", F.array_sort(F.concat("base_spans", self.random_spans(text, F.col("base_spans")))))


def described(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts by base kind, the digest of the base spans, and all spans.

    A null or empty text has none; a null id stays null; repeated rows get equal results, and a
    string that many rows hold counts once in what is learnt.  Empty table: empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = SecretScan.fit(docs).spans(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(described(F.col("base_spans")), 256).alias("base_sha256"), described(F.col("secret_spans")).alias("spans"))


def _joined(text: Column, begin: Column, gaps: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """The stretches (a, b) of ``text``, whose first character is number ``begin``, joined by ``mark``.

    A character is found by counting from the start of its text, so stretches are taken from the text of their block.
    """
    if not sizes:
        return F.array_join(F.transform(gaps, lambda g: F.substring(text, g["a"] - begin + 1, g["b"] - g["a"])), mark)

    def block(h: Column) -> Column:
        part = F.slice(gaps, h, F.lit(sizes[0]))
        first, last = F.get(part, F.lit(0))["a"], F.element_at(part, -1)["b"]
        held = F.struct(part.alias("g"), first.alias("a"), F.substring(text, first - begin + 1, last - first).alias("t"))
        return let(held, lambda x: _joined(x["t"], x["a"], x["g"], mark, sizes[1:]))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(gaps), F.lit(sizes[0])), block), mark)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of secret spans in ``text`` replaced by ``mark``; ``n_chars`` follows, if there.

    Spans that overlap make one stretch.  Other columns, texts without secrets, null texts and the
    number of rows stay as they are.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("__rf_row"), "text")  # so that no column's name matters
    found = SecretScan.fit(rows).spans(rows)

    def cut(spans: Column) -> Column:
        """Between spans sorted by start there is a gap where the next start isn't before as many ends, sorted too."""
        bounds = F.struct(F.sort_array(F.transform(spans, lambda x: x["s"])).alias("s"), F.sort_array(F.transform(spans, lambda x: x["e"])).alias("e"))

        def gaps(x: Column) -> Column:
            each = F.transform(x["s"], lambda s, i: F.struct(F.when(i == 0, 0).otherwise(F.get(x["e"], i - 1)).alias("a"), s.alias("b")))
            return F.concat(F.filter(each, lambda g, i: (i == 0) | (g["b"] >= g["a"])), F.array(F.struct(F.element_at(x["e"], -1).alias("a"), F.length("text").alias("b"))))

        return let(let(bounds, gaps), lambda g: _joined(F.col("text"), F.lit(0), g, mark, (4096, 64)))

    some = F.size("secret_spans") > 0
    found = found.withColumn("__rf_clean", F.when(some, let(F.col("secret_spans"), cut)).otherwise(F.col("text")))
    row = F.col("__rf_row")
    out = {c: row[c] for c in columns} | {"text": F.col("__rf_clean")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(some, F.length("__rf_clean")).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[v.alias(c) for c, v in out.items()])
