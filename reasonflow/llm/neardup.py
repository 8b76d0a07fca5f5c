"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of ``shingle`` words.  Each element makes a
Poisson process of points, each point falling on a random register; a register keeps its
least point as floor(1 - log_b(point)), an exponentially spaced, truncated minimum.  Two
sketches merge by the maximum of each register.

Equal sets are one class from the start.  Classes meet in buckets of equal bands of
registers; the number of bands is set so that a pair at the threshold meets with a
probability of 1 - 1e-6 or more.  A pair goes on at once if its joint likelihood allows the
threshold, and is then confirmed on the full sets.  Each bucket links its members to its
least one, so a group of copies costs a row per member.  The members of all buckets that
still hold several components, those of unlikely pairs too, are then compared across components by
an exact prefix filter, so no link that a bucket can show is lost.  Components are found
among classes; equal documents take that of their class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U64, grams, hash_words, mix, signed, spread, steps, utf8, words
from .workspace import materialise

ROWS = 5
BASE, RATE, MOST = 1.001, 20.0, 65_535
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A pair is dropped unseen if its likelihood at the threshold is this much (in nats) below its best.
SLACK = 16.0


def bands(percent: int, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** ROWS)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, in order of both.  Fewer than k words: all of them as one."""
    data = LOWER[data]
    starts, ends, before = words(data, offsets)
    h, n = hash_words(data, starts, ends), np.diff(before)
    doc, rank = spread(np.maximum(n - k + 1, 0))
    value = grams(h, k)[before[doc] + rank] if len(doc) else np.zeros(0, U64)
    for few in range(1, k):
        d = np.flatnonzero(n == few)
        if len(d):
            doc = np.r_[doc, d]
            value = np.r_[value, grams(h, few, 0x9E6C63D0876A9A47 + 2 * few)[before[d]]]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[keep], value[keep]


def set_sketch(doc: np.ndarray, value: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Registers (n_docs x m) of the sets; those of empty sets are zero."""
    least = np.full(n_docs * m, np.inf)
    point, limit, j = np.zeros(len(doc)), np.full(n_docs, np.inf), 0
    with np.errstate(over="ignore"):
        while len(doc):
            j += 1
            r = mix(value + U64(j) * U64(0x9E3779B97F4A7C15))
            point = point - np.log1p(-((r >> U64(11)).astype(np.float64) * 2.0**-53)) / m
            on = point <= limit[doc]
            doc, value, point = doc[on], value[on], point[on]
            register = (mix(r[on] ^ U64(0xA0761D6478BD642F)) % U64(m)).astype(np.int64)
            np.minimum.at(least, doc * m + register, point)
            some = np.unique(doc)
            limit[some] = least.reshape(n_docs, m)[some].max(axis=1)
            on = point <= limit[doc]
            doc, value, point = doc[on], value[on], point[on]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / math.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, k), 0, MOST).astype(np.uint16).reshape(n_docs, m)


def log_likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the similarities ``j`` (pairs x values), given registers and set sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (na / (na + nb))[:, None]
    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
    tiny = 1e-12
    return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + (a.shape[1] - more - less) * np.log(np.maximum(1 - up - down, tiny))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity of each pair, and whether the threshold is likely enough to go on."""
    top = np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.linspace(0, 1, 65)[None, :] * top[:, None]
    ll = log_likelihood(a, b, na, nb, grid)
    best = ll.argmax(axis=1)
    at = log_likelihood(a, b, na, nb, np.minimum(np.maximum(grid[np.arange(len(best)), best], percent / 100), top)[:, None])[:, 0]
    return grid[np.arange(len(best)), best], (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (at >= ll.max(axis=1) - SLACK)


def _sketches(shingle: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                n_docs = batch.num_rows
                doc, value = shingle_sets(*utf8(batch.column("text")), shingle)
                n = np.bincount(doc, minlength=n_docs)
                at = np.r_[0, np.cumsum(n)]
                with np.errstate(over="ignore"):
                    sums = [np.r_[np.zeros(1, U64), np.cumsum(mix(value ^ U64(c)), dtype=U64)] for c in (0x51ED270B, 0xC2B2AE3D27D4EB4F)]
                    s1, s2 = (signed(s[at[1:]] - s[at[:-1]]) for s in sums)
                k = set_sketch(doc, value, n_docs, m)
                blob = pa.array([row.tobytes() for row in k], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), blob], names=["doc_id", "n_shingles", "s1", "s2", "sketch"])

    return run


def _bucket_keys(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k = registers(batch.column("sketch"), m).astype(U64).reshape(batch.num_rows, m // ROWS, ROWS)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(mix(np.arange(1, m // ROWS + 1, dtype=U64)), k.shape[:2])
                    for i in range(ROWS):
                        key = mix(key * U64(0x9E3779B97F4A7C15) + k[:, :, i])
                rows = pa.array(np.repeat(np.arange(batch.num_rows), m // ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), batch.column("rep").take(rows)], names=["key", "rep"])

    return run


def registers(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), m)


def _likely(m: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                na, nb = (batch.column(c).to_numpy() for c in ("nx", "ny"))
                _, on = estimate(registers(batch.column("kx"), m), registers(batch.column("ky"), m), na, nb, percent)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("x", "y")], names=["x", "y"]).filter(pa.array(on))

    return run


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "tx"):
                (dx, vx), (dy, vy) = (shingle_sets(*utf8(batch.column(c)), shingle) for c in ("tx", "ty"))
                n = np.bincount(dx, minlength=batch.num_rows) + np.bincount(dy, minlength=batch.num_rows)
                d, v = np.r_[dx, dy], np.r_[vx, vy]
                order = np.lexsort((v, d))
                d, v = d[order], v[order]
                both = np.bincount(d[1:][(d[1:] == d[:-1]) & (v[1:] == v[:-1])], minlength=batch.num_rows)
                on = (both > 0) & (100 * both >= percent * (n - both))
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(on))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Linked: 100 * intersection >= percent * union of the shingle sets.  component_id is the
    least id reachable over links.  Sets of null, empty and blank texts are empty and linked
    with nothing.  Rows with one id are one node; a null id is linked with nothing
    and has a null component.  Empty table: empty result.
    """
    m = ROWS * bands(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(docs.mapInArrow(_sketches(shingle, m), "doc_id long, n_shingles long, s1 long, s2 long, sketch binary"), "sketches")
    nodes = rows.where("n_shingles > 0 and doc_id is not null")
    same = ["s1", "s2", "n_shingles"]
    classes = materialise(nodes.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch")), "classes")
    members = materialise(nodes.join(classes.select(*same, "rep"), same).select("doc_id", "n_shingles", "rep"), "members")
    # an id whose rows have several sets links their classes
    several = materialise(members.groupBy("doc_id").agg(F.min("rep").alias("c0"), F.max("rep").alias("c1")).where("c0 < c1").select("doc_id"), "several")
    bridges = members.join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    keys = classes.mapInArrow(_bucket_keys(m), "key long, rep long")
    shared = materialise(keys.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("other")).where("centre < other").drop("other"), "shared")
    buckets = materialise(keys.join(shared, "key").select("key", "rep", "centre"), "buckets")
    pairs = buckets.where("rep <> centre").select(F.col("rep").alias("x"), F.col("centre").alias("y")).distinct()
    likely = _likely_pairs(pairs, classes, percent, m)
    # all texts that may be wanted are fetched at once, by one deal of the documents at any size
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialise(docs.join(wanted.hint("merge"), "doc_id").distinct(), "texts")  # rows that share an id make a text each: any pair of theirs may link
    links = _confirmed(likely, texts, shingle, percent)

    # a first name for what belongs together, one link deep: too many names cost comparisons, no links
    label = links.groupBy(F.col("x").alias("rep")).agg(F.min("y").alias("component"))
    named = buckets.select("key", "rep").join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = materialise(named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key"), "mixed")
    rest = materialise(named.join(mixed, "key").select("rep", "component").distinct(), "rest")
    links = links.unionByName(_exact_links(rest, texts, shingle, percent))

    found = materialise(connected_components(links.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(bridges)), "components")
    named = members.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    # rows without shingles stand alone, or go with other rows of their id
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
    others = members.join(alone.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    others = others.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("found"))
    alone = alone.join(others, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
    return named.unionByName(alone)


def _exact_links(rest: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links that join all components of ``rest`` (rep, component) that any links join, by prefix filtering.

    Rows of one component must be joined already; a component may have several names.

    Under one order of all shingles, rarest first, two linked sets share one of the first
    n - ceil(percent n / 100) + 1 shingles of both, and of the smaller set even one of the first
    n - ceil(2 percent n / (100 + percent)) + 1.  At the first shingle that they share, what is left of either is
    no smaller than the overlap that the threshold asks for.  A passage common to many documents
    comes last in that order, so those with much else to them make no pairs.  Documents first
    meet, for each shingle, the one that has it earliest; pairs are made between those that are
    in different components still.
    """
    rest = rest.withColumnRenamed("rep", "doc_id")
    texts = materialise(texts.join(rest.select("doc_id"), "doc_id"), "rest-texts")
    tokens = texts.select("doc_id", "text").mapInArrow(_tokens(shingle), "doc_id long, row long, n long, token long")
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    order = Window.partitionBy("doc_id", "row").orderBy("often", "token")
    upto = lambda a, b: F.col("n") - F.expr(f"(n * {a} + {b - 1}) div {b}") + 1  # noqa: E731  n - ceil(n a / b) + 1
    prefix = tokens.join(often, "token").withColumn("place", F.row_number().over(order)).where(F.col("often") > 1).where(F.col("place") <= upto(percent, 100))
    prefix = prefix.select("doc_id", "n", "token", (F.col("n") - F.col("place") + 1).alias("left"), (F.col("place") <= upto(2 * percent, 100 + percent)).alias("early"))
    prefix = materialise(prefix, "prefix")

    def mixed(rest: DataFrame) -> DataFrame:
        """Places of the shingles that several components share, with the component."""
        named = prefix.join(rest, "doc_id")
        several = named.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("token")
        return named.join(materialise(several, "several"), "token")

    def allowed(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        enough = F.least(f"{x}.left", f"{y}.left") * (100 + percent) >= (n + m) * percent
        return (F.col(f"{x}.component") != F.col(f"{y}.component")) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & enough

    def pairs(x: DataFrame, y: DataFrame, more: Column) -> DataFrame:
        found = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & allowed("x", "y") & more)
        ids = (F.col("x.doc_id"), F.col("y.doc_id"))
        return found.select(F.greatest(*ids).alias("x"), F.least(*ids).alias("y")).distinct()

    rows = mixed(rest)
    first = rows.groupBy("token").agg(F.min(F.struct((1 - F.col("left") / F.col("n")).alias("share"), "n", "doc_id", "left", "component")).alias("c")).select("token", "c.*")
    links = _confirmed(pairs(rows, materialise(first, "first"), F.lit(True)), texts.select("doc_id", "text"), shingle, percent)
    named = links.join(rest.select(F.col("doc_id").alias("x"), F.col("component").alias("u")), "x").join(rest.select(F.col("doc_id").alias("y"), F.col("component").alias("v")), "y")
    joined = named.select("u", "v").unionByName(named.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("joined")).where("joined < node")
    rest = materialise(rest.join(joined, F.col("component") == F.col("node"), "left").select("doc_id", F.coalesce("joined", "component").alias("component")), "rest")
    rows = mixed(rest)
    last = pairs(rows, rows.where("early"), F.col("x.n") >= F.col("y.n"))
    return links.unionByName(_confirmed(last, texts.select("doc_id", "text"), shingle, percent))


def _tokens(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33  # rows that share an id are sets of their own
        for whole in batches:
            for batch in steps(whole, "text"):
                doc, value = shingle_sets(*utf8(batch.column("text")), shingle)
                n = np.bincount(doc, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(row + doc), pa.array(n[doc]), pa.array(signed(value))], names=["doc_id", "row", "n", "token"])
                row += batch.num_rows

    return run


def _likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int, m: int) -> DataFrame:
    """Those of the pairs (x, y) of class representatives whose sketches allow a link."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"k{s}"))
    return materialise(pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(_likely(m, percent), "x long, y long"), "likely")


def _confirmed(likely: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those pairs (x, y) whose full sets are linked."""
    told = likely.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty")), "y")
    return materialise(told.mapInArrow(_confirm(shingle, percent), "x long, y long").distinct(), "links")
