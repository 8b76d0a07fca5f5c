"""One-permutation MinHash fingerprints, by built-in functions only.

All of a text's shingles are hashed once; the upper bits of a hash are its bin, and a bin's
minimum is its least hash, read off the sorted hashes.  An empty bin takes the value of a full
bin found by its own sequence of hashed places (optimal densification), so equal bins of two
texts borrow alike.  The low ``8`` bits of each bin are kept, two hex digits a bin; the
likeness of two fingerprints is their share of equal places, freed of chance hits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, KEPT_BITS, PROBES = 256, 8, 24
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once a row: inside a lambda a column is computed again for each element."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """Hashes of the k-word shingles; fewer words make one, none make none; a null text has none."""
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), "[\\x20\\x09-\\x0D]+")
    return let(words, lambda w: F.when(F.get(w, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))))


def _bin(h: Column) -> Column:
    """-BINS/2 to BINS/2 - 1, in the order of the signed hashes."""
    return F.shiftright(h, 56).cast("int")


def _kept(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("int")


def fingerprint(text: Column, k: int = 5) -> Column:
    """``BINS`` small numbers (array<int>); no shingles: an empty array."""

    def minima(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def dense(m: Column) -> Column:
        """Bin by bin; -1: empty."""
        none = F.lit(-1)
        gaps = F.transform(m, lambda x, i: F.concat(F.array_repeat(none, _bin(x) - F.when(i == 0, F.lit(-BINS // 2 - 1)).otherwise(_bin(F.get(m, i - 1))) - 1), F.array(_kept(x))))
        return F.concat(F.flatten(gaps), F.array_repeat(none, F.lit(BINS // 2 - 1) - _bin(F.element_at(m, -1))))

    def borrow(d: Column, m: Column, i: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda t: F.get(d, F.pmod(F.xxhash64(i, t), F.lit(BINS)).cast("int")))
        found = F.get(F.filter(tries, lambda v: v >= 0), F.lit(0))
        # few bins are full: the one that comes first in this bin's own order of all bins
        return F.coalesce(found, F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(i, _bin(x)), _kept(x).alias("v"))))["v"])

    def fill(m: Column) -> Column:
        return let(dense(m), lambda d: F.transform(d, lambda v, i: F.when(v >= 0, v).otherwise(borrow(d, m, i))))

    return let(F.sort_array(shingle_hashes(text, k)), lambda s: F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(let(minima(s), fill)))


def packed(bins: Column) -> Column:
    """The fingerprint as text: two hex digits a bin."""
    digits = F.array(*[F.lit(f"{i:02x}") for i in range(1 << KEPT_BITS)])
    return F.array_join(F.transform(bins, lambda v: F.get(digits, v)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1.  Two texts without shingles are alike, one is unlike any other."""
    chance = 2.0**-KEPT_BITS
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    found = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(found)


def _place(x: Column, bounds: list[int]) -> Column:
    """How many of the (sorted) bounds are greater; one more than all for null.  Searches in two steps."""
    n, step = len(bounds), max(1, math.isqrt(len(bounds)))
    if not bounds:
        return F.when(x.isNull(), F.lit(1)).otherwise(F.lit(0))

    def fine(c: Column) -> Column:
        upto = F.size(F.filter(F.slice(F.lit(bounds), (c - 1) * step + 1, F.lit(step)), lambda b: b <= x))
        return F.lit(n) - F.when(c == 0, F.lit(0)).otherwise((c - 1) * step + upto)

    coarse = F.size(F.filter(F.lit(bounds[::step]), lambda b: b <= x))
    return F.when(x.isNull(), F.lit(n + 1)).otherwise(let(coarse, fine))


#: At most so many quantiles of the ids are asked for; more buckets are made by parting these evenly.
QUANTILES = 2048


def _buckets(docs: DataFrame, n: int) -> Column:
    """A number for each row that doesn't fall as doc_id goes down, nulls last, of about ``n`` values."""
    q = min(n, QUANTILES)
    parts = -(-n // q)
    (bounds,) = docs.agg(F.percentile_approx("doc_id", [i / q for i in range(1, q)], 10 * q)).first()  # q - 1 numbers
    bounds = sorted(set(bounds or []))
    place = _place(F.col("doc_id"), bounds).cast("int")
    if parts == 1 or len(bounds) < 2:
        return place

    def parted(b: Column) -> Column:
        """Between two bounds ids are parted by their distance from the upper one; beyond them they aren't."""
        down, x = F.lit(bounds[::-1]), F.col("doc_id")
        upper, lower = F.get(down, b - 1), F.get(down, b)
        part = F.floor((upper - x).cast("double") / (upper - lower).cast("double") * parts).cast("int")
        return b * parts + F.coalesce(F.when(x.isNotNull(), F.least(part, F.lit(parts - 1))), F.lit(0))

    return let(place, parted)


def with_next(docs: DataFrame, columns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Adds next_text and next_<name> of the row that follows in descending doc_id (nulls last, ties by text; after the last the first).

    ``columns`` are made from the text, once for each row.  Rows are dealt to buckets of neighbouring
    ids by quantiles, of which there are a few for each shuffle partition; each bucket's last row takes the
    first of the next bucket, which is found from ids and texts alone.
    """
    bucket = _buckets(docs, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("bucket", bucket)
    # the first row of each bucket: found by its id alone, so that no text is moved for it
    top = docs.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    heads = docs.join(F.broadcast(top.withColumnRenamed("bucket", "b")), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("bucket").agg(F.min("text").alias("text"))  # one row a bucket
    order = Window.orderBy("bucket")
    turn = top.select("bucket", F.lag("bucket").over(order).alias("b"), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("z"))
    heads = heads.join(F.broadcast(turn), "bucket").select(F.coalesce("b", "z").alias("bucket"), F.struct("text", *[f(F.col("text")).alias(c) for c, f in columns.items()]).alias("h"))
    names = ["text", *columns]
    docs = docs.select("*", *[f(F.col("text")).alias(c) for c, f in columns.items()])
    row = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    led = docs.select("*", *[F.lead(c).over(row).alias(f"lead_{c}") for c in names])
    return led.join(heads, "bucket").select(*docs.drop("bucket").columns, *[F.when(F.col("lead_text").isNull(), F.col(f"h.{c}")).otherwise(F.col(f"lead_{c}")).alias(f"next_{c}") for c in names])


def edited_fingerprints(docs: DataFrame, k: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness to each other and to the next document's.

    The edited text has its last half (floor of n_chars / 2 code points) replaced by as many
    code points from the start of the next text, or all it has.  A null text counts as
    empty and its fingerprint is empty; rows with a null id come last; repeated rows follow one
    another, ordered by text; the only row of a table is its own next.  Empty table: empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, {"bins": lambda text: F.transform(fingerprint(text, k), lambda x: (x - 128).cast("tinyint"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), _whole("bins"), _whole("next_bins"), fingerprint(F.col("edited"), k).alias("edited_bins"))
    return rows.select("doc_id", "n_chars", "edited_sha256", packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"), likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))


def _whole(c: str) -> Column:
    """Bytes, which travel less 128, back to 0..255."""
    return F.transform(c, lambda x: x.cast("int") + 128).alias(c)
