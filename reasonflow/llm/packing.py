"""Best-two-fit packing of tokenised documents into fixed-length sequences.

The packing is planned on the histogram of piece lengths alone, which has at most
``capacity`` entries however large the corpus is: one planned bin stands for as many
equal bins as the counts allow.  Pieces then find their bin by their rank among the
pieces of equal length; ranks are counted per input partition and summed over
partitions, so no task sees more than one partition's pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import steps
from .tokens import encoder
from .workspace import materialise


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in order, how many such bins).  Every counted piece is placed.

    A bin is filled greedily, always with the longest piece that fits.  While a gap is
    left, its smallest piece is taken out and two unpacked pieces that fill the widened
    gap more tightly go in, if there are such.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("piece lengths must be from 1 to the capacity")
    there = sum(1 << n for n in left)  # bit n: pieces of length n are left
    out = []
    while there:
        need: Counter[int] = Counter()
        free, bin_, gap = there, [], capacity

        def take(n: int) -> None:
            nonlocal free
            need[n] += 1
            if left[n] == need[n]:
                free &= ~(1 << n)

        while fits := free & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            take(n)
            bin_.append(n)
            gap -= n
        while gap and len(bin_) > 1:
            smallest = bin_[-1]
            need[smallest] -= 1
            pool, room, best = free | (1 << smallest), gap + smallest, (smallest, 0, 0)
            below = pool & ((1 << room) - 1)
            while below and best[0] < room:
                a = below.bit_length() - 1
                if 2 * a <= best[0]:
                    break
                rest = pool & ((1 << (min(a, room - a) + 1)) - 1)
                if rest >> a & 1 and left[a] - need[a] < 2:
                    rest &= ~(1 << a)
                b = rest.bit_length() - 1
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                below &= ~(1 << a)
            if not best[1]:
                need[smallest] += 1
                break
            free = pool
            bin_.pop()
            take(best[1])
            take(best[2])
            bin_ = sorted([*bin_, best[1], best[2]], reverse=True)
            gap = room - best[0]
        times = min(left[n] // c for n, c in need.items() if c)
        for n, c in need.items():
            left[n] -= c * times
            if not left[n]:
                there &= ~(1 << n)
        out.append((bin_, times))
    return out


def slots(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, base, offset): the piece of that length and rank lo <= r < hi goes to sequence base + r - lo."""
    seen: Counter[int] = Counter()
    out, base = [], 0
    for lengths, times in bins:
        offset = 0
        for n in lengths:
            out.append((n, seen[n], seen[n] + times, base, offset))
            seen[n] += times
            offset += n
        base += times
    return out


def tokenised_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and the rank among equal lengths of its partition.

    A null text counts as empty and gives one piece with the end id alone; repeated
    rows give repeated pieces.  Only documents longer than ``capacity`` are cut; the
    remainder comes first.  ``with_ids`` adds the ids themselves, as little-endian unsigned 32-bit numbers.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer)
        for whole in batches:
            for batch in steps(whole, "text"):
                ids, at = enc.encode(batch.column("text"), end)
                n = np.diff(at)
                first = (n - 1) % capacity + 1  # length of the first piece
                count = (n - first) // capacity + 1
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                begin = at[doc] + start
                crc = [zlib.crc32(ids[b : b + m]) for b, m in zip(begin.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                same = length[order]
                run_start = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
                rank = np.arange(len(same)) - np.repeat(run_start, np.diff(np.r_[run_start, len(same)]))
                nth = np.empty(len(same), np.int64)
                nth[order] = rank + seen[same]
                seen += np.bincount(same, minlength=capacity + 1)
                cols = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    # pieces lie end to end in ids, so their ends are the list offsets
                    ends = np.r_[0, 4 * np.cumsum(length)].astype(np.int64)
                    cols.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces that carry length, part and nth.

    ``pieces`` must read a written table: its rows are visited three times.  The plan
    sent to the executors depends on ``capacity`` alone (a few rows for each length), so
    it may be broadcast at any corpus size.  No pieces: an empty table.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.max("nth").alias("n"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum(F.col("n") + 1).alias("n")).collect()}
    table = slots(plan_bins(by_length, capacity))
    plan = spark.createDataFrame(table, "slot_length long, lo long, hi long, base long, offset long")
    before = counts.select("part", "length", (F.sum(F.col("n") + 1).over(Window.partitionBy("length").orderBy("part")) - F.col("n") - 1).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("lo")).drop("part", "nth", "before", "rank", "slot_length", "lo", "hi", "base")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024, with_ids: bool = False, **columns: str) -> DataFrame:
    """Tokenises and packs ``docs``: one row per piece with its sequence and place there."""
    pieces = materialise(tokenised_pieces(docs, tokenizer, end, capacity, with_ids=with_ids, **columns), "pieces")
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of ``pack_documents(..., with_ids=True)``: sequence_id, length, ids (bytes, as of the pieces), doc_ids.  Each has one row, of ``capacity`` ids at the most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", F.aggregate("p.ids", F.unhex(F.lit("")), lambda a, x: F.concat(a, x)).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
