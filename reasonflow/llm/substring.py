"""Exact repeats between documents by seed and extend.

Seeds: every window of ``min_words`` words picks the least of its ``SEED``-word hashes
(the last among equals) as its anchor, so equal windows pick equal anchors at equal
offsets, and a run of neighbouring windows shares one anchor.

Extension: an anchor is extended both ways over its run of windows, up to
``2 * min_words`` words or so.  Occurrences with one extended content form a class.  An anchor
of one class is decided there: all but the earliest document repeat it.  Where an anchor
has several classes, what later documents of a class hold is repeated too, and the earliest
document of each has its windows compared one by one.  Overlapping and touching windows merge
to maximal repeats.

Classes are found by aggregation, which is summed before it is dealt, and only the earliest
document of a class is told of it: what a document isn't told of, an earlier one has.  So a passage
common to any number of documents makes one row that travels, not one a document, and all that
documents are joined with is a list each, by their own id, no longer than their own text.

Hash values of 64 bits pair up to 128 bits wherever a match is decided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, grams, hash_words, mix, signed, sliding_argmin, spread, steps, utf8, words
from .workspace import discard, materialise

SEED = 20
BASES = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)
OWN, OPEN, WINDOWS = "__rf_own", "__rf_open", "__rf_windows"


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One label of two hashes, to be compared within a document only."""
    with np.errstate(over="ignore"):
        return mix(mix(a.view(U64)) + b.view(U64) * U64(3))


class _Runs:
    """The runs of windows of a batch of texts: document, first word, number of windows, anchor and content of each."""

    def __init__(self, batch: pa.RecordBatch, min_words: int):
        self.data, self.offsets = utf8(batch.column("text"))
        self.starts, self.ends, self.before = words(self.data, self.offsets)
        h = hash_words(self.data, self.starts, self.ends)
        doc, rank = spread(np.maximum(np.diff(self.before) - min_words + 1, 0))
        at = self.before[doc] + rank
        none = np.zeros(0, np.int64)
        self.doc, self.first, self.size, self.anchor, self.content = (none,) * 5
        if len(at):
            seed = grams(h, SEED)
            pick = sliding_argmin(seed, min_words - SEED + 1)[at]
            window = grams(h, min_words, BASES[0])
            head = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])])
            self.size = np.diff(np.r_[head, len(at)])
            self.first, last = at[head], at[head + self.size - 1]
            with np.errstate(over="ignore"):
                content = mix(window[self.first] + mix(window[last]) * U64(3) + mix((self.size * 4096 + pick[head] - self.first).astype(U64)))
            self.doc, self.anchor, self.content = doc[head], signed(seed[pick[head]]), signed(content)

    def windows(self, some: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
        """Document, first word and both hashes of each window of ``some`` runs."""
        run, k = spread(self.size[some])
        at = self.first[some][run] + k
        a, b = (signed(grams(hash_words(self.data, self.starts, self.ends, s), min_words, BASES[s - 1])) for s in (1, 2))
        return self.doc[some][run], at, a[at], b[at]


def _anchors(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                r = _Runs(batch, min_words)
                if len(r.doc):
                    yield pa.RecordBatch.from_arrays([pa.array(r.anchor), pa.array(r.content), batch.column("doc_id").take(pa.array(r.doc))], names=["anchor", "content", "doc_id"])

    return run


def _told(batch: pa.RecordBatch, column: str, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the labels are in the list of their document."""
    lists = batch.column(column)
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        key = lambda d, x: mix(x.view(U64) + mix(d.astype(U64)))
        return np.isin(key(doc, label), key(np.repeat(np.arange(len(n)), n), flat))


def _single_windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                r = _Runs(batch, min_words)
                doc, _, a, b = r.windows(_told(batch, OPEN, r.doc, _pair(r.anchor, r.content)), min_words)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column("doc_id").take(pa.array(doc))], names=["w1", "w2", "doc_id"])

    return run


def _label(out: str, *keys: str):
    """``_pair`` of two columns, and the id of the document that is told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in keys)
            rest = [c for c in batch.schema.names if c not in keys]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(signed(_pair(a, b)))], names=[*rest, out])

    return run


def with_first_sights(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` (doc_id, text and others) with what each row is told of its runs of windows.

    Three lists of labels: runs that no earlier document has and that have no variant elsewhere, runs
    that no earlier document has whole, and windows of these that no earlier document has.  A
    null id has no order: such rows neither repeat others nor are repeated.  Rows that share
    an id don't repeat each other.
    """
    if not SEED < min_words < SEED + 62:
        raise ValueError(f"min_words must be over {SEED} and under {SEED + 62}")
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    occurrences = known.mapInArrow(_anchors(min_words), "anchor long, content long, doc_id long")
    classes = materialise(occurrences.groupBy("anchor", "content").agg(F.min("doc_id").alias("doc_id")), "classes")
    anchors = materialise(classes.groupBy("anchor").agg(F.min("doc_id").alias("doc_id"), F.min("content").alias("content"), (F.min("content") != F.max("content")).alias("varied")), "anchors")
    plain = anchors.where("not varied").select("doc_id", "anchor", "content", "varied")
    # the small side is written: both sides of the join are dealt for it alone, and Spark can split a hot anchor
    varied = classes.join(anchors.where("varied").select("anchor", "varied"), "anchor").select("doc_id", "anchor", "content", "varied")
    told = plain.unionByName(varied).mapInArrow(_label("label", "anchor", "content"), "doc_id long, varied boolean, label long")
    by_doc = told.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("varied"), F.col("label"))).alias(OWN), F.collect_list(F.when(F.col("varied"), F.col("label"))).alias(OPEN))
    by_doc = materialise(by_doc, "first-sights")
    discard(classes)
    discard(anchors)
    windows = known.join(by_doc.where(f"size({OPEN}) > 0").select("doc_id", OPEN), "doc_id").select("doc_id", "text", OPEN).mapInArrow(_single_windows(min_words), "w1 long, w2 long, doc_id long")
    firsts = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("doc_id")).mapInArrow(_label("label", "w1", "w2"), "doc_id long, label long")
    firsts = firsts.groupBy("doc_id").agg(F.collect_list("label").alias(WINDOWS))
    lists = materialise(by_doc.join(firsts, "doc_id", "left").withColumnRenamed("doc_id", "__rf_id"), "told")
    discard(by_doc)
    return docs.join(lists, F.col("doc_id").cast("long") == F.col("__rf_id"), "left").drop("__rf_id")


def _repeated(batch: pa.RecordBatch, min_words: int) -> tuple[_Runs, np.ndarray]:
    """The runs of a batch, and which of its words are in a repeated window."""
    r = _Runs(batch, min_words)
    label = _pair(r.anchor, r.content)
    ordered = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[r.doc]
    open_ = _told(batch, OPEN, r.doc, label)
    later = ordered & ~open_ & ~_told(batch, OWN, r.doc, label)
    edge = np.zeros(int(r.before[-1]) + 1, np.int64)
    np.add.at(edge, r.first[later], 1)
    np.add.at(edge, r.first[later] + r.size[later] + min_words - 1, -1)
    if open_.any():
        doc, at, a, b = r.windows(open_, min_words)
        at = at[~_told(batch, WINDOWS, doc, _pair(a, b))]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + min_words, -1)
    return r, np.cumsum(edge[:-1]) > 0


def _kept_texts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words that stay, each followed by a space, and where each document's begin."""
    size = (ends - starts + 1) * ~gone
    word, rank = spread(size)
    source = starts[word] + rank
    out = np.full(len(source), 32, np.uint8)
    inside = source < ends[word]
    out[inside] = data[source[inside]]
    return out, np.r_[0, np.cumsum(size)][before]


def substring_digests(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256.

    A null or empty text has no words; a null id is never removed from; repeated rows keep
    one another's words, as they share an id.  Empty table: empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                r, gone = _repeated(batch, min_words)
                kept, at = _kept_texts(r.data, r.offsets, r.starts, r.ends, r.before, gone)
                lost = np.diff(np.r_[0, np.cumsum(gone)][r.before])
                sha = [hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(r.before)), pa.array(lost), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = with_first_sights(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Maximal repeats: doc_id, first word, end word (exclusive); at least ``min_words`` long.  A row a repeat of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                r, gone = _repeated(batch, min_words)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(r.before))
                turn = np.flatnonzero(np.r_[True, (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])]) if len(gone) else np.zeros(0, np.int64)
                end = np.r_[turn[1:], len(gone)][: len(turn)]
                turn, end = turn[gone[turn]], end[gone[turn]]
                own = r.before[doc[turn]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[turn])), pa.array(turn - own), pa.array(end - own)], names=["doc_id", "first_word", "end_word"])

    rows = with_first_sights(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words)
    return rows.mapInArrow(run, "doc_id long, first_word long, end_word long")


def remove_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` (doc_id, text and any others) with repeated windows cut out of ``text``.

    Texts without a repeat stay byte for byte; in the others the words that stay are
    joined by one space and ``n_chars``, if there is such a column, is counted anew.
    All columns and rows stay; a null text stays null.
    """
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                r, gone = _repeated(batch, min_words)
                lost = np.diff(np.r_[0, np.cumsum(gone)][r.before])
                old = batch.column("text").to_pylist()
                if lost.any():
                    kept, at = _kept_texts(r.data, r.offsets, r.starts, r.ends, r.before, gone)
                    for i in np.flatnonzero(lost).tolist():
                        old[i] = kept[at[i] : max(at[i], at[i + 1] - 1)].tobytes().decode("utf-8", "replace")
                cols = {f.name: batch.column(f.name) for f in fields} | {"text": pa.array(old, pa.string())}
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(old, batch.column("n_chars").to_pylist(), strict=True)], batch.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return with_first_sights(docs, min_words).mapInArrow(run, fields)
