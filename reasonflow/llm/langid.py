"""Language spans of mixed texts: scripts narrow the candidates, Viterbi over words decides.

A word's score for a language sums the log-likelihoods of its byte 3- and 4-grams (the spaces
around it count, ASCII letters in lower case).  Languages not seen in the word's script are
all but excluded.  Viterbi over a document's words, with one penalty for each
switch, labels spans; documents of a batch advance together, a word at a time.  A long
document is cut into stretches that advance together from every state, and are then linked.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SPACE, STEP_BYTES, steps, utf8, words
from .quality import fold

BITS = 17
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Documents of more words are labelled stretch by stretch.
LONG = 2048
#: First code point of each range and its script; 0: none that narrows.  Only letters have a script.
RANGES = [(0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xA00, 9), (0xA80, 10), (0xB00, 11), (0xB80, 12), (0xC00, 13), (0xC80, 14), (0xD00, 15), (0xD80, 16), (0xE00, 17), (0xE80, 18), (0xF00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 24), (0x3100, 0), (0x3400, 25), (0xA000, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 25), (0xFB00, 0), (0x20000, 25), (0x31350, 0)]
N_SCRIPTS = 26
FIRST, SCRIPT = (np.array(x) for x in zip(*RANGES, strict=True))
EXCLUDED = -30.0
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters: those of a Unicode category L."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def scripts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each byte that begins a character: whether it is a letter, and the script of a letter (else 0)."""
    table = letter_table()
    letter = table[:256][data]
    out = np.where(letter, SCRIPT[np.searchsorted(FIRST, np.arange(256), side="right") - 1][data], 0)
    high = np.flatnonzero(data >= 128)
    out[high], letter[high] = 0, False
    lead = high[data[high] >= 0xC2]
    if len(lead):
        padded = np.r_[data, np.zeros(4, np.uint8)].astype(np.int64)
        b, c1, c2, c3 = (padded[lead + i] & m for i, m in ((0, 255), (1, 63), (2, 63), (3, 63)))
        point = np.where(b < 0xE0, (b & 31) << 6 | c1, np.where(b < 0xF0, (b & 15) << 12 | c1 << 6 | c2, (b & 7) << 18 | c1 << 12 | c2 << 6 | c3))
        letter[lead] = table[point]
        out[lead] = np.where(letter[lead], SCRIPT[np.searchsorted(FIRST, point, side="right") - 1], 0)
    return letter, out


def word_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words before each document, bytes of each word, script of each word, its letters, and (byte x 2) gram places."""
    n_docs = len(offsets) - 1
    size = np.diff(offsets)
    flat = np.full(len(data) + n_docs + 4, 32, np.uint8)  # a space before each document and some after the last
    flat[np.arange(len(data)) + np.repeat(np.arange(n_docs), size) + 1] = data
    starts, ends, before = words(flat, np.r_[offsets[:-1] + np.arange(n_docs), len(flat)])
    length = ends - starts
    letter, kind = scripts(flat)
    letters = np.r_[0, np.cumsum(letter)]
    script = np.maximum.reduceat(kind, starts) if len(starts) else np.zeros(0, np.int64)
    at = np.repeat(starts - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum())) if len(starts) else np.zeros(0, np.int64)
    low = np.where(flat < 33, 32, LOWER[flat]).astype(np.uint32)
    with np.errstate(over="ignore"):
        three = low[at - 1] * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + low[at + 1] * np.uint32(0xC2B2AE3D)
        four = three * np.uint32(0x27D4EB2F) + low[at + 2] * np.uint32(0x165667B1)
        three, four = ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS) for x in (three, four))
    crosses = at + 2 > np.repeat(ends, length)
    four = np.where(crosses, three, four)
    return before, length, script, letters[ends] - letters[starts], np.stack([three, four], axis=1).astype(np.int32)


class LanguageModel:
    """Log-likelihood tables (grams x languages) and the scripts of each language."""

    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray, prior: np.ndarray, penalty: float):
        self.langs, self.table, self.allowed, self.prior, self.penalty = langs, table, allowed, prior, penalty

    def word_scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before, length, script, letters, at = word_grams(data, offsets)
        if not len(length):
            return before, letters, np.zeros((0, len(self.langs)), np.float32)
        each = self.table[at[:, 0]] + self.table[at[:, 1]]
        total = np.add.reduceat(each, np.cumsum(length) - length, axis=0)
        total += self.allowed[script]
        total[letters == 0] = 0
        return before, letters, total

    def forward(self, v: np.ndarray | None, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers of the words of one document, and the values of all states at its end, from those before it (none: the first words).

        Stretches as many as they are long advance from every state at once; linked, they give
        the values that each begins with, from which they advance again with backpointers.
        """
        k, own = len(self.langs), np.arange(len(self.langs))
        came = np.zeros((len(scores), k), np.uint8 if k < 256 else np.int32)
        scores = scores.astype(np.float64)
        done = 0
        if v is None:
            v, done = self.prior + scores[0], 1
        size = int((len(scores) - done) ** 0.5)
        some = (len(scores) - done) // size if size else 0
        part = scores[done : done + some * size].reshape(some, size, k)
        value = np.repeat(np.where(own[:, None] == own, 0.0, -np.inf)[None], some, axis=0)
        for t in range(size):
            value = np.maximum(value, value.max(axis=2, keepdims=True) - self.penalty) + part[:, t, None, :]
        begin = np.empty((some, k))
        for s in range(some):
            begin[s] = v
            v = (v[:, None] + value[s]).max(axis=0)
        now, back = begin, came[done : done + some * size].reshape(some, size, k)
        for t in range(size):
            now = self._step(now, back[:, t]) + part[:, t]
        for t in range(done + some * size, len(scores)):
            v = self._step(v[None], came[t : t + 1])[0] + scores[t]
        return came, v

    def _step(self, v: np.ndarray, came: np.ndarray) -> np.ndarray:
        """Values (rows x states) before the next word's scores; where each came from goes to ``came``."""
        top = v.argmax(axis=1)
        switched = v[np.arange(len(v)), top][:, None] - self.penalty
        stay = v >= switched
        came[...] = np.where(stay, np.arange(v.shape[1]), top[:, None])
        return np.where(stay, v, switched)

    def backward(self, came: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """The states of the words of one document that ends in ``state``, and the state before them."""
        n, k = came.shape
        out, size = np.zeros(n, came.dtype), int(n**0.5)
        some = n // size
        for t in range(n - 1, some * size - 1, -1):
            out[t], state = state, int(came[t, state])
        part = came[: some * size].reshape(some, size, k)
        ends = np.repeat(np.arange(k)[None], some, axis=0)  # where each end state of a stretch leads before it
        for t in range(size - 1, -1, -1):
            ends = np.take_along_axis(part[:, t], ends, axis=1).astype(np.int64)
        last = np.zeros(some, np.int64)
        for s in range(some - 1, -1, -1):
            last[s], state = state, int(ends[s, state])
        for t in range(size - 1, -1, -1):
            out[t : some * size : size] = last
            last = part[np.arange(some), t, last].astype(np.int64)
        return out, state

    def label(self, before: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The language of each word on the best path of its document."""
        n = np.diff(before)
        long = np.flatnonzero(n > LONG)
        if len(long):
            out = np.zeros(len(scores), np.int32)
            for i in long.tolist():
                came, v = self.forward(None, scores[before[i] : before[i + 1]])
                out[before[i] : before[i + 1]], _ = self.backward(came, int(v.argmax()))
            rest = np.ones(len(scores), bool)
            for i in long.tolist():
                rest[before[i] : before[i + 1]] = False
            out[rest] = self.label(np.r_[0, np.cumsum(np.where(n > LONG, 0, n))], scores[rest])
            return out
        order = np.argsort(-n, kind="stable")
        first, n = before[:-1][order], n[order]
        longest = int(n[0]) if len(n) else 0
        active = len(n) - np.searchsorted(n[::-1], np.arange(longest), side="right")
        came = np.zeros(scores.shape, np.uint8 if len(self.langs) < 256 else np.int32)
        own = np.arange(len(self.langs))
        best = np.repeat(self.prior[None, :].astype(np.float64), len(n), axis=0)
        for t in range(longest):
            a = active[t]
            v, at = best[:a], first[:a] + t
            if t:
                at_came = np.zeros((a, len(own)), came.dtype)
                v = self._step(v, at_came)
                came[at] = at_came
            best[:a] = v + scores[at]
        out = np.zeros(len(scores), came.dtype)
        state = best.argmax(axis=1) if len(n) else np.zeros(0, np.int64)
        for t in range(longest - 1, -1, -1):
            a = active[t]
            at = first[:a] + t
            out[at] = state[:a]
            state[:a] = came[at, state[:a]]
        return out


def _count(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(langs)}
        counts, kinds = np.zeros((1 << BITS, len(langs)), np.float32), np.zeros((N_SCRIPTS, len(langs)))
        for whole in batches:
            for batch in steps(whole, "text"):
                lang = np.array([place[x] for x in batch.column("lang").to_pylist()])
                before, length, script, _, at = word_grams(*utf8(batch.column("text")))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(before))
                np.add.at(kinds, (script, lang[doc]), 1)
                one = np.repeat(lang[doc], length)
                for j in (0, 1):
                    np.add.at(counts, (at[:, j], one), 1)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((counts, kinds))], pa.binary())], names=["c"])

    return run


def fit_languages(docs: DataFrame, most: int = 1500, penalty: float = 12.0) -> LanguageModel:
    """Learns from the text and lang of at most about ``most`` documents of each language outside fold 1, whole texts.

    Rows without an id, a language or a text teach nothing; no such rows: a model without
    languages.  Rows are drawn by a hash of their id; where ids repeat, twice ``most`` rows
    a language in the order of the hash at the most.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(fold(F.col("doc_id")) != 1)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros((N_SCRIPTS, 0), np.float32), np.zeros(0), penalty)
    share = F.create_map([F.lit(x) for k in langs for x in (k, min(1.0, most / sizes[k]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < share[F.col("lang")]).orderBy(draw / share[F.col("lang")], "doc_id", "text").limit(2 * most * len(langs)).select("text", "lang")
    (blob,) = chosen.repartition(1).mapInArrow(_count(langs), "c binary").first()
    counts, kinds = pickle.loads(bytes(blob))
    p = (counts + 0.05) / (counts.sum(axis=0) + 0.05 * len(counts))
    table = np.log(p)
    table -= table.mean(axis=1, keepdims=True)
    seen = kinds / np.maximum(kinds.sum(axis=0), 1) >= 0.01
    seen[0] = True
    seen[~seen.any(axis=1)] = True
    allowed = np.where(seen, 0, EXCLUDED)
    total = np.array([sizes[x] for x in langs], float)
    return LanguageModel(langs, table.astype(np.float32), allowed.astype(np.float32), np.log(total / total.sum()), penalty)


def _labelled(model: LanguageModel, whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a batch: the rows, words before each document, letters of each word and its language.

    A text longer than a slice is scored part by part, cut between words; of a part only the letters
    and backpointers of its words stay in memory.
    """
    for batch in steps(whole, "text"):
        data, offsets = utf8(batch.column("text"))
        if len(data) <= 2 * STEP_BYTES:
            before, letters, scores = model.word_scores(data, offsets)
            yield batch, before, letters, model.label(before, scores)
            continue
        v, parts, begin = None, [], 0  # one long text
        while begin < len(data):
            space = np.flatnonzero(SPACE[data[begin + STEP_BYTES : begin + 2 * STEP_BYTES]]) if begin + STEP_BYTES < len(data) else ()
            end = begin + STEP_BYTES + int(space[0]) if len(space) else begin + STEP_BYTES
            while end < len(data) and not SPACE[data[end]]:  # a word of more than a slice
                more = np.flatnonzero(SPACE[data[end : end + STEP_BYTES]])
                end = min(len(data), end + (int(more[0]) if len(more) else STEP_BYTES))
            end = min(end, len(data))
            _, letters, scores = model.word_scores(data[begin:end], np.array([0, end - begin]))
            if len(letters):
                came, v = model.forward(v, scores)
                parts.append((letters, came))
            begin = end
        out, state = [], 0 if v is None else int(v.argmax())
        for _, came in reversed(parts):
            labels, state = model.backward(came, state)
            out.append(labels)
        none = np.zeros(0, np.int64)
        label = np.concatenate([none, *out[::-1]]).astype(np.int64)
        yield batch, np.array([0, len(label)]), np.concatenate([none, *(x for x, _ in parts)]), label


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        k = len(m.langs)
        for whole in batches:
            if not k:
                n = whole.num_rows
                yield pa.RecordBatch.from_arrays([whole.column("doc_id"), pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n))], names=["doc_id", "lang_pred", "score"])
                continue
            for batch, before, letters, label in _labelled(m, whole):
                n = batch.num_rows
                names, score = ["und"] * n, np.zeros(n)
                doc = np.repeat(np.arange(n), np.diff(before))
                mass = np.bincount(doc * k + label, weights=letters, minlength=n * k).reshape(n, k)
                every = mass.sum(axis=1)
                for i in np.flatnonzero(every).tolist():
                    j = int(mass[i].argmax())
                    names[i], score[i] = m.langs[j], mass[i, j] / every[i]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def _spans(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        for whole in batches if m.langs else ():
            for batch, before, _, label in _labelled(m, whole):
                if not len(label):
                    continue
                doc = np.repeat(np.arange(batch.num_rows), np.diff(before))
                head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])])
                end = np.r_[head[1:], len(label)]
                cols = [batch.column("doc_id").take(pa.array(doc[head])), pa.array(head - before[doc[head]]), pa.array(end - before[doc[head]]), pa.array([m.langs[i] for i in label[head]])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "first_word", "end_word", "lang"])

    return run


def language_spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Spans of words in one language: doc_id, first_word, end_word (exclusive), lang.  Texts without words have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_spans(shared), "doc_id long, first_word long, end_word long, lang string")


def identify(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    lang_pred is the language of most letters, score its share of them.  A null or empty text, or
    one without a letter (a code point of a Unicode category L): ``und`` and 0.  A null id has
    the fold of the empty text and teaches nothing; repeated rows are predicted one by one and
    alike.  The model (a few MB a language) is broadcast; its size depends on the number of
    languages alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(fit_languages(docs, **options))
    found = docs.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
