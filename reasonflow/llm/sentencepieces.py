"""SentencePiece encoding and decoding in numpy, equal to the sentencepiece library's.

Words (a run of the space sign and what follows it) of equal length advance together.  The
hashes of all their substrings, up to the longest piece, probe the sorted hashes of the pieces.
Viterbi then runs position by position: vectorised maxima over piece lengths store scores
and backpointers.  In a unigram model a piece gains its score.  In a BPE model the encoding of a
prefix ends in just one piece: the one that stays as it is after the last piece of the prefix
before it, when pieces are merged in order of score.  Such a piece gains nothing and all
others are excluded, so the path is the model's own encoding.  Characters without a
piece fall back to byte pieces, or else to the unknown id.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix, powers, steps
from .tokens import PieceEncoder

SIGN = "▁"
UNIGRAM, BPE = 1, 2
FILTER_BITS = 20
WORD = re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class SentencePieceModel:
    """Pieces, scores and options read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.kind, self.dummy_prefix, self.squeeze, charsmap = UNIGRAM, True, True, b""
        for field, value in _fields(raw):
            if field == 2:  # trainer_spec
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:  # normalizer_spec
                spec = dict(_fields(value))
                charsmap, self.dummy_prefix, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or charsmap:
            raise ValueError("only unigram and BPE models without a character map are supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.bytes = np.array([i for i in range(n) if byte[i]], np.int32)
        normal = [i for i in range(n) if not (special[i] or byte[i] or sp.is_unused(i))]
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float32)
        if any(SIGN in self.pieces[i].lstrip(SIGN) for i in normal):
            raise ValueError("pieces across spaces are not supported")
        self.longest = max(len(self.pieces[i]) for i in normal)
        points = [np.fromiter(map(ord, self.pieces[i]), np.int64) for i in normal]
        keys = np.concatenate([list(self.hashes(p[None, :], len(p)))[-1][0] for p in points])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << FILTER_BITS, bool)  # spares most substrings the search
        self.maybe[(self.keys >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        if self.kind == BPE:
            self._build(points, np.array(normal, np.int32))
        # bytes that each id stands for
        surface = [bytes([int(p[3:5], 16)]) if b else b"" if s and i != self.unknown else " ⁇ ".encode() if s else p.replace(SIGN, " ").encode() for i, (p, b, s) in enumerate(zip(self.pieces, byte, special, strict=True))]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.r_[0, np.cumsum([len(x) for x in surface])]
        self.opens = np.array([x[:1] == b" " and not b for x, b in zip(surface, byte, strict=True)])

    @staticmethod
    def hashes(points: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """For each length from 1 to ``most`` the hashes of the substrings of all words that begin at 0, 1, ..."""
        length = points.shape[1]
        with np.errstate(over="ignore"):
            value = mix(points.astype(U64) + U64(0x9E3779B97F4A7C15))
            total, power = np.zeros_like(value), powers(0xD6E8FEB86659FD93, most)
            for k in range(most):
                total = total[:, : length - k] + value[:, k:] * power[k]
                yield mix(total + U64(k + 1))

    def substrings(self, points: np.ndarray) -> np.ndarray:
        """(words x starts x lengths - 1): the id of each substring that is a piece, else -1."""
        n, length = points.shape
        most = min(length, self.longest)
        found = np.full((n, length, most), -1, np.int32)
        for k, h in enumerate(self.hashes(points, most)):
            w, i = np.nonzero(self.maybe[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
            h = h[w, i]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            found[w[hit], i[hit], k] = self.ids[at[hit]]
        return found

    def viterbi(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, start and length of the pieces on each word's path of greatest score; the longest last piece among equals."""
        n, length, most = found.shape
        least = np.float32(self.score[self.ids].min() - 10)
        best = np.full((n, length + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            sizes = np.arange(min(end, most), 0, -1)
            ids = found[:, end - sizes, sizes - 1]
            gain = np.where(ids >= 0, self.score[ids], np.where(sizes == 1, least, np.float32(-np.inf)))
            total = best[:, end - sizes] + gain
            pick = total.argmax(axis=1)
            best[:, end] = total[np.arange(n), pick]
            back[:, end] = sizes[pick]
        return self._path(back)

    def _build(self, points: list[np.ndarray], ids: np.ndarray) -> None:
        """How a BPE model makes each piece: its rank in the order of merges and the length of its left part.

        Single characters come before all merges (rank -1).  Pieces that merging does not give are never on a path.
        """
        sizes = np.array([len(p) for p in points])
        order = np.lexsort((ids, -self.score[ids]))
        self.rank, self.left = np.full(len(self.pieces) + 1, -1, np.int64), np.zeros(len(self.pieces) + 1, np.int64)  # id -1: a character without a piece
        self.rank[ids[order]] = np.arange(len(ids))
        self.rank[ids[sizes == 1]] = -1
        self.made = np.zeros(len(self.pieces) + 1, bool)
        self.made[ids[sizes == 1]] = self.made[-1] = True
        for length in np.unique(sizes[sizes > 1]).tolist():  # shorter pieces are known by then
            some = np.flatnonzero(sizes == length)
            found = self.substrings(np.stack([points[i] for i in some]))
            # the last merge is the one of two pieces that stay side by side until then: of all pairs the one without the piece itself
            found[:, 0, length - 1] = -1
            word, start, size = self.best_pieces(found)
            two = np.flatnonzero(np.bincount(word, minlength=len(some)) == 2)
            first = size[start == 0]
            self.left[ids[some[two]]] = first[two]
            self.made[ids[some[two]]] = True

    def _stays(self, found: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether the pieces from a to b and from b to c of words w stay side by side.

        Merges are undone from the last one on; a merge across b that would have come first says no.
        """
        ok, todo = np.ones(len(w), bool), np.arange(len(w))
        limit = np.full(len(w), np.iinfo(np.int64).max)
        most, rank = found.shape[2], self.rank
        while len(todo):
            over = np.where(c - a <= most, found[w, a, np.minimum(c - a, most) - 1], -1)
            bad = (over >= 0) & (rank[over] < limit)
            ok[todo[bad]] = False
            left, right = found[w, a, b - a - 1], found[w, b, c - b - 1]
            r1, r2 = rank[left], rank[right]
            on = ~bad & (np.maximum(r1, r2) >= 0)
            first = r1 > r2  # the left piece was made later
            limit = np.where(first, r1, r2 + 1)
            a = np.where(first, a + self.left[left], a)
            c = np.where(first, c, b + self.left[right])
            todo, limit, w, a, b, c = todo[on], limit[on], w[on], a[on], b[on], c[on]
        return ok

    def best_pieces(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, start and length of the pieces of each word's BPE encoding, by Viterbi over the end positions."""
        n, length, most = found.shape
        back = np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            sizes = np.arange(1, min(end, most) + 1)
            ids = found[:, end - sizes, sizes - 1]
            w, z = np.nonzero(((ids >= 0) & self.made[ids]) | (sizes == 1))
            start = end - sizes[z]
            gain = np.zeros((n, len(sizes)), bool)
            inner = start > 0
            gain[w[~inner], z[~inner]] = True
            w, z, start = w[inner], z[inner], start[inner]
            gain[w, z] = self._stays(found, w, start - back[w, start], start, np.full(len(w), end))
            back[:, end] = sizes[gain.argmax(axis=1)]
        return self._path(back)

    @staticmethod
    def _path(back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces that the backpointers lead over."""
        n, length = back.shape[0], back.shape[1] - 1
        end, on, size = np.full(n, length), np.arange(n), np.zeros((n, length), np.int64)
        while len(on):  # all words step back together
            z = back[on, end[on]]
            end[on] -= z
            size[on, end[on]] = z
            on = on[end[on] > 0]
        w, s = np.nonzero(size)
        return w, s, size[w, s]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and where each word's end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, place, id or -1 - code point
        for length in np.unique(sizes).tolist():
            members = np.flatnonzero(sizes == length)
            step = max(1, 400_000 // (length * min(length, self.longest)))
            for lo in range(0, len(members), step):
                some = members[lo : lo + step]
                points = flat[start[some][:, None] + np.arange(length)]
                found = self.substrings(points)
                w, s, z = self.best_pieces(found) if self.kind == BPE else self.viterbi(found)
                key = found[w, s, z - 1].astype(np.int64)
                parts.append((some[w], s, np.where(key >= 0, key, -1 - points[w, s])))
        word, place, ids = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((place, word))
        word, ids = word[order], ids[order]
        lone = np.flatnonzero(ids < 0)
        if len(lone):  # characters without a piece
            each = [list(chr(-1 - x).encode()) for x in ids[lone].tolist()] if len(self.bytes) else [[0]] * len(lone)
            repeat = np.ones(len(ids), np.int64)
            repeat[lone] = [len(x) for x in each]
            ids, word = np.repeat(ids, repeat), np.repeat(word, repeat)
            ids[ids < 0] = self.bytes[np.array([x for e in each for x in e])] if len(self.bytes) else self.unknown
        return ids.astype(np.uint32), np.cumsum(np.bincount(word, minlength=len(words)))

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (SIGN if self.dummy_prefix and text else "") + text.replace(" ", SIGN)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and where each begins; the space before a text's first piece goes if it was put there."""
        size = self.surface_at[ids + 1] - self.surface_at[ids]
        if self.dummy_prefix:
            heads = offsets[:-1][np.diff(offsets) > 0]
            heads = heads[self.opens[ids[heads]]]
            skip = np.zeros(len(ids), np.int64)
            skip[heads] = 1
        else:
            skip = np.zeros(len(ids), np.int64)
        size = size - skip
        upto = np.cumsum(size)
        at = np.repeat(self.surface_at[ids] + skip - (upto - size), size) + np.arange(int(size.sum()))
        return self.surface[at], np.r_[0, upto][offsets]


class SentencePieceEncoder(PieceEncoder):
    """Encodes columns of texts with a memory of the pieces between spaces, which are words here."""

    def __init__(self, path: str, bits: int = 21):
        self.model, self.bits = SentencePieceModel(path), bits
        self.size = len(self.model.pieces)
        self._forget()

    def _learn(self, pieces: list[str], first: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pieces), np.int64)
        m = self.model
        good = [i for i, (p, f) in enumerate(zip(pieces, first.tolist(), strict=True)) if p and SIGN not in p and (m.dummy_prefix or not f)]
        if good:
            out[good] = self._keep(*m.encode_words([SIGN + pieces[i] for i in good]))
        return out

    def _encode(self, texts: list[str]) -> list[list[int]]:
        words = [WORD.findall(self.model.normalised(t)) for t in texts]
        ids, ends = self.model.encode_words([w for ws in words for w in ws])
        ends = np.r_[0, ends]
        at = np.cumsum([0, *map(len, words)])
        return [ids[ends[a] : ends[b]].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


_ENCODERS: dict[str, SentencePieceEncoder] = {}


def encoder(path: str) -> SentencePieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SentencePieceEncoder(path)
    return _ENCODERS[path]


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in steps(whole, "text"):
                text = batch.column("text")
                ids, at = enc.encode(text)
                back, begin = enc.model.decode(ids, at)
                crc, sha, same = [], [], []
                for i, t in enumerate(text.to_pylist()):
                    decoded = back[begin[i] : begin[i + 1]].tobytes()
                    crc.append(zlib.crc32(ids[at[i] : at[i + 1]]))
                    sha.append(hashlib.sha256(decoded).hexdigest())
                    same.append(decoded == (t or "").encode())
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
                cols = [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(crc, pa.int64()), lists, pa.array(sha), pa.array(same)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_ids", "ids_crc32", "ids", "decoded_sha256", "lossless"])

    return run


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the ids of the text and what they decode to.

    A null text counts as empty and has no ids; a null id stays null; repeated rows get equal
    results; an empty table gives an empty one.  ``lossless``: decoding gives the text's bytes
    back; it does not where the text has the space sign itself.
    """
    out = "doc_id long, n_ids long, ids_crc32 long, ids array<int>, decoded_sha256 string, lossless boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(model), out)
