"""Token ids of many texts, with a memory of pieces already encoded.

A single space with non-space characters on both sides always begins a new
pre-token in the tokenizers used here, so a text is encoded as the concatenation of its
pieces between such spaces; equal pieces are encoded once per worker.  Texts with any
other kind of spacing around a space, or with the string of an added token (which the
library takes for that token), are encoded whole.  Results equal the tokenizers library's
on the whole text.

Pieces are looked up by a 96-bit hash of their bytes in an open-addressing table of
numpy arrays: no Python object is made for a piece already known.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .kernels import U64, codes, mix, powers, utf8

MARK = "\x00"


class PieceEncoder:
    """Encodes columns of texts; memory is bounded by ``2**bits`` table places."""

    def __init__(self, path: str, bits: int = 22):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(100_000)  # words that come with and without a comma
        self.bits = bits
        if any(" " in t for t in self.added):
            raise ValueError("added tokens with a space are not supported")
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.opens = np.zeros(self.size, bool)  # ids whose bytes begin with the space
        self.opens[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True
        self.spaced = len(self._encode([" a a"])[0]) == int(self.opens[self._encode([" a a"])[0]].sum())
        self.mark = self._encode([" " + MARK])[0]
        self._forget()

    def _forget(self) -> None:
        n = 1 << self.bits
        self.key1, self.key2, self.slot = np.zeros(n, U64), np.zeros(n, np.uint32), np.full(n, -1, np.int32)
        self.flat = np.zeros(1 << 20, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.at = np.zeros((n >> 1) + 2, np.uint32)  # piece 0: bad
        self.n, self.used = 1, 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Piece numbers; -1: not known."""
        mask = U64((1 << self.bits) - 1)
        out = np.full(len(h1), -1, np.int32)
        todo, place = np.arange(len(h1)), h1 & mask
        while len(todo):
            slot = self.slot[place]
            same = (slot >= 0) & (self.key1[place] == h1[todo]) & (self.key2[place] == h2[todo])
            out[todo[same]] = slot[same]
            on = (slot >= 0) & ~same
            todo, place = todo[on], (place[on] + U64(1)) & mask
        return out

    def _add(self, h1: np.ndarray, h2: np.ndarray, number: np.ndarray) -> None:
        mask = U64((1 << self.bits) - 1)
        todo, place = np.arange(len(h1)), h1 & mask
        while len(todo):
            free = self.slot[place] < 0
            self.slot[place[free]] = todo[free]  # the last one to claim a place has it
            won = free & (self.slot[place] == todo)
            self.key1[place[won]], self.key2[place[won]] = h1[todo[won]], h2[todo[won]]
            self.slot[place[won]] = number[todo[won]]
            todo, place = todo[~won], (place[~won] + U64(1)) & mask

    def _keep(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Stores pieces whose ids lie end to end; their numbers."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat) // 2, self.flat.dtype)))
        self.flat[self.used : self.used + len(ids)] = ids
        number = np.arange(self.n, self.n + len(ends))
        self.at[self.n + 1 : self.n + 1 + len(ends)] = self.used + ends
        self.n += len(ends)
        self.used += len(ids)
        return number

    def _holds_added(self, piece: str) -> bool:
        return any(t in piece or t in piece.lower() for t in self.added)

    def _learn(self, pieces: list[str], first: np.ndarray) -> np.ndarray:
        """Numbers of new pieces; 0 for those that aren't safe to encode alone."""
        out = np.zeros(len(pieces), np.int64)
        alone, joined = [], []
        for i, (p, f) in enumerate(zip(pieces, first.tolist(), strict=True)):
            if p and not p[-1].isspace() and MARK not in p and (f or not p[0].isspace()) and not self._holds_added(p):
                (alone if f else joined).append(i)
        if alone:
            ids = self._encode([pieces[i] for i in alone])
            out[alone] = self._keep(np.array([x for e in ids for x in e], np.uint32), np.cumsum([len(e) for e in ids]))
        if joined:
            glue = "" if self.spaced else " " + MARK
            texts = ["".join(f" {pieces[i]}{glue}" for i in joined[a : a + 500]) for a in range(0, len(joined), 500)]
            ids = np.array([x for e in self._encode(texts) for x in e], np.uint32)
            if self.spaced:
                ends = np.r_[np.flatnonzero(self.opens[ids])[1:], len(ids)]
            else:
                last = np.flatnonzero(ids == self.mark[-1])
                ends = last + 1 - len(self.mark) * np.arange(1, len(last) + 1)
                keep = np.ones(len(ids), bool)
                for back in range(len(self.mark)):
                    keep[last - back] = False
                ids = ids[keep]
            if len(ends) != len(joined):  # never seen; each by itself then
                each = self._encode([" " + pieces[i] for i in joined])
                ids, ends = np.array([x for e in each for x in e], np.uint32), np.cumsum([len(e) for e in each])
            out[joined] = self._keep(ids, ends)
        return out

    def encode(self, column: pa.Array | list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after the other, and where each text's begin; ``end`` closes each."""
        if isinstance(column, list):
            column = pa.array(column, pa.large_string())
        data, offsets = utf8(column)
        n_docs = len(offsets) - 1
        gap = np.flatnonzero(data == 32)
        starts = np.sort(np.concatenate((offsets[:-1], gap + 1)), kind="stable")
        ends = np.sort(np.concatenate((gap, offsets[1:])), kind="stable")
        first_of = np.arange(n_docs) + np.searchsorted(gap, offsets[:-1])
        first = np.zeros(len(starts), bool)
        first[first_of] = True
        if self.n + len(starts) > len(self.at) - 2:
            self._forget()
        h1, h2 = self._hashes(data, starts, ends, first)
        number = self._find(h1, h2)
        new = np.flatnonzero(number < 0)
        if len(new):
            _, where, back = np.unique(h1[new], return_index=True, return_inverse=True)
            pick = new[where]
            if self.n + len(pick) > len(self.at) - 2:  # more than the table holds: their texts are encoded whole
                number[new] = 0
            else:
                raw = data.tobytes()
                pieces = [raw[a:b].decode() for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
                got = self._learn(pieces, first[pick])
                self._add(h1[pick], h2[pick], got)
                number[new] = got[back]
        doc = np.repeat(np.arange(n_docs), np.diff(np.r_[first_of, len(starts)]))
        at = self.at[number].astype(np.int64)
        length = self.at[number + 1] - at
        bad = number == 0
        odd: dict[int, list[int]] = {}
        if bad.any():
            whole = np.unique(doc[bad])
            odd = dict(zip(whole.tolist(), self._encode([column[i].as_py() or "" for i in whole.tolist()]), strict=True))
            length[np.isin(doc, whole)] = 0
        else:
            length[bad] = 0
        per_doc = (np.add.reduceat(length, first_of) if n_docs else np.zeros(0, np.int64)) + int(end is not None)
        for i, ids in odd.items():
            per_doc[i] += len(ids)
        begin = np.concatenate(([0], np.cumsum(per_doc)))
        out = np.zeros(int(begin[-1]), np.uint32)
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        before = upto - length
        shift = begin[:-1] - before[first_of]  # what stands in the output and not in the pieces
        rank = np.arange(total)
        ids = self.flat[np.repeat(at - before, length) + rank].astype(np.uint32)
        if odd or end is not None:
            out[np.repeat(shift[doc], length) + rank] = ids
        else:
            out = ids
        for i, x in odd.items():
            out[begin[i] : begin[i] + len(x)] = x
        if end is not None:
            out[begin[1:] - 1] = end
        return out, begin

    @staticmethod
    def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = ends - starts
        if not len(data):
            return np.where(first, U64(1), U64(2)), np.ones(len(first), np.uint32)
        # a piece and the space after it (if there is one) make a stretch: stretches lie end to end
        stretch = np.diff(np.r_[starts, len(data)])
        rank = np.arange(len(data)) - np.repeat(starts, stretch)
        power = powers(0x9E3779B97F4A7C15, int(stretch.max()) + 1)[rank]
        out = []
        with np.errstate(over="ignore"):
            salt = length.astype(U64) * U64(0xD6E8FEB86659FD93) + first.astype(U64)
            for seed in (11, 12):
                total = np.zeros(len(data) + 1, U64)
                np.cumsum(codes(seed)[data] * power, out=total[1:])
                out.append(mix(mix(total[ends] - total[starts]) + salt))
        return out[0], out[1].astype(np.uint32)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
