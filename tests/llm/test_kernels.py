"""Numpy kernels against plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from reasonflow.llm import kernels as K
from reasonflow.llm.neardup import shingle_sets
from reasonflow.llm.packing import plan_bins, slots

texts = st.lists(st.text(alphabet="ab é\n\t ", max_size=30), max_size=6)


def words(t):
    return t.replace("\n", " ").replace("\t", " ").split(" ")


@settings(max_examples=80, deadline=None)
@given(texts)
def test_words(ts):
    data, offsets = K.utf8(pa.array(ts, pa.string()))
    starts, ends, before = K.words(data, offsets)
    got = [[data[starts[i] : ends[i]].tobytes().decode() for i in range(before[d], before[d + 1])] for d in range(len(ts))]
    assert got == [[w for w in words(t) if w] for t in ts]
    h = K.hash_words(data, starts, ends)
    flat = [w for g in got for w in g]
    assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(1, 12))
def test_grams_and_minima(v, k):
    h = K.codes(5, 8)[np.array(v)]
    g = K.grams(h, k)
    assert len(g) == max(0, len(v) - k + 1)
    assert all((g[i] == g[j]) == (v[i : i + k] == v[j : j + k]) for i in range(len(g)) for j in range(len(g)))
    if len(v) >= k:
        at = K.sliding_argmin(h, k)
        for i in range(len(v) - k + 1):
            least = min(h[i : i + k])
            assert at[i] == max(j for j in range(i, i + k) if h[j] == least)


def test_steps_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c"])], names=["text"])
    parts = list(K.steps(batch, "text", most=20))
    assert [r for p in parts for r in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert len(parts) > 1


@settings(max_examples=50, deadline=None)
@given(texts, st.integers(1, 4))
def test_shingles(ts, k):
    doc, value = shingle_sets(*K.utf8(pa.array(ts, pa.string())), k)
    for d, t in enumerate(ts):
        w = [x for x in words(t.replace("É", "é")) if x]
        want = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        assert int((doc == d).sum()) == len(want)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=12))
def test_bins_hold_every_piece_once(counts):
    bins = plan_bins(counts, 64)
    placed: dict[int, int] = {}
    for lengths, times in bins:
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            placed[n] = placed.get(n, 0) + times
    assert placed == {n: c for n, c in counts.items() if c}
    covered: dict[int, list] = {}
    for n, lo, hi, _, _ in slots(bins):
        covered.setdefault(n, []).append((lo, hi))
    assert all(sum(hi - lo for lo, hi in x) == placed[n] for n, x in covered.items())


def test_two_small_pieces_replace_one():
    # greedy takes 6 and then 3 (gap 1); 2 and 2 fill the widened gap of 4
    assert sorted(plan_bins({6: 1, 3: 1, 2: 2}, 10)[0][0]) == [2, 2, 6]
