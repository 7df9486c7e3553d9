"""Properties of the pure parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from densika.llm import neardup, substrings, topk
from densika.llm.wordbytes import pieces, run_hashes, words


@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 60), st.integers(1, 2), st.integers(0, 400)), max_size=30))
def test_factors_cover_the_windows(ranges):
    lo, n, source, at = (np.array([r[k] for r in ranges], np.int64) for k in range(4))
    found = substrings.factors({"lo": lo, "hi": lo + n, "source": source, "at": at}, 50)
    got = [k for x, y in zip(found["lo"], found["hi"], strict=True) for k in range(x, y)]
    assert len(got) == len(set(got)) and set(got) == {k for x, m in zip(lo, n, strict=True) for k in range(x, x + m + 50)}
    # A factor's place is that of one of the ranges on its diagonal.
    told = {(s, a - x) for x, s, a in zip(lo, source, at, strict=True)}
    assert {(s, a - x) for x, s, a in zip(found["lo"], found["source"], found["at"], strict=True)} <= told


@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(0, 59), st.integers(0, 59), st.integers(0, 20))
def test_equal_runs_have_equal_hashes(values, i, j, n):
    v = np.array(values, np.uint64)
    i, j = i % len(v), j % len(v)
    n = min(n, len(v) - i, len(v) - j)
    of = run_hashes(v)
    same = of(np.array([i]), np.array([i + n]))[0] == of(np.array([j]), np.array([j + n]))[0]
    assert same == (values[i : i + n] == values[j : j + n])


@settings(max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té漢 \u0085", max_size=30)), min_size=1, max_size=12), st.integers(1, 60))
def test_pieces_and_words(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = list(pieces(iter([batch]), "text", limit))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    w = words(batch.column("text"))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    table = str.maketrans("\t\n\v\f\r", "     ")
    assert got == [[x for x in (t or "").translate(table).split(" ") if x] for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10_000))
def test_filled_sketches_have_no_gap_and_agree_for_equal_sets(n, seed):
    own = np.unique(np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    both = neardup.registers(np.concatenate((own, own)), np.array([len(own)] * 2))
    full = neardup.filled(both)
    assert (full > 0).all() and (full[0] == full[1]).all() and set(full[0]) == set(both[0][both[0] > 0])
    assert (neardup.band_keys(both)[0] == neardup.band_keys(both)[1]).all()


@settings(max_examples=25, deadline=None)
@given(st.integers(600, 1500), st.integers(0, 1000), st.sampled_from([1, 3, 1 << 20]))
def test_survivors_hold_the_best(n, seed, scale):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4 * scale, 4 * scale, (n, 5))
    q = rng.integers(-2 * scale, 3 * scale, (4, 5))
    ids, own = np.arange(n), np.array([0, 1, 2, n + 5])
    for i, (got, scores) in enumerate(topk.Lists(ids, x).best(own, q, 10)):
        all_ = x @ q[i]
        rest = np.flatnonzero(ids != own[i])
        want = rest[np.lexsort((rest, -all_[rest]))[:10]]
        assert got.tolist() == want.tolist() and scores.tolist() == all_[want].tolist()
