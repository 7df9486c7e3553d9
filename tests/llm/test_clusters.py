"""Centroid clustering against exact arithmetic in plain Python."""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pytest

from densika.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, v string, n string"


def rounded(x):
    """As stored in 32 bits."""
    return struct.unpack("f", struct.pack("f", x))[0]


def plain(rows, k=40, rounds=5, dims=64, scale=256):
    kept = [(i, [math.floor(scale * rounded(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds if kept else 0):
        members = {}
        for (_, v), (_, j) in zip(kept, assign(), strict=True):
            members.setdefault(j, []).append(v)
        cents = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(cents)]
    last = assign() if kept else []
    by = {}
    for d, j in last:
        by[j] = by.get(j, 0) + d
    return sorted(((i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)), key=repr)


def made(rows, spark):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(3)


def clean(rng, n, ids=0, grid=None, size=0.3):
    x = rng.normal(0, size, (n, 64))
    if grid:
        x = np.round(x * grid) / grid
    return [(ids + i, [float(e) for e in r]) for i, r in enumerate(x.tolist())]


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "large", "alike"])
def test_op13(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "spread":
        rows = clean(rng, 160) + [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [float("nan")] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [float("-inf")] * 64), (906, []), (None, [0.25] * 64), (None, None)]
        rows += rows[:5] + [(0, [0.5] * 64)]
    elif kind == "ties":
        rows = clean(rng, 150, grid=2, size=0.2)
    elif kind == "few":
        rows = clean(rng, 7)
    elif kind == "large":  # products beyond what float32 tells apart
        rows = [(i, [e * 400000 for e in v]) for i, v in clean(rng, 60)]
        rows += [(100 + i, [e + (k == 3) * 0.01 for k, e in enumerate(v)]) for i, v in rows]
    else:
        rows = [(i, [0.125] * 64) for i in range(90)] + [(200, [0.126] * 64)]
    got = sorted((tuple(r) for r in clusters.op13(made(rows, spark)).collect()), key=repr)
    assert got == plain(rows)


def test_no_vectors(spark):
    assert clusters.op13(made([], spark)).count() == 0
    assert clusters.op13(made([(1, None), (2, [1.0])], spark)).count() == 0


def test_components_beyond_64_bits_are_refused(spark):
    with pytest.raises(Exception, match="a component of"):
        clusters.op13(made([(1, [1e30] * 64)], spark)).collect()


def exact(v, x):
    return [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c, strict=True)) - sum(int(a) ** 2 for a in p) for c in x] for p in v]


@pytest.mark.parametrize("size", [10, 3000, 1 << 20, (1 << 27) - 1])
def test_intervals_hold_the_exact_value(size):
    rng = np.random.default_rng(size)
    v, x = rng.integers(-size, size + 1, (40, 64)), rng.integers(-size, size + 1, (12, 64))
    v[:12] = x + rng.integers(-2, 3, (12, 64))
    low, high = clusters.Centroids(x).intervals(v)
    for i, row in enumerate(exact(v, x)):
        for j, true in enumerate(row):
            assert math.floor(low[i, j]) <= true <= math.ceil(high[i, j])


def test_screening_leaves_little_open():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(0, 0.3, (5000, 64)) * 256).astype(np.int64)
    found = clusters.Centroids(v[:40])
    near = found.nearest(v)
    assert near.tolist() == [int(np.argmin(((found.x - p) ** 2).sum(1))) for p in v]
    vectors, several, listed = found.screened
    assert vectors == 5000 and several < 100 and listed < 3 * several + 1
