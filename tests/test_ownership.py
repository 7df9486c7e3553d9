"""Shares of grid points against all pairs: crowded atoms, copies, spheres larger than the buffer, atoms without bonds."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from densika.functions.cell import Cell
from densika.functions.radii import COVALENT
from densika.operators import scoring, spatial

CELL, DIMS, BUFFER, TOLERANCE = Cell(14.0, 12.6, 11.2), (20, 18, 16), 3.0, 0.4
SCHEMA = "stem string, atom_id long, x double, y double, z double, element string, radius double, is_water boolean"


def _atoms(seed, n, radii, elements="CNOSH"):
    r = random.Random(seed)
    rows = [[r.choice("pq"), i, *[r.gauss(3, 1.6) for _ in "xyz"], r.choice(elements), r.choice(radii), i % 7 == 3] for i in range(n)]
    for i in range(0, n, 5):  # copies, one of a node's place, one a water
        rows[i][:1], rows[i][2:7] = rows[i // 2][:1], rows[i // 2][2:7]
    rows += [["p", n, 2.1, 2.8, 3.5, "C", radii[0], False], ["p", n + 1, 2.1, 2.8, 3.5, "C", radii[0], False], ["q", n + 2, 2.1, 2.8, 3.5, "H", radii[0], False], ["q", n + 3, 2.1, 2.8, 3.5, "H", radii[0], True]]
    return [tuple(r) for r in rows]


def _plain(rows):
    """Shares by all pairs of points and atoms."""
    out = {}
    for s, i, *at, e, r, water in rows:
        if water:
            continue
        near = [b for b in rows if b[0] == s and b[1] != i and math.dist(at, b[2:5]) <= 2 * r + BUFFER]
        low, high = ([int(f((c + k * r * 2) / 0.7)) for c in at] for f, k in ((math.floor, -1), (math.ceil, 1)))
        for u in range(low[0], high[0] + 1):
            for v in range(low[1], high[1] + 1):
                for w in range(low[2], high[2] + 1):
                    p = (u / 20 * 14.0, v / 18 * 12.6, w / 16 * 11.2)
                    d = math.dist(p, at)
                    if d > 2 * r:
                        continue
                    ds = [(math.dist(p, b[2:5]), b) for b in near]
                    if d <= r:
                        them = [x for x, b in ds if x <= b[6] and ("H" in (e, b[5]) or math.dist(at, b[2:5]) > COVALENT[e] + COVALENT[b[5]] + TOLERANCE)]
                    elif any(x <= b[6] for x, b in ds):
                        out[s, i, u, v, w] = 0.0
                        continue
                    else:
                        them = [x for x, b in ds if b[6] < x <= 2 * b[6]]
                    total = d + sum(them)
                    out[s, i, u, v, w] = 1.0 if not them else 1 - d / total if total > 0 else 1 / (len(them) + 1)
    return out


def _shared(atoms, by):
    placed = scoring.places(atoms, by)
    met = spatial.sphere_blocks(scoring.sites(placed, by), CELL, DIMS)
    return placed, met, scoring.ownership(spatial.block_points(met, CELL, DIMS, by=by), met, by, BUFFER, TOLERANCE)


@pytest.mark.parametrize("radii", [(1.2, 1.38), (1.2, 1.9), (0.9, 3.4)])
def test_shares_are_those_of_all_pairs(spark, radii):
    rows = _atoms(3, 90, radii)
    placed, _, shared = _shared(spark.createDataFrame(rows, SCHEMA), ["stem"])
    got = {(r.stem, r.atom_id, r.u, r.v, r.w): r.share for r in scoring.of_atoms(shared, placed, ["stem"]).collect()}
    want = _plain(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert len({round(x, 3) for x in want.values()}) > 10


@pytest.mark.parametrize("rows_at_a_time", [1, 7])
def test_blocks_that_come_in_pieces(spark, rows_at_a_time):
    """Batches of Arrow end anywhere in a block; comparisons go in slices of any size."""
    rows = _atoms(4, 60, (1.2, 1.38))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(rows_at_a_time))
        placed, _, shared = _shared(spark.createDataFrame(rows, SCHEMA), ["stem"])
        got = scoring.of_atoms(shared, placed, ["stem"]).groupBy().agg(F.count("*").alias("n"), F.sum("share").alias("share")).first()
    finally:
        spark.conf.set(name, before)
    want = _plain(rows)
    assert got.n == len(want) and got.share == pytest.approx(sum(want.values()), abs=1e-6)


def test_slices_hold_all_counts(monkeypatch):
    import numpy as np

    monkeypatch.setattr(scoring, "PAIRS", 5)
    counts = np.array([0, 3, 2, 9, 0, 1, 1])
    seen = [(int(o), int(p)) for _, owner, place in scoring._slices(counts) for o, p in zip(owner, place, strict=True)]
    assert seen == [(i, k) for i, n in enumerate(counts) for k in range(n)]


def _crowd(counts, radii):
    """What ``_shares`` takes: grid points of blocks, each with so many sites around its middle."""
    import numpy as np

    r = np.random.default_rng(7)
    nodes = np.stack(np.meshgrid(*[np.arange(8) * 0.7] * 3, indexing="ij"), -1).reshape(-1, 3)
    points = np.concatenate([nodes + (6.0 * b, 0, 0) for b in range(len(counts))])
    at = np.concatenate([r.normal(2.5, 0.8, (k, 3)) + (6.0 * b, 0, 0) for b, k in enumerate(counts)])
    total = len(at)
    covalent = np.where(np.arange(total) % 5 == 0, np.nan, r.choice([0.7, 1.1], total))
    size = np.repeat(counts, len(nodes))
    first = np.repeat(np.cumsum(counts) - counts, len(nodes))
    return tuple(at.T), tuple(points.T), first, size, r.choice(radii, total), covalent, 1.0 + np.arange(total) % 3, np.arange(total) % 7 != 3, BUFFER, TOLERANCE


@pytest.mark.parametrize("radii", [(1.2, 1.38), (0.9, 3.4)])
def test_pieces_of_any_size_give_the_same_shares(monkeypatch, radii):
    import numpy as np

    given = _crowd((3, 60, 0, 60), radii)
    whole = [np.concatenate(c) for c in zip(*scoring._shares(*given), strict=True)]
    for pairs in (1, 40, 5000):  # a point at a time in strips of its matrix, some points of a block, several blocks
        monkeypatch.setattr(scoring, "PAIRS", pairs)
        pieces = [np.concatenate(c) for c in zip(*scoring._shares(*given), strict=True)]
        assert all(a.tolist() == b.tolist() for a, b in zip(pieces[:3], whole[:3], strict=True))
        assert pieces[3] == pytest.approx(whole[3], abs=1e-12)
    assert len(set(whole[3].round(3))) > 100


def test_crowded_blocks_take_no_more_memory():
    import tracemalloc

    peaks = []
    for n in (500, 4000):
        given = _crowd((n,), (1.2, 1.38))
        tracemalloc.start()
        for piece in scoring._shares(*given):
            del piece
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]


def test_scores_make_no_pairs_of_points_and_neighbours(spark):
    """Crowded atoms: no join of the plan is on an atom's neighbours or bonds, and copies of an atom are one site."""
    at = [("s", n, 3 + (n % 10) / 50, 3.0, 3.0, "C", 1.38, False) for n in range(3000)]
    atoms = spark.createDataFrame(at, SCHEMA)
    grid = spark.range(20 * 18 * 16).selectExpr("'s' as stem", "cast(id / 288 as int) as i", "cast(id / 16 as int) % 18 as j", "cast(id % 16 as int) as k", "id % 5 / 4.0 as value")
    got = scoring.protein_scores(atoms, grid, (0.0, 1.0), CELL, DIMS, by=["stem"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_near0" not in plan and "other" not in plan
    assert got.count() == 3000 and got.select("score").distinct().count() <= 10
    _, met, _ = _shared(atoms, ["stem"])
    assert met.count() <= 10 * 27


def test_query_with_copies_is_its_sql(spark, tmp_path):
    """Half of the vectors at one place and the others close around it."""
    import duckdb

    from densika.plans import oracles, queries

    r = random.Random(6)
    rows = [(n, [0.01] * 6 if n % 2 else [r.gauss(0, 0.02) for _ in range(6)], r.randrange(10)) for n in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("ownership_share", "atom_score"):
        found = con.sql(oracles.oracle_sql()[name])
        names, want = found.columns, sorted(found.fetchall())
        got = sorted(map(tuple, queries.queries()[name](spark, str(tmp_path)).select(*names).collect()))
        assert len(got) == len(want) > 0
        assert all(a == pytest.approx(b, abs=1e-9) for a, b in zip(got, want, strict=True))
