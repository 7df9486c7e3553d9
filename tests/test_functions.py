from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from densika.config import DensityScore, MapNormalization, Run, WaterScoring, layered, snr_map_config, validated
from densika.functions import curves, radii, student_t
from densika.functions.cell import Cell, apply
from densika.operators import aggregates
from densika.sources import parameters


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_t_tails_of_known_form():
    x = np.linspace(-30, 30, 101)
    assert np.allclose(student_t.survival(x, 1.0), 0.5 - np.arctan(x) / np.pi, atol=1e-13)
    assert np.allclose(student_t.survival(x, 2.0), 0.5 - x / (2 * np.sqrt(2 + x * x)), atol=1e-13)
    normal = [0.5 * math.erfc(v / math.sqrt(2)) for v in (-2.0, 0.0, 1.5)]
    assert np.allclose(student_t.survival(np.array([-2.0, 0.0, 1.5]), 1e7), normal, atol=1e-6)
    assert np.isnan(student_t.survival(np.array([np.nan]), 3.0))[0]


def test_t_quantile_inverts_the_tail():
    for df in (1.0, 2.0, 5.0, 40.0):
        for p in (0.001, 0.2, 0.5, 0.95, 0.9999):
            q = student_t.quantile(p, df, 1.0, 2.0)
            assert abs(1 - student_t.survival(np.array([q]), df, 1.0, 2.0)[0] - p) < 1e-9
    assert student_t.quantile(0.95, 5, 1, 2) == pytest.approx(1 + 2 * 2.015048373333023, abs=1e-9)
    assert student_t.quantile(0.99, 5) > student_t.quantile(0.9, 5)


def test_t_fit():
    assert student_t.fit(np.array([])) == (1.0, 0.0, 1.0)
    x = np.random.default_rng(0).standard_t(5, 40_000) * 2 + 1
    df, loc, scale = student_t.fit(x)
    assert 4.4 < df < 5.7 and abs(loc - 1) < 0.05 and abs(scale - 2) < 0.06


def test_weights(spark):
    def parabola(d, r=1.0):
        return one(spark, curves.parabola_weight(F.lit(d), F.lit(r)))[0]

    assert parabola(0.0) == 1.0 and parabola(2.5) == 0.0 and parabola(1.0, 0.0) == 0.0
    assert parabola(1.2) < 0 and parabola(1.9) < 0 and abs(parabola(2.0)) < 1e-12
    bell = [one(spark, curves.gaussian_weight(F.lit(d)))[0] for d in (0.0, 0.5, 1.2, 1.52, 1.6)]
    assert bell[0] == 1.0 and bell[-1] == 0.0 and bell == sorted(bell, reverse=True)
    wide = WaterScoring(covalent_radius=1.0, vdw_radius=1.5)
    assert one(spark, curves.gaussian_weight(F.lit(1.0), wide))[0] == pytest.approx(math.exp(-0.5))


def test_density_keeps_nan(spark):
    got = one(spark, *[curves.density_score(F.lit(v), F.lit(0.0), F.lit(1.0), DensityScore(), MapNormalization()) for v in (-1.0, 0.5, 9.0, float("nan"))])
    assert got[:3] == (0.0, 0.5, 1.2) and math.isnan(got[3])
    assert snr_map_config().density.zeta == 5.0


def test_power_mean(spark):
    def mean(scores):
        df = spark.createDataFrame([(float(s),) for s in scores], "score double")
        return df.agg(curves.power_mean(F.col("score")).alias("m")).first().m

    assert mean([]) == 0.0
    assert mean([1, 1, 1]) == pytest.approx(1.0, abs=0.05)
    assert mean([1, 1, 0.1]) < mean([0.7, 0.7, 0.7])
    assert mean([-5, -5]) == 0.0


def test_radii(spark):
    got = one(spark, *[radii.radius_step(F.lit(e), F.lit(r)) for e, r in (("C", 0.1), ("C", 2.0), (" se ", 9.0), ("??", 1.49), ("O", 2.999))])
    assert got == (1.02, 1.38, 1.89, 1.14, 1.62)
    df = spark.createDataFrame([(1, "C", 0), (2, "O", 5), (3, "ZR", 0), (4, "C", 2), (5, "ZN", 2)], "atom_id int, element string, charge int")
    table = radii.default_table(spark).unionByName(spark.createDataFrame([("C", 2, [1.0] * 6)], "element string, charge int, radii array<double>"))
    found = {r.atom_id: r.radius for r in radii.with_radius_interp(df, table, F.lit(1.75)).collect()}
    assert found[1] == pytest.approx(1.32) and found[2] == pytest.approx(1.26) and found[4] == 1.0
    assert found[3] == pytest.approx(1.75 * (1.636 + 1.792) / 2) and found[5] == pytest.approx((1.08 + 1.26) / 2)


def test_cells_round_trip(spark):
    cell = Cell(30, 40, 50, 80, 95, 110)
    inv = np.array(cell.fractional()) @ np.array(cell.orthogonal())
    assert np.allclose(inv, np.eye(3))
    x = one(spark, *apply(cell.fractional(), apply(cell.orthogonal(), (F.lit(0.1), F.lit(0.2), F.lit(0.3)))))
    assert x == pytest.approx((0.1, 0.2, 0.3))


def test_parameters():
    text = 'a = 1\nb = 2.5\nc = "two words"\n# note\nd = True\ne = None\ninner {\n  list = x *special y\n  deep {\n    z = -3\n  }\n}\n}\njunk line\nempty =\n'
    p = parameters.parse(text)
    assert p["a"] == 1 and p["b"] == 2.5 and p["c"] == "two words" and p["d"] is True and p["e"] is None and p["empty"] == ""
    assert p["inner"] == {"list": ["x", "*special", "y"], "deep": {"z": -3}}
    assert parameters.parse(parameters.written(p)) == p
    assert parameters.get(p, "inner.deep.z") == -3 and parameters.get(p, "inner.none.z", 7) == 7
    assert parameters.put(p, "new.block.v", 1) and p["new"]["block"]["v"] == 1
    assert not parameters.put(p, "a.b", 1)
    assert ("inner.deep.z", "-3", "int") in parameters.flattened(p)


def test_parameter_files(tmp_path):
    with pytest.raises(FileNotFoundError):
        parameters.load(tmp_path / "none.params")
    parameters.save({"a": {"b": [1, "x"]}}, tmp_path / "sub" / "p.params")
    assert parameters.load(tmp_path / "sub" / "p.params") == {"a": {"b": [1, "x"]}}
    assert (tmp_path / "sub" / "p.params").stat().st_mode & 0o777 == 0o644 and len(list((tmp_path / "sub").iterdir())) == 1


def test_config():
    with pytest.raises(ValueError):
        validated(Run())
    run = layered(Run(), {"debias": {"screening_path": "a.csv", "omit_fraction": 0.2}}, {"debias": {"omit_fraction": 0.3}, "force": True})
    assert validated(run).debias.omit_fraction == 0.3 and run.force
    with pytest.raises(KeyError):
        layered(Run(), {"nope": 1})
    with pytest.raises(ValueError):
        validated(layered(run, {"debias": {"omit_fraction": 1.0}}))


def test_opia(spark):
    def value(scores, edges, threshold=0.8):
        s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(scores)], "atom_id long, score double")
        b = spark.createDataFrame([e for a, z in edges for e in ((a, z), (z, a))], "src long, dst long")
        return aggregates.opia(s, b, threshold).first().opia

    chain = [(0, 1), (1, 2), (2, 3)]
    assert value([0.9] * 4, chain) == 1.0
    assert value([0.1] * 4, chain) == 0.0
    assert value([0.9, 0.9], []) == 0.0
    assert value([0.9, 0.9, 0.2, 0.2], [(0, 1)]) == 0.5
    assert value([], []) == 0.0
    assert value([0.9], [(0, 0)]) == 0.0
