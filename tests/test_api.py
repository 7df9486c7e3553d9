from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from densika import api
from densika.config import Debias, Run, Scoring
from densika.functions import student_t
from densika.functions.cell import Cell
from densika.operators import ensemble
from densika.sources import maps, parameters, structures, workspace
from densika.streaming import incremental
from tests.test_operators import PDB, mtz_bytes, workspace_at

CELL, DIMS = Cell(16, 16, 16), (16, 16, 16)


def ensemble_rows(n_maps=4, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, j, k, m, float(rng.normal(1, 0.3))) for i in range(0, 16, 2) for j in range(0, 16, 4) for k in range(0, 16, 4) for m in range(n_maps)]


COLUMNS = [("H", "H"), ("K", "H"), ("L", "H"), ("FWT", "F"), ("PHWT", "P")]


def crystal_at(root, stem, cell, n_maps=4, seed=0, omitted=(0, 2)):
    """An experiment whose maps are noisy around one structure factor table; its model is five atoms."""
    workspace_at(root, stem)
    (root / "metadata" / f"{stem}_omission_map.json").write_text(json.dumps({"A|1856|SER|N|": list(omitted), "A|1856|SER|CA|A": []}))
    rng = np.random.default_rng(seed)
    hkl = [(h, k, l) for h in range(3) for k in range(3) for l in range(3) if (h, k, l) != (0, 0, 0)]
    f, phi = rng.uniform(20, 60, len(hkl)), rng.uniform(-180, 180, len(hkl))
    for m in range(n_maps):
        folder = root / "results" / f"{stem}_{m}"
        folder.mkdir(parents=True)
        table = [(*x, a * rng.normal(1, 0.05), p) for x, a, p in zip(hkl, f, phi, strict=True)]
        (folder / f"{stem}_{m}.mtz").write_bytes(mtz_bytes(COLUMNS, table, cell))


def test_three_stages(spark, tmp_path):
    """From MTZ files of unlike crystals to maps, null parameters, scores and the report."""
    cells = {"x1": Cell(16, 16, 16), "x2": Cell(18, 15, 17, 90, 105, 90)}
    for i, (stem, cell) in enumerate(cells.items()):
        crystal_at(tmp_path / stem, stem, cell, seed=i)
    workspace_at(tmp_path / "x3", "x3")  # no maps
    crystal_at(tmp_path / "x4", "x4", cells["x1"])
    (tmp_path / "x4" / "results" / "x4_1" / "x4_1.mtz").write_bytes(b"MTZ broken")
    got = {r.stem: r for r in api.run_quantification(spark, str(tmp_path), n_maps=4, n_null=2000).collect()}
    assert {s: r.error is None for s, r in got.items()} == {"x1": True, "x2": True, "x3": False, "x4": False}
    for stem, cell in cells.items():
        folder = tmp_path / stem / "quantify_results" / "k_1.0_cap_4"
        values = {n: maps.parse_ccp4((folder / f"{stem}_{n}.ccp4").read_bytes()) for n in ("mean", "std", "snr", "p_value")}
        series = []
        for m in range(4):
            columns, table, read, ops = maps.parse_mtz((tmp_path / stem / "results" / f"{stem}_{m}" / f"{stem}_{m}.mtz").read_bytes())
            series.append(maps.density(table, columns, read, ops))
        series, mean = np.array(series, float), values["mean"]
        assert mean[1].a == cell.a and mean[1].beta == pytest.approx(cell.beta) and mean[2] == 4 and mean[0].shape == series.shape[1:]
        want = biased(series, cell, omitted=(0, 2), at=(12.34, -1.25, 3.0), radius=1.95)  # nitrogen at 3 angstrom or more
        assert np.allclose(values["mean"][0], want.mean(0), atol=1e-5) and np.allclose(values["std"][0], want.std(0, ddof=1), atol=1e-5)
        params = json.loads((tmp_path / stem / "metadata" / f"{stem}_null_params_k1.0_cap4.json").read_text())
        p = student_t.survival(values["snr"][0].ravel(), params["df"], params["loc"], params["scale"])
        assert np.allclose(values["p_value"][0].ravel(), p, atol=1e-5)
    stamp = (tmp_path / "x1" / "quantify_results" / "k_1.0_cap_4" / "x1_snr.ccp4").stat().st_mtime
    assert api.run_quantification(spark, str(tmp_path), n_maps=4, n_null=2000).where("error is null").count() == 2
    assert (tmp_path / "x1" / "quantify_results" / "k_1.0_cap_4" / "x1_snr.ccp4").stat().st_mtime == stamp
    done = {r.stem: r.error for r in api.run_analysis(spark, str(tmp_path), n_maps=4, alpha=0.1).collect()}
    assert {s: e is None for s, e in done.items()} == {"x1": True, "x2": True, "x3": False, "x4": False}
    for stem in cells:
        folder = tmp_path / stem / "analyse_results"
        told = json.loads((folder / f"{stem}_summary.json").read_text())
        params = json.loads((tmp_path / stem / "metadata" / f"{stem}_null_params_k1.0_cap4.json").read_text())
        assert told["n_atoms"] == 4 and told["significance_alpha"] == 0.1
        assert told["significance_snr_threshold"] == pytest.approx(api.significance_threshold(params, 0.1), rel=1e-6)
        atoms = (folder / f"{stem}_atoms.csv").read_text().splitlines()
        assert atoms[0].split(",") == list(api.ATOM_COLUMNS) and len(atoms) == 5 and atoms[1].startswith("A,SER,1856,,N,N,")
        scored = [x for x in (folder / f"{stem}_scored.pdb").read_text().splitlines() if x[12:16].strip() == "N"]
        assert float(scored[0][60:66]) == pytest.approx(100 * float(atoms[1].split(",")[6]), abs=0.01)
        assert len((folder / f"{stem}_residues.csv").read_text().splitlines()) == 4
    page = (tmp_path / "index.html").read_text()
    assert all(s in page for s in ("x1", "x2", "x3", "x4")) and "no first map" not in page and "N/A" in page
    result = json.loads((tmp_path / "metadata" / "x3_screen_result.json").read_text())
    assert result["opia"] == "N/A" and "first map" in result["error"]
    assert "set_contour_level_absolute" in (tmp_path / "metadata" / "x1_view.py").read_text()
    assert json.loads((tmp_path / "metadata" / "screen_summary.json").read_text())["n_complete"] == 2
    events = [json.loads(x) for x in (tmp_path / "logs" / "quantify.json").read_text().splitlines()]
    assert {e["stem"] for e in events if e["message_type"] == "quantify:failed"} == {"x3", "x4"} and events[-1]["status"] == "succeeded"


def biased(series, cell, omitted, at, radius):
    """Maps without the bias of one atom that some of them omit, straight from the definition."""
    shape = series.shape[1:]
    orth = np.array(cell.orthogonal())
    nodes = np.stack(np.meshgrid(*[np.arange(n) / n for n in shape], indexing="ij"), -1) @ orth.T
    near = np.sqrt(((nodes - np.array(at)) ** 2).sum(-1)) <= radius
    away = np.isin(np.arange(len(series)), omitted)
    bias = series[~away].mean(0) - series[away].mean(0)
    return np.where(near & ~away[:, None, None, None], series - bias, series)


def test_single_crystal(spark):
    rows = ensemble_rows()
    df = spark.createDataFrame(rows, "i int, j int, k int, map_id int, value double")
    got = api.quantify(spark, df, CELL, DIMS, 2.0, n_maps=4)
    assert got.columns == ["i", "j", "k", "mean", "std", "snr"] and got.count() == 8 * 4 * 4


def test_null_distribution(spark):
    """Noise of a known distribution, sampled outside the model only."""
    rng = np.random.default_rng(0)
    rows = [("c", i, j, k, float(rng.standard_t(4))) for i in range(16) for j in range(16) for k in range(16)]
    snr = spark.createDataFrame(rows, "stem string, i int, j int, k int, snr double")
    crystals = api.crystal_table(spark, [api.crystal_row("c", CELL, DIMS, 2.0), api.crystal_row("d", CELL, DIMS, 2.0)])
    atoms = spark.createDataFrame([("c", "ALA", 8.0, 8.0, 15.5, "C"), ("c", "HOH", 2.0, 2.0, 2.0, "O")], "stem string, resname string, x double, y double, z double, element string")
    params = {r.stem: r for r in api.null_fits(snr, crystals, atoms, 4000, seed=1).collect()}
    assert params == {r.stem: r for r in api.null_fits(snr.repartition(7), crystals, atoms, 4000, seed=1).collect()}
    assert (params["d"].df, params["d"].loc, params["d"].scale) == (1.0, 0.0, 1.0) and abs(params["c"].loc) < 0.2
    points = ensemble.null_points(crystals.where("stem = 'c'"), 3000, 1)
    model = atoms.where("resname = 'ALA'").withColumn("vdw", F.lit(1.7))
    kept = {r.id for r in ensemble.outside_model(points, model, crystals).collect()}
    for r in points.collect():
        d = (np.array([r.fa, r.fb, r.fc]) - np.array([0.5, 0.5, 15.5 / 16]) + 0.5) % 1 - 0.5
        assert (r.id in kept) == (np.sqrt(((16 * d) ** 2).sum()) > 1.9)
    x = np.array([[r.fa, r.fb, r.fc] for r in points.collect()])
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05


DATA = [("H", "H"), ("K", "H"), ("L", "H"), ("FP", "F"), ("SIGFP", "Q"), ("FREE", "I")]


def test_debias(spark, tmp_path):
    """Two crystals of a screening table at once; a third has no model, a fourth no free set."""
    for s in ("m", "n"):
        (tmp_path / f"{s}.pdb").write_text("\n".join(PDB))
        (tmp_path / f"{s}.mtz").write_bytes(mtz_bytes(DATA, [(1, 1, 1, 5, 1, 0)], Cell(9, 9, 9)))
    (tmp_path / "q.mtz").write_bytes(mtz_bytes(DATA[:-1], [(1, 1, 1, 5, 1)], Cell(9, 9, 9)))
    rows = [("m", "m"), ("n", "n"), ("none", "m"), ("m", "q")]
    (tmp_path / "s.csv").write_text("pdb,mtz\n" + "".join(f"{tmp_path}/{p}.pdb,{tmp_path}/{m}.mtz\n" for p, m in rows[:3]))
    out = tmp_path / "out"
    run = Run(output_dir=str(out), debias=Debias(screening_path=str(tmp_path / "s.csv"), omit_fraction=0.4, iterations=2, seed=1, simulated_annealing=True))
    got = {r.id: r.error for r in api.debias(spark, run).collect()}
    assert got["m"] is None and got["n"] is None and got["none"]
    assert (out / "n" / "quantify_results").is_dir() and "debias:failed" in (out / "logs" / "debias.json").read_text()
    held = workspace.read_omissions(spark, str(out / "m" / "metadata")).collect()
    assert len(held) == 3 and all(len(r.map_ids) == 2 for r in held)
    names = sorted(p.name for p in (out / "n" / "params").iterdir())
    assert names == [f"n_{i}.params" for i in range(6)]
    job = parameters.load(out / "n" / "params" / "n_0.params")
    assert parameters.get(job, "input.xray_data.labels") == "FP,SIGFP" and parameters.get(job, "input.xray_data.r_free_flags.label") == "FREE"
    assert parameters.get(job, "output.job_title") == "n_0" and parameters.get(job, "output.file_name").endswith("n/results/n_0/n_0.mtz")
    assert parameters.get(job, "omit_map.boxing.refinement.main.simulated_annealing") is True
    assert parameters.get(job, "omit_map.boxing.selection").startswith("(chain A and resseq 1856 and name ")
    assert parameters.get(parameters.load(out / "m" / "processed" / "ready_set.params"), "ready_set.input.output_file_name").endswith("processed/m_updated")
    assert "--array=1-12" in (out / "jobs" / "maps_0.sh").read_text() and len((out / "manifest.txt").read_text().splitlines()) == 2
    keys = [f"A|1856|SER|{a}" for a in ("N", "CA", "H")]
    bad = Run(output_dir=str(tmp_path / "bad"), debias=Debias(structure_path=str(tmp_path / "m.pdb"), reflections_path=str(tmp_path / "q.mtz")))
    assert "free-set" in api.debias(spark, bad).first().error and len(keys) == 3
    told = Run(output_dir=str(tmp_path / "told"), debias=Debias(structure_path=str(tmp_path / "m.pdb"), reflections_path="none.mtz", mtz_f_labels="A,B", mtz_rfree_label="C"))
    assert api.debias(spark, told).first().error is None


def test_settings(tmp_path):
    from densika.config import layered, read_settings

    (tmp_path / "c.yaml").write_text("# top\noutput_dir: /data/x  # where\nforce: true\ndebias:\n  omit_fraction: 0.2\n  iterations: null\n  always_omit: 'A 1 SER'\n  seed: -3\nslurm:\n  chunk_size: 10\n  partition:\n")
    run = layered(Run(), read_settings(tmp_path / "c.yaml"), {"debias": {"seed": 4}})
    assert run.force and run.output_dir == "/data/x" and run.debias.omit_fraction == 0.2 and run.debias.iterations is None
    assert run.debias.always_omit == "A 1 SER" and run.debias.seed == 4 and run.slurm.chunk_size == 10 and run.slurm.partition is None
    (tmp_path / "bad.yaml").write_text("a:\n  - 1\n")
    with pytest.raises(ValueError, match="line 2"):
        read_settings(tmp_path / "bad.yaml")


def test_threshold_replaces_both(spark, tmp_path):
    (tmp_path / "m.pdb").write_text("\n".join(PDB))
    grid = spark.createDataFrame([(i, j, k, 2.0) for i in range(16) for j in range(16) for k in range(16)], "i int, j int, k int, value double")
    atoms = structures.read_pdb(spark, str(tmp_path / "m.pdb"))
    low, high = (api.score_model(spark, grid, atoms, CELL, DIMS, 2.0, Scoring(), threshold=t)["summary"].first() for t in (0.0, 50.0))
    assert low.n_missing_density == 0 and high.n_missing_density == high.n_atoms == 4


def test_stream(spark, tmp_path):
    rows = [("c1", *r) for r in ensemble_rows()] + [("c2", *r) for r in ensemble_rows(seed=1)]
    schema = "crystal string, i int, j int, k int, map_id int, value float"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = incremental.run_stream(incremental.ensemble_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), 4)
        assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 * 8 * 4 * 4 and {r.crystal for r in incremental.finished(spark, str(tmp_path / "out")).collect()} == {"c1", "c2"}
    assert incremental.finished(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("held_back", [False, True])
def test_stream_of_one_file_a_batch_equals_one_batch(spark, tmp_path, held_back):
    rows = [(c, i, 0, 0, m, float(v)) for c, values in (("c1", (3, 4, 5)), ("c2", (1, 1, 4)), ("007", (2, 2, 2))) for m, v in enumerate(values) for i in range(3)]
    for m in range(3):
        spark.createDataFrame([r for r in rows if r[4] == m], incremental.MAPS).coalesce(1).write.parquet(str(tmp_path / "in" / f"m{m}"))
    expected = spark.createDataFrame([("c1", 3), ("c2", 3), ("007", 4)], "crystal string, n_maps int") if held_back else None
    got = {}
    for name, n in (("one", 1), ("all", 100)):
        q = incremental.run_stream(incremental.ensemble_stream(spark, str(tmp_path / "in/*"), n), str(tmp_path / name), str(tmp_path / f"check-{name}"), 3, expected=expected)
        assert q.awaitTermination(120)
        assert len([p for p in q.recentProgress if p["numInputRows"]]) == (3 if n == 1 else 1)
        table = spark.read.schema("crystal string, i int, mean double, std double").parquet(str(tmp_path / name))
        got[name] = sorted((r.crystal, r.i, round(r.mean, 6), round(r.std, 6)) for r in table.collect())
    assert got["one"] == got["all"] and {r[:1] + r[2:] for r in got["one"]} == {("c1", 4.0, 1.0), ("c2", 2.0, 1.732051)} | (set() if held_back else {("007", 2.0, 0.0)})


def test_cli(spark, tmp_path, capsys):
    from densika import cli

    workspace_at(tmp_path / "x1", "x1")
    assert cli.main(["report", str(tmp_path)]) == 0 and (tmp_path / "index.html").exists()
    assert cli.main(["quantify", str(tmp_path)]) == 0 and cli.main(["analyse", str(tmp_path), "--alpha", "0.01"]) == 0
    with pytest.raises(SystemExit):
        cli.main([])
