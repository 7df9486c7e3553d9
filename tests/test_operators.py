from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from densika.functions.cell import Cell
from densika.operators import ensemble, jobs, omission, report, spatial
from densika.sources import maps, screening, structures, workspace


def test_range_join_is_all_pairs_within_reach(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(-6, 7, (80, 3)).astype(float) for _ in range(2))
    left, right = (spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "n int, x double, y double, z double") for x in (a, b))
    got = spatial.range_join(left, right, 3.0).where(spatial.distance(spatial.xyz("a_"), spatial.xyz("b_")) <= 3.0)
    pairs = [(r.a_n, r.b_n) for r in got.collect()]
    want = {(i, j) for i in range(80) for j in range(80) if math.dist(a[i], b[j]) <= 3.0}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_range_join_is_an_equi_join(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "n int, x double, y double, z double")
    plan = spatial.range_join(df, df, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    physical = spatial.range_join(df, df, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "_cell0" in plan and "NestedLoop" not in physical and "Cartesian" not in physical


def test_bias_solve_against_the_full_matrix(spark):
    rng = np.random.default_rng(1)
    n_maps, rows, owned, gone, want = 6, [], [], [], {}
    schedules = {o: sorted(rng.choice(n_maps, int(rng.integers(0, n_maps + 1)), replace=False).tolist()) for o in range(5)}
    gone = [(o, int(m)) for o, ms in schedules.items() for m in ms] + [(0, 99), (1, -1)]
    for v in range(60):
        held = rng.choice(n_maps, int(rng.integers(1, n_maps + 1)), replace=False)
        values = np.zeros(n_maps)
        for m in held:
            values[m] = rng.normal()
            rows.append((v, int(m), float(values[m])))
        own = rng.choice(5, int(rng.integers(0, 4)), replace=False).tolist()
        owned += [(v, int(o)) for o in own]
        clean = values.copy()
        for o in own:
            out = np.isin(np.arange(n_maps), schedules[o])
            bias = values[~out].mean() - values[out].mean() if 0 < out.sum() < n_maps else 0.0
            clean -= bias * ~out
        sd = clean.std(ddof=1)
        want[v] = (clean.mean(), sd, clean.mean() / sd if sd > 1e-12 else 0.0)
    got = ensemble.quantify(spark.createDataFrame(rows, "voxel int, map_id int, value double"), spark.createDataFrame(owned, "voxel int, owner int"), spark.createDataFrame(gone, "owner int, map_id int"), ["voxel"], n_maps)
    for r in got.collect():
        assert (r["mean"], r["std"], r["snr"]) == pytest.approx(want[r.voxel], abs=1e-9)
    assert got.count() == 60


def test_single_map_has_no_ratio(spark):
    df = spark.createDataFrame([(1, 0, 2.0)], "voxel int, map_id int, value double")
    r = ensemble.stats(ensemble.packed(df, ["voxel"], 1), ["voxel"]).first()
    assert (r["mean"], r["std"], r["snr"]) == (2.0, None, 0.0)
    with pytest.raises(FileNotFoundError):
        ensemble.require_first_map(df.where("map_id > 0"))


def test_sampler():
    keys = [f"A|{i}|ALA" for i in range(115)]
    fixed = ["A|3|ALA", "A|7|ALA"]
    got = omission.sample_keys(keys, [*fixed, "Z|1|ALA"], 0.3, 2, 42)
    assert len(got) == 8 and all(set(fixed) <= set(s) and "Z|1|ALA" not in s for s in got)
    once = [k for s in got[:4] for k in s[2:]]
    assert sorted(once) == sorted(set(keys) - set(fixed))
    assert got == omission.sample_keys(keys, [*fixed, "Z|1|ALA"], 0.3, 2, 42)
    most = omission.sample_keys(keys, [], 0.8, 1, 1)
    assert len(most) == 5 and all(len(s) == 115 - 23 for s in most)
    assert omission.sample_keys([], [], 0.3, 1, 1) == [[]]
    assert omission.default_iterations(None, 0.1) == 5 and omission.default_iterations(None, 0.9) == 5
    for bad in (-0.1, 0, 1, 1.5):
        with pytest.raises(ValueError):
            omission.sample_keys(keys, [], bad, 1, 1)
    with pytest.raises(ValueError):
        omission.sample_keys(keys, [], 0.5, 0, 1)
    assert omission.parse_selectors("A 12 SER, B 3 GLY CA") == ["A|12|SER", "B|3|GLY|CA"]


@pytest.mark.parametrize(
    "held,mode",
    [({"A|10|ALA|CA": [0, 2], "A|10|ALA|CB": [2, 0], "A|11|GLY|CA": [1]}, "amino_acids"), ({"A|10|ALA|CA": [0], "A|10|ALA|CB": [1]}, "atoms"), ({"A|10|ALA": [0], "A|10|GLY": [1]}, "amino_acids")],
)
def test_mode(spark, held, mode):
    got = omission.infer_mode(spark.createDataFrame(list(held.items()), "key string, map_ids array<int>")).first()
    assert got.mode == mode


PDB = [
    "CRYST1   81.403   96.831   57.784  90.00  90.00  90.00 C 2 2 21",
    "ATOM      1  N   SER A1856      12.340  -1.250   3.000  1.00 20.00           N",
    "ATOM      2  CA ASER A1856      13.000  -1.000   3.500  0.50 21.00           C",
    "ATOM      3  H   SER A1856      13.000  -1.000   3.500  0.50 21.00           H",
    "HETATM    4 ZN    ZN A1900      14.000  -1.000   3.500  1.00 21.00          ZN2+",
    "HETATM    5  O   HOH B   1      -4.000   1.000  13.500  1.00 31.00           O1-",
]


def test_pdb(spark, tmp_path):
    path = tmp_path / "m.pdb"
    path.write_text("\n".join(PDB) + "\nEND\n")
    atoms = structures.read_structure(spark, str(path)).orderBy("serial").collect()
    assert [(a.record, a.atom, a.altloc, a.resname, a.chain, a.resnum, a.element, a.charge) for a in atoms] == [
        ("ATOM", "N", "", "SER", "A", 1856, "N", 0), ("ATOM", "CA", "A", "SER", "A", 1856, "C", 0), ("ATOM", "H", "", "SER", "A", 1856, "H", 0),
        ("HETATM", "ZN", "", "ZN", "A", 1900, "ZN", 2), ("HETATM", "O", "", "HOH", "B", 1, "O", -1),
    ]
    assert (atoms[0].x, atoms[0].y, atoms[0].z) == (12.34, -1.25, 3.0)
    assert structures.cell_of_pdb(spark, str(path)).first()[1:] == (81.403, 96.831, 57.784, 90.0, 90.0, 90.0, "C 2 2 21")
    scores = spark.createDataFrame([("A", 1856, "", "CA", 0.5)], "chain string, resnum int, icode string, atom string, score double")
    lines = [r.value for r in structures.scored_lines(structures.read_pdb(spark, str(path)), scores).orderBy("atom_id").collect()]
    assert lines[1][60:66] == " 50.00" and lines[0][60:66] == "  0.00" and lines[0][30:54] == "  12.340  -1.250   3.000"
    two = [PDB[0], "MODEL        1", *PDB[1:3], "ENDMDL", "MODEL        2", *PDB[1:3], "ENDMDL"]
    (tmp_path / "two.pdb").write_text("\n".join(two))
    assert structures.read_pdb(spark, str(tmp_path / "two.pdb")).count() == 2
    both = structures.read_structures(spark, {"a": str(path), "b": str(tmp_path / "two.pdb")})
    assert {(r.stem, r["count"]) for r in both.groupBy("stem").count().collect()} == {("a", 5), ("b", 2)}
    ids = omission.polymer_ids(structures.read_pdb(spark, str(path)), "amino_acids").collect()
    assert [r.key for r in ids] == ["A|1856|SER"]


def test_mmcif(spark, tmp_path):
    names = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "pdbx_PDB_model_num"]
    text = "data_x\n_cell.length_a 10\nloop_\n" + "\n".join(f"_atom_site.{n}" for n in names) + "\nATOM 1 N N . SER A 5 ? 1.0 2.0 3.0 1.0 9.0 1\nHETATM 2 O \"O5'\" A LIG B 7 ? -1.0 2.0 3.0 1.0 9.0 1\nATOM 3 N N . SER A 5 ? 1.0 2.0 3.0 1.0 9.0 2\n#\nloop_\n_other.a\n1\n"
    (tmp_path / "m.cif").write_text(text)
    got = structures.read_structure(spark, str(tmp_path / "m.cif")).orderBy("serial").collect()
    assert [(r.atom, r.altloc, r.resname, r.resnum, r.x) for r in got] == [("N", "", "SER", 5, 1.0), ("O5'", "A", "LIG", 7, -1.0)]


def test_ccp4_round_trip(spark, tmp_path):
    values = np.random.default_rng(0).normal(size=(4, 5, 6)).astype(np.float32)
    cell = Cell(10, 12, 14, 90, 100, 90)
    data = maps.format_ccp4(values, cell, 5)
    back, got, group = maps.parse_ccp4(data)
    assert np.array_equal(back, values) and group == 5 and got.beta == pytest.approx(100)
    (tmp_path / "m.ccp4").write_bytes(data)
    rows = maps.read_ccp4(spark, str(tmp_path / "m.ccp4"))
    assert rows.count() == 120 and rows.where("i = 1 and j = 2 and k = 3").first().value == values[1, 2, 3]
    out = maps.ccp4_files(rows, "path", cell, (4, 5, 6)).first()
    assert np.array_equal(maps.parse_ccp4(bytes(out.content))[0], values)


def test_ccp4_symmetry():
    """A file that holds half of the cell is completed by its operators; what none reaches stays NaN."""
    rng = np.random.default_rng(0)
    half = rng.normal(size=(4, 4, 2)).astype(np.float32)
    full = np.full((4, 4, 4), np.nan, np.float32)
    full[:, :, :2] = half
    got = maps.expanded(full.copy(), ["X,Y,Z", "X,Y,Z+1/2"])
    assert np.array_equal(got[:, :, 2:], half) and np.array_equal(got[:, :, :2], half)
    turned = maps.expanded(full.copy(), ["-X,-Y,-Z"])
    assert turned[1, 3, 3] == half[3, 1, 1] and np.isnan(turned[1, 1, 2])


def mtz_bytes(columns, table, cell):
    return maps.format_mtz(columns, table, cell, ["X,Y,Z", "-X,Y+1/2,-Z"], 4)


def test_mtz_map(spark, tmp_path):
    cell = Cell(10, 11, 12)
    columns = [("H", "H"), ("K", "H"), ("L", "H"), ("FWT", "F"), ("PHWT", "P"), ("2FOFCWT", "F"), ("PH2FOFCWT", "P")]
    rng = np.random.default_rng(3)
    table = [(h, k, l, 1, 0, rng.uniform(1, 5), rng.uniform(-180, 180)) for h in range(3) for k in range(1, 3) for l in range(1, 3)]
    got, data, read, ops = maps.parse_mtz(mtz_bytes(columns, table, cell))
    assert got == columns and len(ops) == 2 and read == cell and maps.map_labels(got) == ("2FOFCWT", "PH2FOFCWT")
    rho = maps.density(data, got, read, ops)
    assert maps.resolution_limit(data, cell) == pytest.approx(1 / math.sqrt(0.04 + 4 / 121 + 4 / 144))
    for at in ((0, 0, 0), (3, 5, 7), (9, 2, 11), (1, 11, 4)):
        x, direct = np.array(at) / rho.shape, 0.0
        for h, k, l, *_, f, phi in table:
            for point in (x, np.array([-x[0], x[1] + 0.5, -x[2]])):
                direct += 2 * f * math.cos(2 * math.pi * float(np.dot((h, k, l), point)) - math.radians(phi))
        assert rho[at] == pytest.approx(direct / cell.volume(), rel=1e-3, abs=1e-4)
    (tmp_path / "a.mtz").write_bytes(mtz_bytes(columns, table, cell))
    labels = workspace.first_label(maps.read_mtz_columns(spark, str(tmp_path / "a.mtz")), [("F", "SIGF"), ("FWT", "PHWT")], ["FREE"]).first()
    assert labels.f_label == "FWT,PHWT" and labels.rfree_label is None and "free-set" in labels.error
    with pytest.raises(ValueError):
        maps.map_labels([("X", "F")])


def test_screening_sources(spark, tmp_path):
    import sqlite3

    (tmp_path / "s.csv").write_text(" Structure ,HKL\n/a/x1.pdb,/a/x1.mtz\n/a/y-sf.cif,/a/y.mtz\n")
    assert [tuple(r) for r in screening.from_csv(spark, str(tmp_path / "s.csv")).orderBy("id").collect()] == [("x1", "/a/x1.pdb", "/a/x1.mtz"), ("y", "/a/y-sf.cif", "/a/y.mtz")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="structure"):
        screening.from_csv(spark, str(tmp_path / "bad.csv"))
    with sqlite3.connect(tmp_path / "s.sqlite") as db:
        db.execute("CREATE TABLE mainTable (CrystalName, RefinementOutcome, RefinementPDB_latest, RefinementMTZ_latest, DimplePathToPDB, DimplePathToMTZ)")
        db.executemany("INSERT INTO mainTable VALUES (?,?,?,?,?,?)", [("a", "5 - Deposition ready", "r", "m", "d", "e"), ("b", None, None, "m", "d", "e"), ("c", "6 - Deposited", "r", None, "d", None), ("d", "3 - x", "r", "m", None, None)])
    every = screening.from_sqlite(spark, str(tmp_path / "s.sqlite"))
    assert sorted(map(tuple, every.collect())) == [("a", "r", "m"), ("b", "d", "e"), ("d", "r", "m")]
    assert [r.id for r in screening.from_sqlite(spark, str(tmp_path / "s.sqlite"), "Deposition ready, Deposited").collect()] == ["a"]
    assert [r.id for r in screening.from_sqlite(spark, str(tmp_path / "s.sqlite"), cap=2).collect()] == ["a", "b"]


def workspace_at(root, stem):
    (root / "processed").mkdir(parents=True)
    (root / "metadata").mkdir()
    (root / "processed" / f"{stem}_updated.pdb").write_text("\n".join(PDB))
    (root / f"{stem}.pdb").write_text("\n".join(PDB))
    (root / "metadata" / f"{stem}_omission_map.json").write_text('{"A|1856|SER|N|": [0, 2], "A|1856|SER|CA|A": []}')


def test_discovery(spark, tmp_path):
    for stem in ("x1", "x2"):
        workspace_at(tmp_path / stem, stem)
    (tmp_path / "x3").mkdir()
    assert [e.stem for e in workspace.find_experiments(tmp_path)] == ["x1", "x2"]
    assert [e.stem for e in workspace.find_experiments(tmp_path / "x1")] == ["x1"]
    frame = workspace.experiments_frame(spark, tmp_path)
    assert frame.count() == 2 and all(r.original_pdb.endswith(f"{r.stem}.pdb") for r in frame.collect())
    held = workspace.read_omissions(spark, str(tmp_path / "x1" / "metadata")).select("key", "map_ids")
    assert {r["key"]: r.map_ids for r in held.collect()} == {"A|1856|SER|N|": [0, 2], "A|1856|SER|CA|A": []}
    workspace.write_omissions(held, tmp_path / "out.json")
    assert workspace.read_omissions(spark, str(tmp_path / "out.json")).count() == 2


def test_map_choice(spark):
    paths = [("a", f"/r/a_k_1.0_cap_{c}_snr") for c in (10, 30, 50, 100)] + [("b", "/r/b_k_1.0_cap_50_snr"), ("c", "/r/c_k_2.0_cap_9_snr")]
    df = spark.createDataFrame(paths, "stem string, path string")
    assert {r.stem: r.cap for r in workspace.chosen_maps(df, 1.0, None).collect()} == {"a": 100, "b": 50}
    assert {r.stem: r.cap for r in workspace.chosen_maps(df, 1.0, 30).collect()} == {"a": 30, "b": 50}
    stems = spark.createDataFrame([("a",), ("c",)], "stem string")
    assert {r.stem: r.error for r in workspace.require_maps(stems, workspace.chosen_maps(df, 1.0, None)).collect()} == {"a": None, "c": "no map found for c"}


def test_trilinear_values(spark):
    dims, cell = (2, 2, 2), Cell(2, 2, 2)
    grid = spark.createDataFrame([(i, j, k, float(i + 10 * j + 100 * k)) for i in range(2) for j in range(2) for k in range(2)], "i int, j int, k int, value double")
    points = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 1, 2), (3, 4, 0, 0)], "atom_id int, u long, v long, w long")
    got = {r.atom_id: r.value for r in spatial.with_values(points, grid, dims, (2, 2, 2)).collect()}
    assert got == {1: 0.5, 2: 0.5 + 5.0 + 100.0, 3: 0.0}
    assert cell.volume() == 8


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.9), ("b<", None), ("c", 0.65)], "stem string, opia double")
    assert [(r.stem, r.rank, r.badge) for r in report.screen_rank(df).orderBy("rank").collect()] == [("a", 1, "green"), ("c", 2, "yellow"), ("b<", 3, "none")]
    page = "".join(report.html_pages(["stem", "opia"], [r.asDict() for r in report.screen_rank(df).orderBy("rank").collect()]))
    assert "b&lt;" in page and "N/A" in page and page.index("a</td>") < page.index("c</td>")
    assert '"opia":"N/A"' in report.experiment_json(df).where("opia is null or stem = 'b<'").first().json
    assert "set_contour_level_absolute(map_0, 1.5000)" in report.viewer_script("s", "m.pdb", ["a.ccp4"], (1, 2, 3), 1.5)


def test_plots():
    import xml.etree.ElementTree as ET

    line = ET.fromstring(report.profile_svg([(3, 0.5), (1, 1.2), (2, 0.1)], "a < b")).find("{*}polyline")
    assert len(line.get("points").split()) == 3 and line.get("points").startswith("40.0,30.0")
    page = ET.fromstring(report.waters_svg([(1, 0.9, True), (2, 0.2, False), (3, 0.1, False)], 0.5))
    assert [c.get("fill") for c in page.findall("{*}circle")] == ["#2CA02C", "#D62728", "#D62728"] and "keep 1, remove 2" in "".join(page.itertext())
    with pytest.raises(ValueError):
        report.waters_svg([], 0.5)


def test_radii_tables(spark, tmp_path):
    from densika.functions import radii

    (tmp_path / "r.txt").write_text("# mine\nU 4 0.7 0.8 0.9 1.0 1.1 1.2\nMg, 2, 1, 1, 1, 1, 1, 1\n")
    atoms = spark.createDataFrame([(1, "U", 4), (2, "MG", 2), (3, " fe", 3), (4, "Fe", 1), (5, "N", 7)], "atom_id int, element string, charge int")
    got = {r.atom_id: r.radius for r in radii.with_radius_interp(atoms, radii.read_table(spark, str(tmp_path / "r.txt")), F.lit(1.0)).collect()}
    assert got == {1: pytest.approx(0.8), 2: 1.0, 3: pytest.approx(0.96), 4: pytest.approx(0.99), 5: pytest.approx(1.11)}
    (tmp_path / "bad.txt").write_text("U 4 0.7\n")
    with pytest.raises(ValueError):
        radii.read_table(spark, str(tmp_path / "bad.txt"))


def test_bonds_of_large_atoms(spark):
    """Caesium far from carbon but within the sum of their radii, both ways, once; hydrogens never."""
    rows = [(1, "C", 0.0), (2, "CS", 3.5), (3, "CS", 8.7), (4, "C", -1.5), (5, "H", 0.5), (6, "C", 20.0)]
    df = spark.createDataFrame([(i, e, x, 0.0, 0.0) for i, e, x in rows], "atom_id int, element string, x double, y double, z double")
    want = {(1, 2), (2, 1), (1, 4), (4, 1), (2, 3), (3, 2)}
    got = [tuple(r) for r in spatial.bonds(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_scripts():
    from densika.config import Slurm

    text = jobs.array_script(Slurm(partition="p"), 7, "run", "m.txt", after="12")
    assert "--array=1-7" in text and "--partition=p" in text and "afterok:12" in text
    assert jobs.chain_script(["a.sh", "b.sh"]).count("sbatch") == 2


def test_databases_of_a_folder_are_read_in_order(spark, tmp_path):
    import sqlite3

    for name, rows in (("002", [("c", "r", "m"), ("d", "r", "m")]), ("010", [("a", "r", "m")]), ("001", [("e", "r", "m"), ("b", None, "m")])):
        with sqlite3.connect(tmp_path / f"{name}.sqlite") as db:
            db.execute("CREATE TABLE mainTable (CrystalName, RefinementPDB_latest, RefinementMTZ_latest, DimplePathToPDB, DimplePathToMTZ)")
            db.executemany("INSERT INTO mainTable VALUES (?,?,?,NULL,NULL)", rows)
    assert [r.id for r in screening.from_sqlite(spark, str(tmp_path), cap=3).collect()] == ["e", "c", "d"]
    assert sorted(r.id for r in screening.from_sqlite(spark, str(tmp_path)).collect()) == ["a", "c", "d", "e"]


def test_screening_databases_aren_t_made_by_the_driver(spark, sf_dir, monkeypatch):
    from pyspark.sql import DataFrame

    from densika.plans import queries

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("rows to the driver"))
    assert queries.queries()["screening_sqlite"](spark, sf_dir).count() > 0


def test_serials_of_six_digits_and_more(spark, tmp_path):
    """They move the columns behind them, which mean the same all the same."""
    from densika.sources import structures

    rows = [(n, "ATOM" if n % 2 else "HETATM", n, "C1", "", "ALA", "A", 7, "", 1.5, -2.25, n / 1000, 1.0, "C") for n in (7, 99_999, 100_000, 1_234_567)]
    names = "atom_id long, record string, serial long, atom string, altloc string, resname string, chain string, resnum int, icode string, x double, y double, z double, occupancy double, element string"
    none = spark.createDataFrame([], "chain string, resnum int, icode string, atom string, score double")
    lines = structures.scored_lines(spark.createDataFrame(rows, names), none).orderBy("atom_id").collect()
    (tmp_path / "m.pdb").write_text("\n".join(r.value for r in lines))
    got = structures.read_pdb(spark, str(tmp_path / "m.pdb")).select("serial", "record", "atom", "resname", "chain", "resnum", "x", "y", "z", "occupancy", "element").orderBy("serial").collect()
    assert [tuple(r) for r in got] == [(r[2], r[1], "C1", "ALA", "A", 7, 1.5, -2.25, r[2] / 1000, 1.0, "C") for r in rows]
    assert not structures.model_faults(spark, {"m": str(tmp_path / "m.pdb")}).collect()
