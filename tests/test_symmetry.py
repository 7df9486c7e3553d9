"""Symmetry images, the opened solvent mask and what tells them, against plain loops."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from densika import api
from densika.functions.cell import Cell
from densika.operators import ensemble, report, spatial
from densika.sources import files, maps, structures, workspace

SCREW = ["X,Y,Z", "-X,Y+1/2,-Z"]
ATOMS = "stem string, atom_id long, chain string, resnum int, resname string, element string, x double, y double, z double"


def every_image(points, cell, operators, n=6):
    to, back = np.array(cell.orthogonal()), np.array(cell.fractional())
    for text, shift in product(operators, product(range(-n, n + 1), repeat=3)):
        rotation, move = maps.operator(text)
        yield (np.asarray(points) @ back.T @ rotation.T + move + shift) @ to.T


@pytest.mark.parametrize("cell", [Cell(9, 11, 13), Cell(12, 10, 14, 75, 110, 100)])
def test_images_near_a_box(spark, cell):
    rng = np.random.default_rng(3)
    points, targets = rng.uniform(-20, 20, (6, 3)), rng.uniform(-12, 15, (30, 3))
    crystals = api.crystal_table(spark, [api.crystal_row("c", cell, (4, 4, 4), 2.0, 4, SCREW)])
    table = [spark.createDataFrame([("c", n, *map(float, p)) for n, p in enumerate(x)], "stem string, n int, x double, y double, z double") for x in (points, targets)]
    got = spatial.symmetry_images(table[0], crystals, 3.0, ["stem"], spatial.bounding_box(table[1], crystals, ["stem"])).collect()
    assert len({(r.n, r.image, *r["shift"]) for r in got}) == len(got)
    found = {(r.n, *np.round([r.x, r.y, r.z], 5)) for r in got}
    for image in every_image(points, cell, SCREW):
        near = np.linalg.norm(image[:, None] - targets, axis=2).min(1) <= 3.0
        assert {(n, *np.round(image[n], 5)) for n in np.flatnonzero(near)} <= found


def test_a_ligand_that_touches_only_a_symmetry_mate(spark):
    cell = Cell(30, 40, 50)
    crystals = api.crystal_table(spark, [api.crystal_row("c", cell, (4, 4, 4), 2.0, 4, SCREW)])
    # The mate of (2, 21, 3) under the screw is (-2, 41, -3), a cell less along b.
    rows = [("c", 1, "L", 1, "LIG", "C", -2.5, 1.0, -3.0), ("c", 2, "A", 7, "ALA", "C", 2.0, 21.0, 3.0), ("c", 3, "A", 8, "GLY", "C", 10.0, 10.0, 20.0), ("c", 4, "B", 2, "HOH", "O", 27.5, 1.0, 49.0), ("c", 5, "A", 9, "SER", "H", -2.5, 1.5, -3.0)]
    rows += [("d", *r[1:]) for r in rows]
    atoms = spark.createDataFrame(rows, ATOMS)
    assert report.ligand_neighbours(atoms, 4.0, by=["stem"]).count() == 0
    near = report.ligand_neighbours(atoms, 4.0, by=["stem"], crystals=crystals)  # d has no cell
    assert sorted(tuple(r) for r in near.collect()) == [("c", "A", 7, "ALA", "protein"), ("c", "B", 2, "HOH", "water")]
    listed = report.neighbour_lists(near, ["stem"]).first().neighbours
    assert [(n.chain, n.resnum) for n in listed] == [("A", 7), ("B", 2)]


PDB = """REMARK 290   SMTRY1   1  1.000000  0.000000  0.000000        0.00000
REMARK 290   SMTRY2   1  0.000000  1.000000  0.000000        0.00000
REMARK 290   SMTRY3   1  0.000000  0.000000  1.000000        0.00000
REMARK 290   SMTRY1   2 -1.000000  0.000000  0.000000        0.00000
REMARK 290   SMTRY2   2  0.000000  1.000000  0.000000       20.00000
REMARK 290   SMTRY3   2  0.000000  0.000000 -1.000000        0.00000
CRYST1   30.000   40.000   50.000  90.00 100.00  90.00 P 1 21 1
"""
CIF = """data_x
_cell.length_a 30.000(2)
_cell.length_b 40
_cell.length_c 50 _cell.angle_alpha 90 _cell.angle_beta 100
_cell.angle_gamma 90
loop_
_symmetry_equiv.id
_symmetry_equiv.pos_as_xyz
1 'x, y, z'
2 "-x, y+1/2, -z"
"""


def test_symmetry_of_models(spark, tmp_path):
    texts = {"pdb.pdb": PDB, "cif.cif": CIF, "plain.pdb": PDB.splitlines()[-1], "none.pdb": "CRYST1    1.000    1.000    1.000  90.00  90.00  90.00 P 1", "bare.cif": "data_y\n_cell.length_a ?\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r.stem: r for r in structures.read_symmetry(spark, {n.partition(".")[0]: str(tmp_path / n) for n in texts}).collect()}
    assert set(got) == {"pdb", "cif", "plain"}
    want = [maps.operator(o) for o in SCREW]
    for name, n in (("pdb", 2), ("cif", 2), ("plain", 1)):
        assert len(got[name].images) == n and np.allclose(got[name].frac, np.array(Cell(30, 40, 50, 90, 100, 90).fractional()).ravel())
        for image, (rotation, shift) in zip(got[name].images, want, strict=False):
            assert np.allclose(np.array(image.r).reshape(3, 3), rotation) and np.allclose(image.t, shift)


def test_operators_of_the_map_where_the_model_has_none(spark, tmp_path):
    e = workspace.Experiment("x1", tmp_path / "x1")
    (tmp_path / "m.pdb").write_text(PDB.splitlines()[-1])
    table = np.array([(h, k, l, 1.0, 0.0) for h in range(2) for k in range(2) for l in range(1, 3)])
    data = maps.format_mtz([("H", "H"), ("K", "H"), ("L", "H"), ("FWT", "F"), ("PHWT", "P")], table, Cell(30, 40, 50, 90, 100, 90))
    at = data.rfind(b"END" + b" " * 77)
    screw = f"SYMM {SCREW[1]}".ljust(80).encode()  # the identity is there
    files.put(str(tmp_path / "x1/results/x1_0/x1_0.mtz"), data[:at] + screw + data[at:])
    got = report.symmetry(spark, [e], {"x1": str(tmp_path / "m.pdb")}).first()
    assert len(got.images) == 2 and got.images[1].t == [0.0, 0.5, 0.0]
    assert got.images[0].r == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def opened(points, atoms, cell, operators, probe, shrink, spacing):
    """The mask on the whole grid: free nodes, grown by ``shrink``; a point needs all nodes around it."""
    to = np.array(cell.orthogonal())
    dims = [int(np.ceil(e / spacing)) for e in (cell.a, cell.b, cell.c)]
    nodes = np.stack(np.meshgrid(*map(np.arange, dims), indexing="ij"), -1).reshape(-1, 3)
    place = nodes / dims @ to.T
    free = np.ones(len(nodes), bool)
    xyz, vdw = np.array([a[:3] for a in atoms]), np.array([a[3] for a in atoms])
    for image in every_image(xyz, cell, operators, 2):
        for p, r in zip(image, vdw, strict=True):
            free &= np.linalg.norm(place - p, axis=1) - r > probe
    solvent = free.reshape(dims).copy()
    for d in product(range(-3, 4), repeat=3):
        if np.linalg.norm(np.array(d) / dims @ to.T) <= shrink:
            solvent |= np.roll(free.reshape(dims), d, (0, 1, 2))
    out = set()
    for n, f in enumerate(points):
        low = np.floor(np.array(f) * dims).astype(int)
        corners = product(*[(b, b + 1) if x * s > b else (b,) for b, x, s in zip(low, f, dims, strict=True)])
        if all(solvent[tuple(np.array(c) % dims)] for c in corners):
            out.add(n)
    return out


@pytest.mark.parametrize("cell", [Cell(10, 11, 9), Cell(11, 10, 12, 90, 105, 90)])
def test_the_mask_is_opened(spark, cell):
    rng = np.random.default_rng(8)
    atoms = [(*map(float, p), 1.2) for p in rng.uniform(0, 10, (5, 3))]
    points = [tuple(map(float, p)) for p in rng.normal(0, 1, (500, 3))]
    crystals = api.crystal_table(spark, [api.crystal_row("c", cell, (4, 4, 4), 2.0, 4, SCREW)])
    model = spark.createDataFrame([("c", *a) for a in atoms], "stem string, x double, y double, z double, vdw double")
    asked = spark.createDataFrame([("c", n, *p) for n, p in enumerate(points)], "stem string, id int, fa double, fb double, fc double")
    want = opened(points, atoms, cell, SCREW, 1.1, 0.9, 0.5)
    assert {r.id for r in ensemble.bulk_solvent(asked, model, crystals).collect()} == want and 20 < len(want) < 480


def test_a_cavity_smaller_than_the_probe_gives_no_sample(spark):
    """A shell of atoms around a hole: far enough from them all by distance, but no probe fits."""
    cell, r = Cell(30, 30, 30), 2.7
    n = np.arange(300)
    z, turn = 1 - 2 * (n + 0.5) / 300, n * np.pi * (3 - np.sqrt(5))
    shell = 15 + r * np.stack((np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z), 1)
    crystals = api.crystal_table(spark, [api.crystal_row("c", cell, (4, 4, 4), 2.0)])
    model = spark.createDataFrame([("c", *map(float, p), 1.7) for p in shell], "stem string, x double, y double, z double, vdw double")
    asked = spark.createDataFrame([("c", 0, 0.5, 0.5, 0.5), ("c", 1, 0.05, 0.05, 0.05)], "stem string, id int, fa double, fb double, fc double")
    assert {r.id for r in ensemble.outside_model(asked, model, crystals).collect()} == {0, 1}
    assert {r.id for r in ensemble.bulk_solvent(asked, model, crystals).collect()} == {1}
    assert {r.id for r in ensemble.bulk_solvent(asked, model.withColumn("vdw", F.lit(1.4)), crystals).collect()} == {0, 1}  # here one fits


CIF_ATOMS = """data_m
# a comment with 'quotes
_struct.title
;A title; over
two lines, with loop_ and _atom_site.id in it
;
loop_
_entity.id
_entity.details
1 'it''s no loop_'
2
;text
 more 'text
;
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.details
_atom_site.pdbx_PDB_model_num
HETATM 4 C C1 LIG B 1 9 9 9 . 5
ATOM 1 N N ALA A 1 1.0 2.0 3.0 "a b" 3
ATOM 2 O "O5'" ALA A 1 1.5
2.5 3.5
;many
lines
;
3
ATOM 3 C 'C"1' GLY A 2 4 5 6 ? 3
_after.item 'x'
data_other
loop_
_atom_site.id
1
"""


def test_cif(spark, tmp_path):
    (tmp_path / "m.cif").write_text(CIF_ATOMS)
    got = structures.read_mmcif(spark, str(tmp_path / "m.cif")).orderBy("serial").collect()
    assert [(a.serial, a.atom, a.resname, a.chain, a.resnum, a.x, a.y, a.z) for a in got] == [(1, "N", "ALA", "A", 1, 1.0, 2.0, 3.0), (2, "O5'", "ALA", "A", 1, 1.5, 2.5, 3.5), (3, 'C"1', "GLY", "A", 2, 4.0, 5.0, 6.0)]
    held = structures.parse_cif(CIF_ATOMS, ["_entity", "_struct", "_after", "_absent"])
    assert held["_entity"] == [{"id": "1", "details": "it''s no loop_"}, {"id": "2", "details": "text\n more 'text"}]
    assert held["_struct"] == [{"title": "A title; over\ntwo lines, with loop_ and _atom_site.id in it"}] and held["_after"] == [{"item": "x"}] and held["_absent"] == []
    with pytest.raises(ValueError, match="within a row"):
        structures.parse_cif("data_x loop_ _a.b _a.c 1 2 3", ["_a"])
    with pytest.raises(ValueError, match="no value"):
        structures.parse_cif("data_x _a.b _a.c 1", ["_a"])
