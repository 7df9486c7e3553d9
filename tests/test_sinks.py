"""The file sink, discovery by listing, pruned p-values and faulty inputs of the stages."""

from __future__ import annotations

import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from densika import api
from densika.functions import student_t
from densika.functions.cell import Cell
from densika.operators import ensemble
from densika.plans import file_queries
from densika.sources import files, maps, sink, workspace
from tests.test_api import crystal_at
from tests.test_operators import workspace_at


def left(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_groups_become_files(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit(f"{tmp_path}/d"), (F.col("id") % 7).cast("string"), F.lit("/x.txt")).alias("path"), F.col("id").alias("turn"), F.col("id").cast("string").alias("value"))
    for uri in ("", "file://"):
        files.write_lines(rows.withColumn("path", F.concat(F.lit(uri), "path")).repartition(5), f"{uri}{tmp_path}", "head")
        assert left(tmp_path) == [f"d{k}/x.txt" for k in range(7)] and not list(tmp_path.glob("_staging*"))
        assert (tmp_path / "d3/x.txt").read_text().split() == ["head", *map(str, range(3, 100, 7))]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "g2").write_text("before")

    def content(pdf: pd.DataFrame) -> bytes:
        if pdf["path"].iloc[0].endswith("g5"):
            raise ValueError("no file of this group")
        return b"after"

    rows = spark.range(40).select(F.concat(F.lit(f"{tmp_path}/g"), (F.col("id") % 8).cast("string")).alias("path"))
    with pytest.raises(Exception, match="no file of this group"):
        files.write_groups(rows, content, str(tmp_path))
    assert left(tmp_path) == ["g2"] and (tmp_path / "g2").read_text() == "before" and not list(tmp_path.glob("_staging*"))
    files.write_groups(rows.where("path not like '%g5'"), content, str(tmp_path))
    assert len(left(tmp_path)) == 7 and (tmp_path / "g2").read_text() == "after"


def test_only_committed_attempts_count(tmp_path):
    writer = sink.FileWriter(f"{tmp_path}/_staging-1")
    first = writer.write(iter([{"path": f"{tmp_path}/a/x", "data": b"one"}]))
    again = writer.write(iter([{"path": f"{tmp_path}/a/x", "data": b"two"}, {"path": f"{tmp_path}/b", "data": bytearray(b"b")}]))
    assert len(first.files) == 1 and left(tmp_path) != []
    writer.commit([again, None])
    assert left(tmp_path) == ["a/x", "b"] and (tmp_path / "a/x").read_bytes() == b"two"
    sink.FileWriter(f"{tmp_path}/_staging-2").abort([])


def test_experiments_from_a_listing(spark, tmp_path):
    for stem in ("x2", "x1", "y z+%41"):
        workspace_at(tmp_path / stem, stem)
    (tmp_path / "x1/results/x1_3").mkdir(parents=True, exist_ok=True)
    (tmp_path / "x1/results/x1_3/x1_3.mtz").write_bytes(b"m")
    (tmp_path / "x1/results/x1_3/x1_4.mtz").write_bytes(b"m")
    (tmp_path / "bad/metadata").mkdir(parents=True)
    (tmp_path / "bad/metadata/bad_omission_map.json").write_text("{}")
    plain, listed = list(workspace.find_experiments(tmp_path)), workspace.experiments(spark, tmp_path)
    assert [e.stem for e in listed] == [e.stem for e in plain] == ["x1", "x2", "y z+%41"]
    for a, b in zip(plain, listed, strict=True):
        assert (a.processed, a.original, a.omission_json, a.map_files(None), a.missing()) == (b.processed, b.original, b.omission_json, b.map_files(None), b.missing())
    assert listed[0].map_files(None).keys() == {3} and listed[0].map_files(3) == {}
    assert [e.stem for e in workspace.experiments(spark, tmp_path / "x1")] == ["x1"] and workspace.experiments(spark, tmp_path / "none") == []
    sizes = {r.below: r["size"] for r in workspace.listing(spark, f"file://{tmp_path}").collect()}
    assert sizes["x1/results/x1_3/x1_4.mtz"] == 1 and len(sizes) == len(left(tmp_path))


def test_p_values_are_left_out_where_nobody_reads_them(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", -2.0), ("c", 0.5), ("a", None)], "stem string, snr double")
    params = spark.createDataFrame([("a", 3.0, 0.0, 1.0), ("b", 5.0, 0.5, 2.0)], "stem string, df double, loc double, scale double")
    got = student_t.p_values(rows, params, ["stem"])
    told = {(r.stem, r.snr): r.p_value for r in got.collect()}
    assert told["a", 1.0] == pytest.approx(float(student_t.survival([1.0], 3.0)[0])) and told["b", -2.0] == pytest.approx(float(student_t.survival([-2.0], 5.0, 0.5, 2.0)[0]))
    assert all(told[k] is None or math.isnan(told[k]) for k in (("c", 0.5), ("a", None)))
    assert "ArrowEvalPython" not in got.select("stem", "snr")._jdf.queryExecution().executedPlan().toString()


def test_faulty_crystals_don_t_repeat_the_others(spark, tmp_path, monkeypatch):
    cell, calls, work = Cell(12, 12, 12), [], api._quantify_batch
    for stem in ("x1", "x2", "x3", "x4"):
        crystal_at(tmp_path / stem, stem, cell, n_maps=2)
    (tmp_path / "x2/metadata/x2_omission_map.json").write_text("{broken")
    model = next((tmp_path / "x3/processed").glob("x3_updated.*"))
    model.unlink()
    (tmp_path / "x3/processed/x3_updated.cif").write_text("data_x\nloop_\n_atom_site.id\n_atom_site.Cartn_x\n1 a\n")
    (tmp_path / "x4/metadata/x4_omission_map.json").write_text(json.dumps({"A|1856|SER|N|": ["x"]}))

    def counted(spark_, root, batch, *rest):
        calls.append([e.stem for e in batch])
        return work(spark_, root, batch, *rest)

    monkeypatch.setattr(api, "_quantify_batch", counted)
    got = {r.stem: r.error for r in api.run_quantification(spark, str(tmp_path), n_maps=2, n_null=100).collect()}
    assert got["x1"] is None and "omission" in got["x2"] and "model" in got["x3"] and "omission" in got["x4"]
    assert calls == [["x1", "x2", "x3", "x4"]]
    table = tmp_path / "quantify_table" / "k_1.0_cap_2"
    assert [len(list(d.glob("*.parquet"))) for d in table.glob("stem=*")] == [1]


def test_nodes_near_the_origin_need_no_grid(spark, tmp_path):
    """Few reflections of large indices make a grid of thousands of GB, of which only the asked nodes are worked out."""
    columns, cell = [("H", "H"), ("K", "H"), ("L", "H"), ("FWT", "F"), ("PHWT", "P")], Cell(10.0, 11.0, 12.0)
    rows = [(h, k, l, 10 + (7 * h + 5 * k + 3 * l) % 11, (40 * h + 70 * k + 110 * l) % 360) for h in range(-2, 4) for k in range(4) for l in range(1, 4)]
    for operators in (["X,Y,Z"], ["X,Y,Z", "-X,Y+1/2,-Z"]):
        table, cell_ = maps.parse_mtz(maps.format_mtz(columns, np.array(rows), cell, operators))[1:3]
        whole = maps.density(table, columns, cell_, operators)
        assert np.allclose(maps.density_near_origin(table, columns, cell_, operators, (3, 99, 2)), whole[:3, :, :2], atol=1e-6)
    (tmp_path / "x_7.mtz").write_bytes(maps.format_mtz(columns, np.array([*rows, (2000, 1999, 2001, 5, 90)]), cell))
    got = maps.read_mtz_maps(spark, str(tmp_path), workspace.map_keys(), box=(3, 3, 2)).collect()
    assert len(got) == 18 and {(r.stem, r.map_id) for r in got} == {("x", 7)}
    at_origin = sum(2 * f * math.cos(math.radians(phi)) for *_, f, phi in [*rows, (0, 0, 0, 5, 90)]) / cell.volume()
    assert next(r.value for r in got if r.i == r.j == r.k == 0) == pytest.approx(at_origin, abs=1e-6)


def test_whole_maps_by_parts(spark, tmp_path, monkeypatch, frame):
    """All nodes come, whatever the parts, as one transform has them; so they do from the query."""
    monkeypatch.setattr(maps, "VOXELS_A_BATCH", 50)
    columns = [("H", "H"), ("K", "H"), ("L", "H"), ("FWT", "F"), ("PHWT", "P")]
    rng = np.random.default_rng(3)
    rows = [(*rng.integers(-4, 5, 3), rng.uniform(1, 9), rng.uniform(0, 360)) for _ in range(60)] + [(1, 2, 3, np.nan, 0.0)]
    for operators, cell in ((["X,Y,Z", "-X,Y+1/2,-Z"], Cell(11, 12, 13, 90, 100, 90)), (["X,Y,Z"], Cell(9, 14, 10, 80, 95, 105))):
        data = maps.format_mtz(columns, np.array(rows), cell, operators)
        table, read = maps.parse_mtz(data)[1:3]
        whole, found = maps.density(table, columns, read, operators), {}
        for slab in range(5):
            for i, first, values in maps.density_rows(table, columns, read, operators, slab, 5):
                found |= {(i, first + j): v for j, v in enumerate(values)}
        assert sorted(found) == list(np.ndindex(whole.shape[:2]))
        assert np.allclose(np.array([found[at] for at in sorted(found)]).reshape(whole.shape), whole, atol=1e-6)
    (tmp_path / "x_7.mtz").write_bytes(data)
    got = maps.read_mtz_nodes(spark, str(tmp_path), workspace.map_keys()).collect()
    assert len(got) == whole.size and {(r.stem, r.map_id) for r in got} == {("x", 7)}
    assert all(abs(r.value - whole[r.i, r.j, r.k]) < 1e-6 for r in got)
    at = frame("mtz_maps_by_nation").groupBy("stem", "nw").agg(F.count("*").alias("n"), F.max("i").alias("i"), F.max("j").alias("j"), F.max("k").alias("k")).collect()
    assert at and all(r.n == (r.i + 1) * (r.j + 1) * (r.k + 1) and r.k + 1 == r.nw for r in at)


def test_ensembles_are_read_packed(spark, tmp_path, monkeypatch):
    """As from single voxels, whatever the maps' order and rows; a missing map is all zero, one from the cap on is not read."""
    monkeypatch.setattr(maps, "VOXELS_A_ROW", 100)
    columns, cell = [("H", "H"), ("K", "H"), ("L", "H"), ("FWT", "F"), ("PHWT", "P")], Cell(10.0, 11.0, 12.0)
    for stem, numbers in (("x", (0, 1, 3, 7)), ("y_2", (0, 2))):
        for m in numbers:
            rows = [(h, k, l, m + (7 * h + 5 * k + 3 * l) % 11, (40 * h + 70 * k + 110 * l) % 360) for h in range(3) for k in range(4) for l in range(1, 3 + len(stem) % 2)]
            (tmp_path / f"{stem}_{m}.mtz").write_bytes(maps.format_mtz(columns, np.array(rows), cell))
    keys = ["stem", "i", "j", "k"]
    want = {tuple(r)[:4]: r.vals for r in ensemble.packed(maps.read_mtz_maps(spark, str(tmp_path), workspace.map_keys()), keys, 5).collect()}
    got = maps.read_mtz_ensembles(spark, str(tmp_path), 5).select(*keys, "vals").collect()
    assert len(got) == len(want) and {tuple(r)[:4]: r.vals for r in got} == want
    assert {len(v) for v in want.values()} == {5} and len({k[0] for k in want}) == 2


def test_stages_list_files_in_few_tasks(spark, tmp_path):
    """Neither by a task for each path, nor with the session's setting changed for good."""
    paths = []
    for n in range(80):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "a.txt").write_text("x")
        paths.append(str(tmp_path / str(n) / "a.txt"))
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, sc = spark.conf.get(name), spark.sparkContext

    @files.few_listing_tasks
    def stage(spark_, some):
        sc.setJobGroup("listing", "")
        read = spark_.read.text(some)
        sc.setJobGroup("other", "")
        return read, spark_.conf.get(name)

    read, inside = stage(spark, paths)
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(i).numTasks for j in tracker.getJobIdsForGroup("listing") for i in tracker.getJobInfo(j).stageIds]
    assert max(tasks) <= int(inside) == 4 * sc.defaultParallelism < 80 and spark.conf.get(name) == before and read.count() == 80


def test_exported_tables_are_worked_out_once(spark, monkeypatch):
    """What goes into several files is stored, and gone when all are written."""
    root, seen, export = file_queries._screen(spark), {}, api.export

    def looked_at(result, folders, models, out):
        seen.update({n: df._jdf.queryExecution().optimizedPlan().toString() for n, df in {**result, "models": models}.items()})
        export(result, folders, models, out)

    monkeypatch.setattr(api, "export", looked_at)
    api.run_quantification(spark, root, n_maps=4, n_null=50)
    done = {r.stem: r.error for r in api.run_analysis(spark, root, n_maps=4).collect()}
    assert done["x1"] is None and set(seen) == {"atoms", "residues", "summary", "models"}
    assert not [n for n, plan in seen.items() if "Join" in plan or "Aggregate" in plan]
    assert not [p for p in os.listdir(root) if p.startswith("_")]
