"""Queries that pass through files: what is written by a sink is read back by the source that fits it."""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid
from contextlib import closing
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densika import api
from densika.config import Debias, MapNormalization, Run, Scoring, WaterScoring, layered, yaml_blocks
from densika.functions import radii, student_t
from densika.functions.cell import Cell
from densika.operators import aggregates, ensemble, omission, report, scoring, spatial
from densika.plans import analogues as A
from densika.plans.queries import BOND_SCALE, CELL, SCORE_SCALE, _customers, _diagnosed, _omission_maps, _order, _scored_inputs, _screening, query, rounded
from densika.sources import files, maps, parameters, screening, structures, workspace
from densika.sources.events import EventLog
from densika.sources.sink import write_files


def folder(s: SparkSession, name: str) -> str:
    """A new folder that executors share: beside the checkpoints, or of a local session a temporary one."""
    set_ = s.sparkContext.getCheckpointDir() or s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_ and not s.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    out = f"{set_.removeprefix('file:')}/{name}-{uuid.uuid4().hex}" if set_ else tempfile.mkdtemp(prefix=f"densika-{name}-")
    os.makedirs(out, exist_ok=True)
    return out


@query
def omission_json(s: SparkSession, d: str) -> DataFrame:
    out = folder(s, "omission")
    held = _omission_maps(s, d).withColumn("path", F.concat(F.lit(f"{out}/"), F.col("crystal").cast("string"), F.lit("_omission_map.json")))
    files.write_groups(held.select("path", "key", "map_ids"), workspace.omission_bytes, out)
    read = workspace.read_omissions(s, out)
    crystal = F.regexp_extract("path", "([0-9]+)_omission_map", 1).cast("int")
    return read.select(crystal.alias("crystal"), "key", F.size("map_ids").cast("long").alias("n_maps"))


#: Reflections of a made-up crystal: index, amplitude and phase follow from a number.
HKL = [(h, k, l) for h in range(4) for k in range(4) for l in range(1, 4)]
MTZ_CELL = Cell(10.0, 11.0, 12.0)


def _mtz(s: SparkSession) -> str:
    out = folder(s, "mtz")
    table = [(h, k, l, 10 + (7 * h + 5 * k + 3 * l) % 11, (40 * h + 70 * k + 110 * l) % 360) for h, k, l in HKL]
    columns = [("H", "H"), ("K", "H"), ("L", "H"), ("FWT", "F"), ("PHWT", "P")]
    files.put(f"{out}/x1_0/x1_0.mtz", maps.format_mtz(columns, np.array(table), MTZ_CELL))
    return f"{out}/x1_0/x1_0.mtz"


@query
def mtz_map(s: SparkSession, d: str) -> DataFrame:
    got = maps.read_mtz_maps(s, _mtz(s))
    return rounded(got.select(*workspace.map_name(F.col("path")), "i", "j", "k", F.col("value").cast("double").alias("value")), "value", digits=3)


@query
def mtz_header(s: SparkSession, d: str) -> DataFrame:
    got = maps.read_mtz_headers(s, _mtz(s))
    sizes = [F.get("dims", F.lit(i)).alias(n) for i, n in enumerate(("nu", "nv", "nw"))]
    return rounded(got.select("resolution", *sizes, "spacegroup", F.element_at("edges", 3).alias("c")), "resolution")


@query
def ccp4_round_trip(s: SparkSession, d: str) -> DataFrame:
    out = folder(s, "ccp4")
    crystals = api.crystal_table(s, [api.crystal_row("g", CELL, A.DIMS, 2.0)])
    voxels = A.grid(s).select(F.lit("g").alias("stem"), F.lit(f"{out}/g_snr.ccp4").alias("path"), "i", "j", "k", F.col("value").cast("float").alias("value"))
    maps.write_ccp4(voxels, crystals, out)
    return rounded(maps.read_ccp4(s, out).select("i", "j", "k", F.col("value").cast("double").alias("value")), "value")


def _model_atoms(s: SparkSession, d: str) -> DataFrame:
    return A.atoms(s, d, BOND_SCALE).select(
        "atom_id", F.when(F.col("resname").isin("HOH", "LIG"), "HETATM").otherwise("ATOM").alias("record"), F.col("atom_id").alias("serial"),
        F.concat(F.lit("C"), (F.col("atom_id") % 8).cast("string")).alias("atom"), F.lit("").alias("altloc"), "resname", "chain", (F.col("resnum") % 9000).alias("resnum"), "icode",
        *[F.round(c, 3).alias(c) for c in "xyz"], F.lit(1.0).alias("occupancy"), F.lit("C").alias("element"),
    )


@query
def pdb_round_trip(s: SparkSession, d: str) -> DataFrame:
    out, atoms = folder(s, "pdb"), _model_atoms(s, d)
    none = s.createDataFrame([], "chain string, resnum int, icode string, atom string, score double")
    lines = structures.scored_lines(atoms, none).select(F.lit(f"{out}/m.pdb").alias("path"), F.col("atom_id").alias("turn"), "value")
    files.write_lines(lines, out)
    got = structures.read_structures(s, {"m": f"{out}/m.pdb"})
    return rounded(got.select("serial", "record", "atom", "resname", "chain", "resnum", "x", "y", "z", "b_iso"), "x", "y", "z", digits=3)


@query
def mmcif_round_trip(s: SparkSession, d: str) -> DataFrame:
    out, atoms = folder(s, "mmcif"), _model_atoms(s, d)
    names = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]
    line = F.concat_ws(" ", "record", "serial", "element", "atom", "resname", "chain", "resnum", *[F.format_string("%.3f", c) for c in "xyz"], F.lit("1"))
    header = "\n".join(["data_m", "loop_", *[f"_atom_site.{n}" for n in names]])
    files.write_lines(atoms.select(F.lit(f"{out}/m.cif").alias("path"), F.col("atom_id").alias("turn"), line.alias("value")), out, header)
    got = structures.read_structures(s, {"m": f"{out}/m.cif"})
    return rounded(got.select("serial", "record", "atom", "resname", "chain", "resnum", "x", "y", "z"), "x", "y", "z", digits=3)


ROWS_A_DATABASE = 50_000


@query
def screening_sqlite(s: SparkSession, d: str) -> DataFrame:
    """Databases of so many rows each, made where the rows are, and read in their order."""
    out = folder(s, "sqlite")
    rows = _screening(s, d)
    names = rows.columns[1:]

    def database(pdf: pd.DataFrame) -> bytes:
        with closing(sqlite3.connect(":memory:")) as db:
            db.execute(f"CREATE TABLE mainTable ({', '.join(names)})")
            ordered = pdf.sort_values("row")[names].astype(object)
            db.executemany(f"INSERT INTO mainTable VALUES ({', '.join('?' * len(names))})", ordered.where(ordered.notna(), None).itertuples(index=False, name=None))
            db.commit()
            return db.serialize()

    part = F.format_string("%012d", F.floor(F.col("row") / ROWS_A_DATABASE))
    files.write_groups(rows.withColumn("path", F.concat(F.lit(f"{out}/"), part, F.lit(".sqlite"))), database, out)
    return screening.from_sqlite(s, out, "URGENT, HIGH", cap=500)


@query
def screening_csv_file(s: SparkSession, d: str) -> DataFrame:
    out = folder(s, "csv")
    pages = A.table(s, d, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias(" Model "), F.col("url").alias("SF"))
    pages.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    return screening.from_csv(s, out)


@query
def parameter_files(s: SparkSession, d: str) -> DataFrame:
    """A file of nested blocks for each nation, saved, loaded and laid out as rows."""
    out, rows = folder(s, "params"), []
    for r in A.table(s, d, "nation").toLocalIterator():
        path = f"{out}/{r.n_nationkey}.params"
        values = {"input.name": r.n_name, "input.xray.region": r.n_regionkey, "input.xray.flag": r.n_nationkey % 2 == 0, "output.title": f"the {r.n_name} job", "output.none": None}
        parameters.save(parameters.filled("input {\n  kept = 1.5\n}", values), path)
        loaded = parameters.load(path)
        assert parameters.get(loaded, "input.xray.region") == r.n_regionkey
        rows += [(r.n_nationkey, *x) for x in parameters.flattened(loaded)]
    return s.createDataFrame(rows, "n_nationkey int, name string, value string, kind string")


@query
def map_parameters(s: SparkSession, d: str) -> DataFrame:
    """Parameters of a map and of the preparing programs, as rows."""
    job = parameters.map_job("/m.pdb", "/m.mtz", "FP,SIGFP", "FREE", "/r/x_0.mtz", "x_0", "(chain A and resseq 1)", True)
    rows = [("map", *x) for x in parameters.flattened(job)]
    rows += [(name, *x) for name, values in parameters.preparation_jobs("/p", "x", ".pdb").items() for x in parameters.flattened(values)]
    return s.createDataFrame(rows, "file string, name string, value string, kind string")


@query
def experiment_discovery(s: SparkSession, d: str) -> DataFrame:
    """Experiments among folders that lack now the model, now the omissions, now the original."""
    out, n = folder(s, "screen"), F.col("s_suppkey")
    rows = A.table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("x"), n.cast("string")).alias("stem"))
    rows = rows.repartition(4 * s.sparkContext.defaultParallelism, "s_suppkey")  # a small table has one part
    if faults := workspace.layouts(rows, out).take(1):
        raise OSError(faults[0].error)
    root = F.concat(F.lit(f"{out}/"), "stem", F.lit("/"))

    def file(there: Column, *name: Column | str, data: bytes = b"\n") -> Column:
        return F.when(there, F.struct(F.concat(root, *name).alias("path"), F.lit(data).alias("data")))

    made = F.array(
        file(n % 3 != 0, F.lit("processed/"), "stem", F.when(n % 2 != 0, "_updated.cif").otherwise("_updated.pdb")),
        file(n % 4 != 0, F.lit("metadata/"), "stem", F.lit("_omission_map.json"), data=b"{}"),
        file(n % 5 != 0, F.when(n % 7 != 0, F.col("stem")).otherwise("other"), F.lit(".pdb")),
    )
    write_files(rows.select(F.explode(made).alias("f")).where("f is not null").select("f.*"), out)
    got = workspace.experiments_frame(s, out)
    last = {c: F.regexp_extract(c, "([^/]*)$", 1) for c in ("processed_pdb", "original_pdb", "omission_json")}
    return got.select("stem", *[c.alias(n) for n, c in last.items()])


@query
def null_parameter_files(s: SparkSession, d: str) -> DataFrame:
    """Null parameters written for each nation at one or another cap; the exact one is found, else the first."""
    out = folder(s, "null")
    for r in A.table(s, d, "nation").toLocalIterator():
        for cap in (30, 50) if r.n_nationkey % 2 else (30,):
            place = workspace.Experiment(f"n{r.n_nationkey}", Path(out)).null_json(1.0, cap)
            workspace.write_null_parameters({"df": r.n_nationkey + 1, "loc": 0.5, "scale": cap}, place)
    return workspace.null_parameters(workspace.read_null_tables(s, [f"{out}/metadata"]), 1.0, 50)


@query
def event_log(s: SparkSession, d: str) -> DataFrame:
    path = f"{folder(s, 'log')}/events.json"
    log = EventLog(path)
    for r in A.table(s, d, "nation").orderBy("n_nationkey").toLocalIterator():
        try:
            with log.action("region", key=r.n_regionkey), log.action("nation", key=r.n_nationkey):
                log.message("note", key=r.n_nationkey)
                if r.n_nationkey % 5 == 0:
                    raise ValueError("five")
        except ValueError:
            pass
    got = s.read.schema("message_type string, status string, level int, key int, reason string").json(path)
    return got.groupBy("message_type", "status", "level").agg(F.count("*").alias("n"), F.count("reason").alias("n_reasons"))


def _exported(s: SparkSession, d: str) -> str:
    """Scores of the chains as so many models, exported."""
    out = folder(s, "results")
    scores = _diagnosed(s, d).withColumns({"stem": F.col("chain"), "atom": F.concat(F.lit("C"), (F.col("atom_id") % 8).cast("string")), "radius": F.lit(1.25), "n_grid_points": F.col("atom_id") % 7})
    residues = aggregates.residue_scores(scores, by=["stem"], flags=True)
    bonded = spatial.bonds(A.atoms(s, d, BOND_SCALE).withColumn("stem", F.col("chain")), by=["stem"])
    summary = aggregates.summary(scores, ["stem"]).join(aggregates.opia(scores, bonded, 0.5, ["stem"]), "stem").withColumn("threshold", F.when(F.col("stem") == "A", 0.75))
    models = _model_atoms(s, d).withColumn("stem", F.col("chain"))
    folders = s.createDataFrame([(c, f"{out}/{c}") for c in "ABC"], "stem string, folder string")
    api.export({"atoms": scores, "residues": residues, "summary": summary}, folders, models, out)
    return out


@query
def exported_atoms(s: SparkSession, d: str) -> DataFrame:
    out = _exported(s, d)
    got = report.read_results(s, [f"{out}/{c}/{c}_atoms.csv" for c in "ABC"], report.ATOMS, "atoms")
    return got.select("stem", "resnum", "resname", "atom", "score", "score_negative", "is_water", "has_clash", "has_missing_density", "has_unaccounted_density", "radius", "n_grid_points")


@query
def exported_residues(s: SparkSession, d: str) -> DataFrame:
    out = _exported(s, d)
    got = report.read_results(s, [f"{out}/{c}/{c}_residues.csv" for c in "ABC"], report.RESIDUES, "residues")
    return rounded(got.drop("icode", "chain", "stem"), "residue_score", "median_atom_score", digits=4)


@query
def exported_summary(s: SparkSession, d: str) -> DataFrame:
    out = _exported(s, d)
    got = s.read.schema(report.SUMMARY).json([f"{out}/{c}/{c}_summary.json" for c in "ABC"])
    return rounded(got.drop("significance_alpha"), "opia", "mean_atom_score", "median_atom_score")


@query
def report_page(s: SparkSession, d: str) -> DataFrame:
    """Rows of the pages by badge: all experiments are on them."""
    out = folder(s, "page")
    o = A.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("stem"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") * 7 % 1000) / 1000.0).alias("opia"))
    n = o.count()
    report.write_html(report.screen_rank(o, n), f"{out}/index.html", n=n)
    rows = s.read.text(f"{out}/index*.html").select(F.regexp_extract("value", "<tr class='([a-z]+)'>", 1).alias("badge")).where("badge != ''")
    return rows.groupBy("badge").agg(F.count("*").alias("n"))


@query
def viewer_scripts(s: SparkSession, d: str) -> DataFrame:
    rows = []
    for r in A.table(s, d, "nation").toLocalIterator():
        text = report.viewer_script(r.n_name, f"/m/{r.n_nationkey}.pdb", ["/snr.ccp4", "/mean.ccp4"], (1.0, 2.0, r.n_nationkey / 4), 2.5 if r.n_nationkey % 2 else None, "/m.mtz")
        rows += [(r.n_nationkey, n, line) for n, line in enumerate(text.splitlines())]
    return s.createDataFrame(rows, "n_nationkey int, line int, value string")


@query
def settings_layers(s: SparkSession, d: str) -> DataFrame:
    file = yaml_blocks("output_dir: /x\ndebias:\n  omit_fraction: 0.25  # a quarter\n  seed: 3\nslurm:\n  chunk_size: 7\n")
    run = layered(Run(debias=Debias(iterations=2)), file, {"debias": {"seed": 9}})
    return s.createDataFrame([(run.output_dir, run.debias.omit_fraction, run.debias.iterations, run.debias.seed, run.slurm.chunk_size, run.debias.omit_type)], "output_dir string, omit_fraction double, iterations int, seed int, chunk_size int, omit_type string")


MODEL = (("N", 2.0, 3.0, 4.0), ("CA", 5.0, 5.0, 5.0), ("O", 9.5, 10.5, 0.4))


def _screen(s: SparkSession) -> str:
    """Two experiments: one of four maps and three atoms, one without maps."""
    out = folder(s, "screen")
    lines = [f"ATOM  {n:5d}  {a:<3} SER A{n // 3 + 1:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00 20.00           {a[0]}" for n, (a, x, y, z) in enumerate(MODEL, 1)]
    for stem in ("x1", "x2"):
        e = workspace.Experiment(stem, Path(out) / stem)
        for path in (f"{e.root}/{stem}.pdb", f"{e.root}/processed/{stem}_updated.pdb"):
            files.put(path, "\n".join(lines).encode())
        files.put(str(e.omission_json), b'{"A|1|SER|N|": [0, 2], "A|1|SER|CA|": [1], "A|2|SER|O|": []}')
    columns = [("H", "H"), ("K", "H"), ("L", "H"), ("FWT", "F"), ("PHWT", "P")]
    for m in range(4):
        table = [(h, k, l, (10 + (7 * h + 5 * k + 3 * l) % 11) * (1 + m * m / 8), (40 * h + 70 * k + 110 * l) % 360) for h, k, l in HKL]
        files.put(f"{out}/x1/results/x1_{m}/x1_{m}.mtz", maps.format_mtz(columns, np.array(table), MTZ_CELL))
    return out


@query
def stage_quantify(s: SparkSession, d: str) -> DataFrame:
    """The whole stage from MTZ files to CCP4 maps."""
    out = _screen(s)
    done = api.run_quantification(s, out, n_maps=4, n_null=200)
    found = [r.path for r in done.where("error is null").toLocalIterator()]
    parts = [maps.read_ccp4(s, [p.replace("_snr", f"_{name}") for p in found]).select("i", "j", "k", F.col("value").cast("double").alias(name)) for name in ("mean", "std")]
    failed = done.where("error is not null").select("stem")
    both = rounded(parts[0].join(parts[1], ["i", "j", "k"]), "mean", "std")  # files hold single precision
    return rounded(both, "mean", "std", digits=2).unionByName(failed.select(*[F.lit(-1).alias(g) for g in "ijk"], *[F.lit(0.0).alias(n) for n in ("mean", "std")]))


@query
def stage_analyse(s: SparkSession, d: str) -> DataFrame:
    """Quantified, analysed and reported: what the exported files and the report tell."""
    out = _screen(s)
    api.run_quantification(s, out, n_maps=4, n_null=200)
    done = api.run_analysis(s, out, n_maps=4, alpha=0.1)
    told = s.read.schema(report.SUMMARY).json(f"{out}/x1/analyse_results/x1_summary.json")
    told = told.select("stem", "n_atoms", "n_residues", "significance_alpha", (F.col("significance_snr_threshold") > 0).alias("limited"))
    shown = s.read.text(f"{out}/index.html").where("value like '<tr class%'").select(F.regexp_extract("value", ">(x[0-9])<", 1).alias("stem")).distinct()
    stem = F.regexp_extract(files.local_path(F.col("_metadata.file_path")), "([^/]*)_scored[.]pdb$", 1)
    lines = s.read.text(f"{out}/x1/analyse_results").where("value like 'ATOM%'").groupBy(stem.alias("stem")).agg(F.count("*").alias("n_lines"))
    got = done.select("stem", F.col("error").isNull().alias("done")).join(told, "stem", "left").join(shown.withColumn("shown", F.lit(True)), "stem", "left")
    return got.join(lines, "stem", "left")


# Operators whose branches had no query


@query
def owner_resolution_residues(s: SparkSession, d: str) -> DataFrame:
    a = A.atoms(s, d, BOND_SCALE).withColumn("icode", F.when(F.col("atom_id") % 8 > 5, "B").otherwise(""))
    keys = a.where("resnum % 3 < 2").select(F.concat_ws("|", "chain", "resnum", "resname").alias("key")).distinct()
    return omission.resolve_owners(keys, a, "amino_acids").select("owner", "atom_id", "element")


@query
def trilinear_values(s: SparkSession, d: str) -> DataFrame:
    """Points between the nodes of a small map, at fractions 1/4, 1/2 and 1/5 of its steps."""
    e = A.table(s, d, "embeddings").select(F.col("vec_id").alias("atom_id"), *[F.floor(F.element_at("embedding", i + 1).cast("double") * 100.0).cast("long").alias(u) for i, u in enumerate("uvw")])
    return rounded(spatial.with_values(e, A.grid(s), A.DIMS, (4, 2, 5)), "value", digits=6)


def _both() -> Column:
    return F.explode(F.array(F.lit("c0"), F.lit("c1"))).alias("stem")


def _sample_points(s: SparkSession, d: str) -> DataFrame:
    """Points of two crystals, by turns."""
    return A.table(s, d, "embeddings").select(F.concat(F.lit("c"), (F.col("vec_id") % 2).cast("string")).alias("stem"), F.col("vec_id").alias("id"), *[(F.floor(F.element_at("embedding", i + 4).cast("double") * 256.0) / 256.0).alias(c) for i, c in enumerate(ensemble.FRACTIONS)])


@query
def null_sampling(s: SparkSession, d: str) -> DataFrame:
    grid = A.grid(s).select("*", _both())
    crystals = api.crystal_table(s, [api.crystal_row(c, CELL, A.DIMS, 2.0) for c in ("c0", "c1")])
    got = ensemble.null_samples(_sample_points(s, d), grid, crystals)
    return rounded(got.select("id", (F.col("snr") + 1e-9).alias("snr")), "snr", digits=6)  # off the ties that such fractions make


@query
def solvent_points(s: SparkSession, d: str) -> DataFrame:
    """Points that no image of the model reaches, in a cell of two symmetric copies."""
    cell = Cell(30.0, 40.0, 50.0)
    crystals = api.crystal_table(s, [api.crystal_row(c, cell, (10, 10, 10), 2.0, 4, ["X,Y,Z", "-X,Y+1/2,-Z"]) for c in ("c0", "c1")])
    atoms = A.atoms(s, d, SCORE_SCALE).select(_both(), "x", "y", "z", (F.lit(1.0) + F.col("label") / 10.0).alias("vdw"))
    return ensemble.outside_model(_sample_points(s, d), atoms, crystals).select("id")


@query
def normal_points(s: SparkSession, d: str) -> DataFrame:
    """Moments of the seeded coordinates, to a tenth."""
    crystals = A.table(s, d, "nation").select(F.col("n_name").alias("stem"))
    got = ensemble.null_points(crystals, 2000, 3)
    return got.groupBy("stem").agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in ensemble.FRACTIONS for name, f in (("mean", lambda c: F.abs(F.avg(c)) < 0.12), ("std", lambda c: F.abs(F.stddev(c) - 1) < 0.12))])


def _waters(s: SparkSession, d: str, cfg: Scoring, level: tuple[float, float]) -> DataFrame:
    a, grid = _scored_inputs(s, d)
    got = scoring.water_scores(a.where("is_water"), grid, level, CELL, A.DIMS, cfg)
    return rounded(got, "score").select("atom_id", "score", "n_grid_points")


@query
def water_score_normalised(s: SparkSession, d: str) -> DataFrame:
    return _waters(s, d, Scoring(normalization=MapNormalization(normalize=True)), (2.0, 0.5))


@query
def water_score_positive(s: SparkSession, d: str) -> DataFrame:
    return _waters(s, d, Scoring(water=WaterScoring(sigma_threshold=0.0)), (2.0, 0.5))


@query
def t_fit_known(s: SparkSession, d: str) -> DataFrame:
    """Parameters found again from the quantiles of a known distribution, and the usual ones of no sample."""
    p = (F.col("id") + 0.5) / 4000.0
    root = F.sqrt(p * (1 - p) * 4.0)  # of four degrees of freedom the quantile has a closed form
    t = F.signum(p - 0.5) * F.sqrt(F.cos(F.acos(root) / 3.0) / root - 1) * 2.0
    sample = s.range(4000).select(F.lit("known").alias("name"), (t * 2.0 + 0.5).alias("snr"))
    got = student_t.fit_groups(sample, ["name"])
    none = s.createDataFrame([("none", *student_t.fit(np.zeros(0)))], "name string, df double, loc double, scale double")
    return got.unionByName(none).select("name", (F.round("df") + 0.0).alias("df"), *[(F.round(c, 1) + 0.0).alias(c) for c in ("loc", "scale")])


@query
def sampler_iterations(s: SparkSession, d: str) -> DataFrame:
    rows = []
    for percent in range(-10, 120):
        try:
            omission.validate_sampling(percent / 100, None)
            rows.append((percent, True, omission.default_iterations(None, percent / 100)))
        except ValueError:
            rows.append((percent, False, None))
    return s.createDataFrame(rows, "percent int, valid boolean, iterations int")


@query
def sampled_coverage(s: SparkSession, d: str) -> DataFrame:
    """How often each part is left out: the ones named in every map, the others once an iteration."""
    keys = A.table(s, d, "customer").select(F.col("c_nationkey").alias("stem"), F.concat(F.lit("A|"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("ordinal"))
    got = omission.sample_crystals(keys, ["A|5", "A|9", "A|0"], 0.25, 2, 11)
    n = got.groupBy("stem").agg((F.max("map_id") + 1).alias("n_maps"))
    return got.groupBy("stem", "key").agg(F.count_distinct("map_id").alias("times")).join(n, "stem").select("stem", "key", (F.col("times") == F.when(F.col("key").isin("A|5", "A|9", "A|0"), F.col("n_maps")).otherwise(F.lit(2))).alias("as_told"))


@query
def selection_union(s: SparkSession, d: str) -> DataFrame:
    """Distinct parts left out of any map, with those always left out."""
    chunks = omission.sample_batches(_customers(s, d).where("crystal < 5"), 0.3, 2, _order(), ["crystal"]).select("crystal", "key")
    fixed = _customers(s, d).where("crystal >= 3 and crystal < 7")
    selections = chunks.withColumn("map_id", F.lit(0)).unionByName(fixed.withColumn("map_id", F.lit(1)))
    return omission.omission_map(selections.select("crystal", "key").distinct(), selections, ["crystal"]).select("crystal", "key", F.size("map_ids").cast("long").alias("n"))


@query
def neighbour_list(s: SparkSession, d: str) -> DataFrame:
    """Residues around the ligand in order of chain and number."""
    near = report.neighbour_lists(report.ligand_neighbours(A.atoms(s, d, BOND_SCALE), 4.0))
    return near.select(F.posexplode("neighbours").alias("place", "n")).select("place", "n.category", "n.chain", "n.resnum", "n.resname")


@query
def quantify_two_crystals(s: SparkSession, d: str) -> DataFrame:
    """Two crystals of unlike cells, grids and resolutions in one plan."""
    crystals = api.crystal_table(s, [api.crystal_row("a", Cell(12.0, 10.0, 8.0), (6, 5, 4), 2.2), api.crystal_row("b", Cell(8.0, 8.0, 8.0), (5, 5, 5), 1.2)])
    nodes = api.voxel_positions(crystals).select("stem", "i", "j", "k", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("map_id"))
    ens = nodes.withColumn("value", ((7 * F.col("i") + 13 * F.col("j") + 17 * F.col("k") + 29 * F.col("map_id")) % 101) / 20.0)
    atoms = A.atoms(s, d, 10).withColumns({"stem": F.when(F.col("resnum") % 2 == 0, "a").otherwise("b"), "atom": F.col("element")})
    keys = atoms.select("stem", "resnum", F.concat_ws("|", "chain", "resnum", "resname").alias("key")).distinct()
    ids = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda m: (F.col("resnum") + 3 * m) % 5 == 0)
    got = api.quantify_crystals(ens, crystals, keys.select("stem", "key", ids.alias("map_ids")), atoms, 1.0, 5)
    return rounded(got, "mean", "std", "snr")


@query
def radius_literals(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([(e, r) for e in ("H", "c", " N", "SE", "Zz", "CA") for r in (0.2, 1.0, 1.4, 2.6, 9.0)], "element string, resolution double")
    out = rows.select("element", "resolution", radii.radius_step(F.col("element"), F.col("resolution")).alias("radius"), radii.covalent_radius(F.col("element")).alias("covalent"), radii.van_der_waals(F.col("element")).alias("vdw"))
    return out


@query
def name_literals(s: SparkSession, d: str) -> DataFrame:
    names = ("ALA", "mse", "HOH", "dod", "LIG", "SEC", "SO4", "PYL", "WAT")
    rows = s.createDataFrame([(n,) for n in names], "resname string").select("resname", report.category(F.col("resname")).alias("category"))
    columns = s.createDataFrame([("1", x) for x in ("IMEAN", "SIGIMEAN", "FP", "SIGFP", "Status")] + [("2", x) for x in ("F", "FREE")], "crystal string, label string")
    found = workspace.first_label(columns, workspace.AMPLITUDES, workspace.FREE_SETS).select(F.col("crystal").alias("resname"), F.concat_ws("/", F.coalesce("f_label", F.lit("-")), "rfree_label").alias("category"))
    return rows.unionByName(found)
