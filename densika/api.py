"""The three stages and the report on crystals, each a chain of DataFrames."""

from __future__ import annotations

import logging
import os
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from densika.config import Run, Scoring, snr_map_config, validated
from densika.functions import curves, radii, student_t
from densika.functions.cell import LATTICE, Cell, CellOf, apply, lattice
from densika.operators import aggregates, ensemble, jobs, omission, report, scoring, spatial
from densika.sources import files, maps, parameters, screening, structures, workspace
from densika.sources.events import EventLog

log = logging.getLogger(__name__)
VOXELS_A_FILE = 4_000_000


def discover(spark: SparkSession, run: Run) -> DataFrame:
    """``(id, pdb, mtz)`` of a screening table, or of the one given crystal."""
    d = validated(run).debias
    if not d.screening_path:
        return spark.createDataFrame([(Path(d.structure_path).stem, d.structure_path, d.reflections_path)], "id string, pdb string, mtz string")
    if d.screening_path.endswith(".csv"):
        return screening.from_csv(spark, d.screening_path)
    if d.screening_path.endswith(".sqlite"):
        return screening.from_sqlite(spark, d.screening_path, d.screening_outcomes, d.max_structures)
    raise ValueError("a screening table must be .csv or .sqlite")


Outcome = tuple[str, str | None, str | None]


@contextmanager
def logged(root: str | Path, stage: str, **told: object) -> Iterator[Callable[[list[Outcome]], None]]:
    """An action in ``logs/<stage>.json`` under ``root``; the function it gives adds a line for each outcome."""
    events = EventLog(Path(root) / "logs" / f"{stage}.json")

    def outcomes(rows: list[Outcome]) -> None:
        for stem, path, error in rows:
            events.message(f"{stage}:{'failed' if error else 'done'}", stem=stem, path=path, reason=error)

    with events.action(f"{stage}:run", **told):
        yield outcomes


def isolated(batch: list, work: Callable[[list], list[Outcome]], name: Callable) -> list[Outcome]:
    """``work`` on the whole batch at once; if that fails, on its halves, until the faulty crystal stands alone."""
    if not batch:
        return []
    try:
        return work(batch)
    except Exception as fault:
        if len(batch) == 1:
            log.warning("%s failed: %s", name(batch[0]), fault)
            return [(name(batch[0]), None, str(fault).splitlines()[0])]
    half = len(batch) // 2
    return isolated(batch[:half], work, name) + isolated(batch[half:], work, name)


def debias(spark: SparkSession, run: Run, template: str | dict = parameters.MAP_TEMPLATE) -> DataFrame:
    """Omissions, parameter files, manifests and scripts of all crystals not done yet; the crystals' table.

    All are worked on together; one that fails is reported in ``error`` and doesn't stop the others.
    """
    out = Path(run.output_dir)
    done = workspace.listing(spark, out).where(F.col("below").rlike("^[^/]+/results/")).select(F.substring_index("below", "/", 1).alias("id")).distinct()
    todo = jobs.pending(discover(spark, run), done, ["id"], run.force)
    crystals = [(r.id, r.pdb, r.mtz) for r in todo.orderBy("id").toLocalIterator()]  # a row a crystal, as in the manifest
    blocked = {s: fault for s, fault in workspace.layout(out, [c[0] for c in crystals]) if fault}
    with logged(out, "debias", fraction=run.debias.omit_fraction, iterations=run.debias.iterations, seed=run.debias.seed) as outcomes:
        rows = isolated([c for c in crystals if c[0] not in blocked], lambda batch: _debias_batch(spark, run, batch, template), lambda c: c[0])
        outcomes(rows + [(s, None, fault) for s, fault in blocked.items()])
    made = {s: error for s, _, error in rows} | blocked
    good = [c for c in crystals if made[c[0]] is None]
    (out / "jobs").mkdir(parents=True, exist_ok=True)
    lines = jobs.manifest_lines(spark.createDataFrame(good, "id string, model string, reflections string"))
    (out / "manifest.txt").write_text("".join(f"{r.value}\n" for r in lines.orderBy("value").toLocalIterator()), encoding="utf-8")
    named = workspace.listing(spark, out).select("below", F.regexp_extract("below", r"^([^/]+)/params/(.*)_([0-9]+)[.]params$", 1).alias("stem"), F.regexp_extract("below", r"_([0-9]+)[.]params$", 1).cast("int").alias("n"))
    named = named.where((F.col("stem") != "") & (F.col("below") == F.concat("stem", F.lit("/params/"), "stem", F.lit("_"), "n", F.lit(".params"))))
    written = named.join(spark.createDataFrame([(i, c[0]) for i, c in enumerate(good)], "turn int, stem string"), "stem").orderBy("turn", "n")
    manifest = [str(out / r.below) for r in written.toLocalIterator()]  # a row a job, as in the manifest
    size, scripts = run.slurm.chunk_size, []
    for n in range(0, len(manifest), size):
        part = manifest[n : n + size]
        target = out / "jobs" / f"maps_{n // size}"
        target.with_suffix(".txt").write_text("\n".join(part) + "\n", encoding="utf-8")
        target.with_suffix(".sh").write_text(jobs.array_script(run.slurm, len(part), "compute-map", str(target.with_suffix(".txt"))), encoding="utf-8")
        scripts.append(str(target.with_suffix(".sh")))
    if scripts:
        (out / "jobs" / "submit.sh").write_text(jobs.chain_script(scripts), encoding="utf-8")
    return spark.createDataFrame([(*c, made[c[0]]) for c in crystals], "id string, pdb string, mtz string, error string")


def detected_labels(spark: SparkSession, run: Run, crystals: DataFrame) -> DataFrame:
    """``(stem, f_label, rfree_label, error)``: the settings' labels, and those of the reflections for what they leave open."""
    given = F.lit(run.debias.mtz_f_labels or None).cast("string"), F.lit(run.debias.mtz_rfree_label or None).cast("string")
    if run.debias.mtz_f_labels and run.debias.mtz_rfree_label:
        return crystals.select("stem", given[0].alias("f_label"), given[1].alias("rfree_label"), F.lit(None).cast("string").alias("error"))
    paths = [r.mtz for r in crystals.select("mtz").distinct().toLocalIterator()]
    columns = maps.read_mtz_columns(spark, paths).select(files.local_path(F.col("crystal")).alias("crystal"), "label")
    found = workspace.first_label(columns, workspace.AMPLITUDES, workspace.FREE_SETS)
    both = crystals.join(found, crystals["mtz"] == found["crystal"], "left")
    f, free = F.coalesce(given[0], "f_label"), F.coalesce(given[1], "rfree_label")
    return both.select("stem", f.alias("f_label"), free.alias("rfree_label"), F.when(f.isNull() | free.isNull(), F.coalesce("error", F.lit("no labels found"))).alias("error"))


def _debias_batch(spark: SparkSession, run: Run, batch: list[tuple], template: str | dict) -> list[Outcome]:
    d, out = run.debias, os.path.abspath(run.output_dir)
    crystals = spark.createDataFrame([(s, os.path.abspath(p), os.path.abspath(m), os.path.splitext(p)[1].lower()) for s, p, m in batch], "stem string, pdb string, mtz string, extension string")
    labels = detected_labels(spark, run, crystals)
    faults = {r.stem: r.error for r in labels.where("error is not null").toLocalIterator()}
    good = [c for c in batch if c[0] not in faults]
    if good:
        keys = omission.polymer_ids(structures.read_structures(spark, {s: p for s, p, _ in good}), d.omit_type, ["stem"])
        chosen = omission.sample_crystals(keys, omission.parse_selectors(d.always_omit), d.omit_fraction, d.iterations, d.seed)
        held = omission.omission_map(chosen.select("stem", "key").distinct(), chosen, ["stem"])
        place = F.concat(F.lit(f"{out}/"), "stem", F.lit("/metadata/"), "stem", F.lit("_omission_map.json"))
        files.write_groups(held.select(place.alias("path"), "key", "map_ids"), workspace.omission_bytes, out)
        told = jobs.selection_text(chosen, ["stem", "map_id"]).join(crystals, "stem").join(labels.drop("error"), "stem").withColumn("run", F.concat_ws("_", "stem", "map_id"))
        told = told.withColumn("path", F.concat(F.lit(f"{out}/"), "stem", F.lit("/params/"), "run", F.lit(".params")))
        files.write_groups(told, lambda pdf: _map_parameters(pdf.iloc[0].to_dict(), out, d.simulated_annealing, template), out)
        for s, p, _ in good:
            folder = f"{out}/{s}/processed"
            for name, values in parameters.preparation_jobs(folder, s, os.path.splitext(p)[1].lower()).items():
                parameters.save(values, f"{folder}/{name}")
    return [(c[0], f"{out}/{c[0]}/params", faults.get(c[0])) for c in batch]


def _map_parameters(r: dict, out: str, anneal: bool, template: str | dict) -> bytes:
    model, result = f"{out}/{r['stem']}/processed/{r['stem']}_updated{r['extension']}", f"{out}/{r['stem']}/results/{r['run']}/{r['run']}.mtz"
    job = parameters.map_job(model, r["mtz"], r["f_label"], r["rfree_label"], result, r["run"], r["selection"], anneal, template)
    return (parameters.written(job) + "\n").encode()


def crystal_table(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """One row a crystal: ``stem``, its cell and grid, and what stages need of its first map."""
    images = "images array<struct<r:array<double>,t:array<double>>>"
    return spark.createDataFrame(rows, f"stem string, {LATTICE}, cell array<double>, resolution double, spacegroup int, {images}")


def crystal_row(stem: str, cell: Cell, dims: tuple[int, ...], resolution: float, spacegroup: int = 1, operators: Iterable[str] = ()) -> tuple:
    images = [maps.operator(o) for o in operators or ["X,Y,Z"]]
    sides = [cell.a, cell.b, cell.c, cell.alpha, cell.beta, cell.gamma]
    return stem, *lattice(cell, dims), [float(x) for x in sides], float(resolution), int(spacegroup), [(r.ravel().tolist(), t.tolist()) for r, t in images]


def voxel_positions(crystals: DataFrame) -> DataFrame:
    """``(stem, voxel, i, j, k, x, y, z)`` of all nodes of each crystal's grid."""
    out = crystals.select("stem", "orth", "dims")
    for a, g in enumerate("ijk"):
        out = out.withColumn(g, F.explode(F.sequence(F.lit(0), F.get("dims", F.lit(a)) - 1)))
    n = [F.get("dims", F.lit(a)) for a in range(3)]
    at = apply(CellOf().orthogonal(), tuple(F.col(g) / k for g, k in zip("ijk", n, strict=True)))
    voxel = (F.col("i").cast("long") * n[1] + F.col("j")) * n[2] + F.col("k")
    return out.select("stem", voxel.alias("voxel"), "i", "j", "k", *[c.alias(x) for x, c in zip("xyz", at, strict=True)])


def quantify_crystals(maps_: DataFrame, crystals: DataFrame, omissions: DataFrame | None, atoms: DataFrame | None, k: float = 1.0, n_maps: int = 50) -> DataFrame:
    """``(stem, i, j, k, mean, std, snr)`` of the ensembles ``(stem, map_id, i, j, k, value)`` of all crystals in one plan, or packed ones ``(stem, i, j, k, vals)``.

    ``omissions`` are ``(stem, key, map_ids)``; ``k`` 0 skips the bias.
    """
    keys = ["stem", "i", "j", "k"]
    if k == 0 or omissions is None or atoms is None:
        return ensemble.quantify(maps_, None, None, keys, n_maps)
    modes = omissions.select("stem").distinct().join(omission.infer_mode(omissions, ["stem"]), "stem", "left")
    chosen = omissions.join(modes.withColumn("mode", F.coalesce("mode", F.lit("amino_acids"))), "stem")
    parts = [omission.resolve_owners(chosen.where(F.col("mode") == m), atoms, m, ["stem"]) for m in ("atoms", "amino_acids")]
    sized = parts[0].unionByName(parts[1]).join(crystals.select("stem", "resolution"), "stem")
    owned = sized.withColumn("radius", radii.radius_step(F.col("element"), F.col("resolution")) * k)
    most = max(r for row in radii.STEP_RADII.values() for r in row) * k
    voxels = voxel_positions(crystals)
    unique = F.concat_ws("/", "stem", "owner").alias("owner")  # keys of one crystal are none of another's
    owners = spatial.voxel_owners(voxels, owned, most, ["stem"]).join(voxels.select("stem", "voxel", "i", "j", "k"), ["stem", "voxel"]).select(*keys, unique)
    schedule = omission.omission_incidence(omissions, ["stem"]).select(unique, "map_id")
    return ensemble.quantify(maps_, owners, schedule, keys, n_maps)


def quantify(spark: SparkSession, maps_: DataFrame, cell: Cell, dims: tuple[int, int, int], resolution: float, omissions: DataFrame | None = None, atoms: DataFrame | None = None, k: float = 1.0, n_maps: int = 50) -> DataFrame:
    """``(i, j, k, mean, std, snr)`` of one crystal's ensemble ``(i, j, k, map_id, value)``."""
    ensemble.require_first_map(maps_)
    crystals = crystal_table(spark, [crystal_row("", cell, dims, resolution)])

    def named(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.withColumn("stem", F.lit(""))

    return quantify_crystals(named(maps_), crystals, named(omissions), named(atoms), k, n_maps).drop("stem")


def null_fits(snr: DataFrame, crystals: DataFrame, atoms: DataFrame, n: int = 20_000, seed: int = 0) -> DataFrame:
    """``(stem, df, loc, scale)`` of the noise in each crystal's bulk solvent; waters are no part of the model."""
    model = atoms.where(~F.upper("resname").isin(*scoring.WATERS)).select("stem", "x", "y", "z", radii.van_der_waals(F.col("element")).alias("vdw"))
    points = ensemble.bulk_solvent(ensemble.null_points(crystals, n, seed), model, crystals)
    samples = ensemble.null_samples(points, snr.select("stem", "i", "j", "k", F.col("snr").alias("value")), crystals)
    fitted = student_t.fit_groups(samples, ["stem"])
    usual = zip(("df", "loc", "scale"), student_t.fit([]), strict=True)
    return crystals.select("stem").join(fitted, "stem", "left").na.fill(dict(usual))


def significance_threshold(params: dict[str, float], alpha: float = 0.05) -> float:
    return student_t.quantile(1 - alpha, params["df"], params["loc"], params["scale"])


@contextmanager
def held_tables(spark: SparkSession, root: str | Path) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that stores a table under ``root`` and reads it from there, until the end."""
    scratch = f"{os.path.abspath(root)}/_held-{uuid.uuid4().hex}"

    def hold(df: DataFrame) -> DataFrame:
        place = f"{scratch}/{uuid.uuid4().hex}"
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    try:
        yield hold
    finally:
        shutil.rmtree(scratch, ignore_errors=True)


def score_models(grid: DataFrame, atoms: DataFrame, crystals: DataFrame, cfg: Scoring | None = None, table: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """``atoms``, ``residues`` and ``summary`` of all models ``stem`` against their maps ``(stem, i, j, k, value)``.

    ``hold`` may store tables that several others are made of, so that they are worked out once.  A crystal's ``threshold``, where it has one, takes the place of both the support and the missing-density thresholds.
    """
    cfg, by = cfg or snr_map_config(), ["stem"]
    own = cfg.aggregation
    level = ensemble.map_statistics(grid, by, cfg.normalization.mean, cfg.normalization.sigma).withColumnRenamed("mean", "level").withColumnRenamed("sigma", "spread")
    more = hold(crystals if "threshold" in crystals.columns else crystals.withColumn("threshold", F.lit(None).cast("double")))
    factors = F.transform(F.arrays_zip("edges", "dims"), lambda x: curves.oversampling(x["edges"] / x["dims"], cfg.max_spacing))
    told = hold(more.select("stem", "edges", "orth", "frac", "dims", "resolution", "threshold", factors.alias("factors")).join(level, "stem"))
    registered = scoring.registry(atoms).join(told, "stem")
    held = hold(radii.with_radius_interp(registered, table or radii.default_table(atoms.sparkSession), F.col("resolution")))
    most = held.agg(F.max("radius")).first()[0] or 2.0
    carry = ["edges", "orth", "frac", "dims", "factors", "level", "spread"]
    dims, fine = (tuple(F.get(c, F.lit(i)) for i in range(3)) for c in ("dims", "factors"))
    grid = grid.join(more.select("stem", "dims"), "stem")
    stats = F.col("level"), F.col("spread")
    bonded = spatial.bonds(atoms, cfg.bond_tolerance, spatial.largest_covalent(atoms), by)
    proteins = scoring.protein_scores(held, grid, stats, CellOf(), dims, cfg, by, fine, carry)
    waters = scoring.water_scores(held.where("is_water"), grid, stats, CellOf(), dims, cfg, by, fine, carry)
    scores = held.drop(*carry).join(proteins.unionByName(waters), ["stem", "atom_id"])
    support, missing = (F.coalesce(F.col("threshold"), F.lit(x)) for x in (own.opia_threshold, own.missing_density_threshold))
    scores = hold(aggregates.diagnosed(scores, spatial.clashes(held, most, own.clash_threshold, by), replace(own, missing_density_threshold=missing), by))
    residues = aggregates.residue_scores(scores, own, by, flags=True)
    summary = aggregates.summary(scores, by).join(aggregates.opia(scores, bonded, support, by), by)
    summary = summary.join(told.select("stem", F.col("level").alias("global_mean"), F.col("spread").alias("global_sigma"), "threshold"), by)
    return {"atoms": scores, "residues": hold(residues), "summary": hold(summary)}


def score_model(spark: SparkSession, grid: DataFrame, atoms: DataFrame, cell: Cell, dims: tuple[int, int, int], resolution: float, cfg: Scoring | None = None, table: DataFrame | None = None, threshold: float | None = None) -> dict[str, DataFrame]:
    """``score_models`` of one model against a map ``(i, j, k, value)``."""
    one = crystal_table(spark, [crystal_row("", cell, dims, resolution)]).withColumn("threshold", F.lit(threshold).cast("double"))
    found = score_models(grid.withColumn("stem", F.lit("")), atoms.withColumn("stem", F.lit("")), one, cfg, table)
    return {name: df.drop("stem") for name, df in found.items()}


#: Columns of the exported tables, with the decimals of numbers.
ATOM_COLUMNS = {
    "chain": None, "resname": None, "resnum": None, "icode": None, "atom": None, "element": None, "score": 6, "score_positive": 6, "score_negative": 6, "is_water": None,
    "has_clash": None, "has_missing_density": None, "has_unaccounted_density": None, "radius": 4, "n_grid_points": None,
}
RESIDUE_COLUMNS = {
    "chain": None, "resname": None, "resnum": None, "icode": None, "residue_score": 6, "min_atom_score": 6, "median_atom_score": 6, "max_atom_score": 6,
    "n_atoms": None, "n_clashes": None, "n_missing_density": None, "n_unaccounted_density": None,
}


def export(result: dict[str, DataFrame], folders: DataFrame, models: DataFrame, root: str) -> None:
    """Files of each crystal in its folder ``(stem, folder)`` under ``root``: atoms and residues as CSV, the summary as JSON, the scored model.

    The summary comes last and tells that the others are there.
    """
    place = F.concat("folder", F.lit("/"), "stem")
    atoms, header = files.csv_lines(result["atoms"].join(folders, "stem"), ATOM_COLUMNS)
    files.write_lines(atoms.select(F.concat(place, F.lit("_atoms.csv")).alias("path"), F.col("atom_id").alias("turn"), "value"), root, header)
    order = F.struct("chain", "resnum", "icode", "resname")
    turn = F.row_number().over(Window.partitionBy("stem").orderBy(order))
    residues, header = files.csv_lines(result["residues"].join(folders, "stem"), RESIDUE_COLUMNS)
    files.write_lines(residues.select(F.concat(place, F.lit("_residues.csv")).alias("path"), turn.alias("turn"), "value"), root, header)
    scored = structures.scored_lines(models, result["atoms"].select("stem", "chain", "resnum", "icode", "atom", "score"), by=["stem"])
    files.write_lines(scored.join(folders, "stem").select(F.concat(place, F.lit("_scored.pdb")).alias("path"), F.col("atom_id").alias("turn"), "value"), root)
    plots(result, folders, root)
    named = result["summary"].withColumnRenamed("threshold", "significance_snr_threshold").join(folders, "stem")
    told = F.to_json(F.struct(*[c for c in named.columns if c != "folder"]), {"ignoreNullFields": "false"})
    files.write_lines(named.select(F.concat(place, F.lit("_summary.json")).alias("path"), F.lit(0).alias("turn"), told.alias("value")), root)


def plots(result: dict[str, DataFrame], folders: DataFrame, root: str, usual: float = Scoring().aggregation.opia_threshold) -> None:
    """Each crystal's residue profile and, if it has any, its waters by support, as SVG in its folder.

    Waters are measured by the crystal's threshold, without one by ``usual``.
    """
    place = F.concat("folder", F.lit("/"), "stem")

    def profile(pdf: pd.DataFrame) -> bytes:
        ordered = pdf.sort_values(["chain", "resnum", "icode"])["residue_score"].tolist()
        return report.profile_svg(list(enumerate(ordered, 1)), f"Residues of {pdf['stem'].iloc[0]}").encode()

    residues = result["residues"].join(folders, "stem").select(F.concat(place, F.lit("_profile.svg")).alias("path"), "stem", "chain", "resnum", "icode", "residue_score")
    files.write_groups(residues.where("residue_score is not null"), profile, root)

    def waters(pdf: pd.DataFrame) -> bytes:
        rows = list(zip(pdf["rank"].tolist(), pdf["score"].tolist(), pdf["kept"].tolist(), strict=True))
        return report.waters_svg(rows, float(pdf["least"].iloc[0]), f"Waters of {pdf['stem'].iloc[0]}").encode()

    least = F.coalesce(F.col("threshold"), F.lit(usual))
    ranked = report.ranked_waters(result["atoms"], usual, ["stem"]).join(result["summary"].select("stem", least.alias("least")), "stem").join(folders, "stem")
    ranked = ranked.select(F.concat(place, F.lit("_waters.svg")).alias("path"), "stem", "rank", "score", "least", (F.col("score") >= F.col("least")).alias("kept"))
    files.write_groups(ranked, waters, root)


def first_maps(spark: SparkSession, found: list[workspace.Experiment], cap: int) -> tuple[list[tuple], list[Outcome]]:
    """Rows of the crystals' table from the headers of their maps, and crystals that have no map or unlike ones."""
    listed = {e.stem: e.map_files(cap) for e in found}
    faults = [(s, None, f"no first map of {s}") for s, m in listed.items() if 0 not in m]
    paths = [str(p) for s, m in listed.items() if 0 in m for p in m.values()]
    if not paths:
        return [], faults
    heads = maps.read_mtz_headers(spark, paths).select("*", *workspace.map_name(F.col("path")))
    odd = F.max(F.when(F.col("error").isNotNull(), F.col("error")))
    unlike = F.when(F.count_distinct("dims") > 1, F.lit("maps of different grids"))
    first = F.max_by(F.struct("edges", "orth", "frac", "dims", "cell", "resolution", "spacegroup", "operators"), -F.col("map_id"))
    rows = []
    for r in heads.groupBy("stem").agg(F.coalesce(odd, unlike).alias("fault"), first.alias("first")).toLocalIterator():  # a row a crystal
        if r.fault:
            faults.append((r.stem, None, r.fault))
        else:
            rows.append(crystal_row(r.stem, Cell(*r.first.cell), r.first.dims, r.first.resolution, r.first.spacegroup, r.first.operators))
    return rows, faults


def unreadable(spark: SparkSession, found: list[workspace.Experiment]) -> dict[str, str]:
    """Faults of models and omission files, by stem: found before the plan that all crystals share, which they don't enter."""
    if not found:
        return {}
    out = {}
    for models in ({e.stem: str(e.processed) for e in found}, {e.stem: str(e.original) for e in found if e.original}):
        out |= {r.stem: r.error for r in (structures.model_faults(spark, models).toLocalIterator() if models else ())}  # a row a faulty crystal
    held = workspace.omission_faults(spark, [str(e.omission_json) for e in found])
    stem = F.regexp_extract(files.local_path(F.col("path")), "([^/]*)_omission_map[.]json$", 1)
    return out | {r.stem: r.error for r in held.select(stem.alias("stem"), "error").toLocalIterator()}


@files.few_listing_tasks
def run_quantification(spark: SparkSession, root: str, k: float = 1.0, n_maps: int | None = 50, force: bool = False, n_null: int = 20_000, seed: int = 0) -> DataFrame:
    """Signal, noise, their ratio and p-values of all experiments under ``root``; ``(stem, path, error)``.

    Crystals have cells, grids and resolutions of their own and are worked on together.  Each gets its maps in
    ``quantify_results/k_<k>_cap_<cap>``, the ratio last, which marks it as done, and its null parameters in
    ``metadata``; all voxels also make a table under ``root``.  ``n_maps`` None takes all maps there are.
    """
    found = workspace.experiments(spark, root)
    if not found:
        raise ValueError(f"no experiment at {root}")
    rows, todo = [], {}
    for e in found:
        cap = len(e.map_files(None)) if n_maps is None else n_maps
        target = e.quantify_dir / f"k_{k}_cap_{cap}" / f"{e.stem}_snr.ccp4"
        if e.has(target.relative_to(e.root).as_posix()) and not force:
            rows.append((e.stem, str(target), None))
        else:
            todo.setdefault(cap, []).append(e)
    with logged(root, "quantify", k_factor=k, map_cap=n_maps) as outcomes:
        for cap, some in todo.items():
            new = isolated(some, lambda batch, cap=cap: _quantify_batch(spark, root, batch, k, cap, n_null, seed), lambda e: e.stem)
            outcomes(new)
            rows += new
    return spark.createDataFrame(rows, "stem string, path string, error string")


def _quantify_batch(spark: SparkSession, root: str, batch: list[workspace.Experiment], k: float, cap: int, n_null: int, seed: int) -> list[Outcome]:
    heads, faults = first_maps(spark, batch, cap)
    known = {h[0] for h in heads}
    bad = unreadable(spark, [e for e in batch if e.stem in known])
    faults += [(s, None, fault) for s, fault in bad.items()]
    heads = [h for h in heads if h[0] not in bad]
    good = [e for e in batch if e.stem in known - bad.keys()]
    if not good:
        return faults
    crystals = crystal_table(spark, heads)
    voxels = maps.read_mtz_ensembles(spark, [str(p) for e in good for p in e.map_files(cap).values()], cap)
    models = structures.read_structures(spark, {e.stem: str(e.processed) for e in good})
    held = workspace.read_omissions(spark, [str(e.omission_json) for e in good])
    held = held.select(F.regexp_extract(files.local_path(F.col("path")), "([^/]*)_omission_map[.]json$", 1).alias("stem"), "key", "map_ids")
    table = f"{root}/quantify_table/k_{k}_cap_{cap}"
    # A crystal's voxels make as many files as its grid is large, however many tasks there are.
    parts = F.ceil(F.aggregate("dims", F.lit(1).cast("long"), lambda a, n: a * n) / VOXELS_A_FILE)
    dealt = quantify_crystals(voxels, crystals, held, models, k, cap).join(crystals.select("stem", parts.alias("parts")), "stem")
    dealt = dealt.repartition("stem", F.pmod(F.xxhash64("i", "j", "k"), F.col("parts"))).drop("parts")
    dealt.write.partitionBy("stem").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table)
    snr = spark.read.schema("i int, j int, k int, mean double, std double, snr double, stem string").parquet(table).join(crystals.select("stem"), "stem", "left_semi")
    originals = structures.read_structures(spark, {e.stem: str(e.original or e.processed) for e in good})
    params = {r.stem: r for r in null_fits(snr, crystals, originals, n_null, seed).toLocalIterator()}  # a row a crystal
    for e in good:
        workspace.write_null_parameters(params[e.stem].asDict(), e.null_json(k, cap))
    fitted = spark.createDataFrame([(s, p["df"], p["loc"], p["scale"]) for s, p in params.items()], "stem string, df double, loc double, scale double")
    full = student_t.p_values(snr, fitted, ["stem"])
    folders = spark.createDataFrame([(e.stem, str(e.quantify_dir / f"k_{k}_cap_{cap}")) for e in good], "stem string, folder string")
    placed = crystals.join(folders, "stem")
    for names in (["mean", "std", "p_value"], ["snr"]):
        maps.write_ccp4_maps(full, placed, names, os.path.abspath(root))
    return faults + [(e.stem, str(e.quantify_dir / f"k_{k}_cap_{cap}" / f"{e.stem}_snr.ccp4"), None) for e in good]


@files.few_listing_tasks
def run_analysis(spark: SparkSession, root: str, k: float = 1.0, n_maps: int | None = 50, alpha: float = 0.05, map_path: str | None = None, model_path: str | None = None, cfg: Scoring | None = None, ligand: str = "LIG", reach: float = 10.0, table: DataFrame | None = None) -> DataFrame:
    """Scores of all experiments in ``analyse_results`` of each, then the report; ``(stem, path, error)``.

    The null parameters of a crystal's quantification set its thresholds by ``alpha``; without any the usual
    ones hold.  A map or model that is given takes the place of those found, as for a single experiment.
    """
    found = workspace.experiments(spark, root)
    if not found:
        raise ValueError(f"no experiment at {root}")
    listing = [(e.stem, str(p)) for e in found for p in e.matching(f"quantify_results/k_*_cap_*/{e.stem}_snr.ccp4")]
    chosen = workspace.chosen_maps(spark.createDataFrame(listing, "stem string, path string"), k, n_maps)
    named = {r.stem: r.path for r in chosen.toLocalIterator()}  # a row a crystal
    todo, rows = [], []
    for e in found:
        grid, model = map_path or named.get(e.stem), model_path or e.original
        lacking = [str(what) for what, there in (("map", grid and Path(grid).exists()), ("model", model and Path(model).exists()), ("first map", e.map_files(None))) if not there]
        if lacking:
            rows.append((e.stem, None, f"no {', '.join(lacking)} found for {e.stem}"))
        else:
            todo.append((e, str(grid), str(model)))
    with logged(root, "analyse", k_factor=k, map_cap=n_maps, significance_alpha=alpha) as outcomes:
        rows += isolated(todo, lambda batch: _analyse_batch(spark, root, batch, k, n_maps or 50, alpha, cfg, table), lambda x: x[0].stem)
        outcomes(rows)
    out = spark.createDataFrame(rows, "stem string, path string, error string")
    screen_report(spark, root, {r[0]: r[2] for r in rows if r[2]}, ligand, reach)
    return out


def _analyse_batch(spark: SparkSession, root: str, batch: list[tuple[workspace.Experiment, str, str]], k: float, cap: int, alpha: float, cfg: Scoring | None, table: DataFrame | None) -> list[Outcome]:
    listed = spark.createDataFrame([(e.stem, grid) for e, grid, _ in batch], "stem string, file string")

    def with_stem(df: DataFrame) -> DataFrame:
        return df.join(listed, "file").drop("file", "path")

    grids, file = sorted({grid for _, grid, _ in batch}), files.local_path(F.col("path"))
    heads = with_stem(maps.read_ccp4_headers(spark, grids).withColumn("file", file)).where("error is null").drop("error")
    fine = maps.read_mtz_headers(spark, [str(p) for e, *_ in batch for p in e.map_files(None).values()]).select("resolution", *workspace.map_name(F.col("path")))
    fine = fine.where("resolution is not null").groupBy("stem").agg(F.min_by("resolution", "map_id").alias("resolution"))
    stored = [str(p) for e, *_ in batch for p in e.matching(f"metadata/{e.stem}_null_params_k*_cap*.json")]
    none = spark.createDataFrame([], "stem string, df double, loc double, scale double, exact boolean")
    params = workspace.null_parameters(workspace.read_null_tables(spark, stored), k, cap) if stored else none
    limit = F.pandas_udf(lambda df, loc, scale: pd.Series([student_t.quantile(1 - alpha, *x) for x in zip(df, loc, scale, strict=True)]), "double")
    params = params.select("stem", limit("df", "loc", "scale").alias("threshold"))
    crystals = heads.join(fine, "stem").join(params, "stem", "left")
    grid = with_stem(maps.read_ccp4(spark, grids, {"file": file})).where(~F.isnan("value")).withColumn("value", F.col("value").cast("double"))
    with held_tables(spark, root) as hold:
        models = hold(structures.read_structures(spark, {e.stem: model for e, _, model in batch}))
        result = score_models(grid, models, crystals, cfg, table, hold)
        result["summary"] = result["summary"].withColumn("significance_alpha", F.lit(alpha))
        folders = {e.stem: str(e.root / "analyse_results") for e, *_ in batch}
        export(result, spark.createDataFrame(list(folders.items()), "stem string, folder string"), models, os.path.abspath(root))
    told = workspace.listing(spark, root).where(F.col("below").rlike("analyse_results/[^/]*_summary[.]json$"))
    there = {r.stem for r in told.select(F.regexp_extract("below", "([^/]*)_summary[.]json$", 1).alias("stem")).toLocalIterator()}  # a row a crystal
    return [(s, f"{f}/{s}_summary.json", None) if s in there else (s, None, f"no result of {s}: unreadable map or reflections") for s, f in folders.items()]


def screen_report(spark: SparkSession, root: str, errors: dict[str, str] | None = None, ligand: str = "LIG", reach: float = 10.0) -> DataFrame:
    """All experiments under ``root``, ranked, as ``index.html``, with more pages beside it if there are many, and JSON in its ``metadata``; scripts for a viewer beside them.

    An experiment without analysis has nulls, and the reason in ``error``.
    """
    found = workspace.experiments(spark, root)
    out = Path(root)

    def made(e: workspace.Experiment, name: str) -> str | None:
        return os.path.abspath(e.root / name) if e.has(name) else None

    rows = []
    for e in found:
        own = [made(e, f"analyse_results/{e.stem}_{name}") for name in ("scored.pdb", "profile.svg", "waters.svg")]
        rows.append((e.stem, str(e.original) if e.original else None, (errors or {}).get(e.stem), os.path.abspath(e.root), *own))
    experiments = spark.createDataFrame(rows, "stem string, model string, error string, folder string, scored string, profile string, waters string")
    results = report.collected(spark, experiments, found, ligand, reach)
    viewer = F.when(F.col("model").isNotNull() | (F.size("snr_maps") > 0) | (F.size("mean_maps") > 0), F.concat(F.lit(f"{os.path.abspath(out)}/metadata/"), "stem", F.lit("_view.py")))
    (out / "metadata").mkdir(parents=True, exist_ok=True)
    with held_tables(spark, root) as hold:
        stored = hold(results)
        ranked = hold(report.screen_rank(stored.withColumn("viewer", viewer), len(rows)))
        report.write_html(ranked, out / "index.html", n=len(rows))
        (out / "metadata" / "screen_summary.json").write_text(report.screen_summary(stored).toJSON().first(), encoding="utf-8")
        for r in report.experiment_json(ranked.drop("atoms")).toLocalIterator():
            (out / "metadata" / f"{r.stem}_screen_result.json").write_text(r.json, encoding="utf-8")
        for r in stored.select("stem", "model", "snr_maps", "mean_maps", "reflections", "cx", "cy", "cz", "significance_snr_threshold").toLocalIterator():
            centre = None if r.cx is None else (r.cx, r.cy, r.cz)
            maps_ = [*(r.snr_maps or [])[:1], *(r.mean_maps or [])[:1]]
            if r.model or maps_:
                text = report.viewer_script(r.stem, r.model or "", maps_, centre, r.significance_snr_threshold, r.reflections)
                (out / "metadata" / f"{r.stem}_view.py").write_text(text, encoding="utf-8")
    return report.screen_rank(results.withColumn("viewer", viewer), len(rows))


def stems(experiments: Iterable[workspace.Experiment]) -> list[str]:
    return [e.stem for e in experiments]
