"""A query for every operator on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densika.config import MapNormalization, Scoring, WaterScoring
from densika.functions import curves, radii, student_t
from densika.functions.cell import Cell
from densika.operators import aggregates, ensemble, jobs, omission, report, scoring, spatial
from densika.plans import analogues as A
from densika.sources import screening, workspace

BOND_SCALE, SCORE_SCALE = 40, 100
#: The largest covalent radius among the analogue's elements.
BOND_REACH = max(radii.COVALENT.get(e.strip().upper(), radii.UNKNOWN_COVALENT) for e in A.ELEMENTS)
CELL = Cell(*[n * A.SPACING for n in A.DIMS])
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Doubles to so many decimals; adding 0 turns -0.0 into 0.0."""
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


# Ensembles


@query
def ensemble_snr(s: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.stats(ensemble.packed(A.ensemble(s, d), ["voxel"], A.N_MAPS), ["voxel"]), "mean", "std", "snr")


@query
def ensemble_zero_fill(s: SparkSession, d: str) -> DataFrame:
    v = ensemble.packed(A.ensemble(s, d), ["voxel"], A.N_MAPS)
    return rounded(v.select("voxel", F.posexplode("vals").alias("map_id", "value")), "value", digits=8)


@query
def ensemble_map_cap(s: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.stats(ensemble.packed(A.ensemble(s, d), ["voxel"], 1), ["voxel"]), "mean", "snr", digits=8).select("voxel", "mean", "snr")


@query
def ensemble_skip_missing(s: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.stats(ensemble.packed(A.ensemble(s, d), ["voxel"], A.N_MAPS, "skip"), ["voxel"]), "mean", "std", "snr")


@query
def bias_per_owner(s: SparkSession, d: str) -> DataFrame:
    v = ensemble.packed(A.ensemble(s, d), ["voxel"], A.N_MAPS)
    return rounded(ensemble.bias_table(ensemble.with_omissions(v, A.owners(s, d), A.omission(s, d), ["voxel"], A.N_MAPS), ["voxel"]), "bias")


@query
def bias_solve(s: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.quantify(A.ensemble(s, d), A.owners(s, d), A.omission(s, d), ["voxel"], A.N_MAPS), "mean", "std", "snr")


@query
def bias_solve_skip(s: SparkSession, d: str) -> DataFrame:
    """Maps that a voxel lacks don't count, whatever is omitted from the others."""
    return rounded(ensemble.quantify(A.ensemble(s, d), A.owners(s, d), A.omission(s, d), ["voxel"], A.N_MAPS, "skip"), "mean", "std", "snr")


@query
def bias_solve_50_maps(s: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.quantify(A.many_maps(s, d), A.many_owners(s, d), A.omission(s, d, 50), ["voxel"], 50), "mean", "std", "snr")


@query
def map_stats(s: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.map_statistics(A.ensemble(s, d), ["map_id"]), "mean", "sigma")


# Omission


def _suppliers(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "supplier").select(F.col("s_suppkey").alias("n"), curves.id_key(F.lit("A"), F.floor(F.col("s_suppkey") / 3), F.lit("SER"), F.col("s_suppkey") % 3).alias("key"), F.col("s_nationkey").alias("crystal"))


def _omission_maps(s: SparkSession, d: str) -> DataFrame:
    """Schedules by residue in even crystals, by atom in odd ones."""
    keys = _suppliers(s, d)
    seed = F.when(F.col("crystal") % 2 == 0, F.floor(F.col("n") / 3)).otherwise(F.col("n"))
    chosen = keys.withColumn("map_id", F.explode(F.sequence(F.lit(0), F.lit(A.N_MAPS - 1)))).where((seed + 3 * F.col("map_id")) % 11 < 2)
    return omission.omission_map(keys, chosen.select("crystal", "key", "map_id"), ["crystal"])


@query
def omission_sparse_map(s: SparkSession, d: str) -> DataFrame:
    return _omission_maps(s, d).select("crystal", "key", F.array_join(F.transform("map_ids", lambda m: m.cast("string")), ",").alias("maps"))


@query
def omission_incidence(s: SparkSession, d: str) -> DataFrame:
    return omission.omission_incidence(_omission_maps(s, d), ["crystal"])


@query
def omission_mode(s: SparkSession, d: str) -> DataFrame:
    return omission.infer_mode(_omission_maps(s, d), ["crystal"])


def _customers(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "customer").select(F.col("c_nationkey").alias("crystal"), F.col("c_custkey").alias("key"))


def _order() -> list[Column]:
    return [(F.col("key") * 7919 + F.col("iteration") * 104729) % 10007, F.col("key")]


@query
def sample_chunks(s: SparkSession, d: str) -> DataFrame:
    return omission.sample_batches(_customers(s, d), 0.3, 2, _order(), ["crystal"])


@query
def sample_complement(s: SparkSession, d: str) -> DataFrame:
    return omission.sample_batches(_customers(s, d), 0.7, 2, _order(), ["crystal"])


@query
def always_omit_split(s: SparkSession, d: str) -> DataFrame:
    items = _suppliers(s, d).select("key")
    chosen = _suppliers(s, d).where("n % 7 = 0 or n < 3").select(F.when(F.col("n") < 3, F.concat("key", F.lit("|x"))).otherwise(F.col("key")).alias("selector"))
    always, rest = omission.split_always(items, chosen)
    return always.withColumn("part", F.lit("always")).unionByName(rest.withColumn("part", F.lit("remaining")))


@query
def polymer_ids(s: SparkSession, d: str) -> DataFrame:
    a = A.atoms(s, d, BOND_SCALE).withColumn("record", F.when(F.col("resname").isin("HOH", "LIG"), "HETATM").otherwise("ATOM")).withColumn("serial", F.col("atom_id"))
    return omission.polymer_ids(a, "amino_acids")


@query
def owner_resolution(s: SparkSession, d: str) -> DataFrame:
    a = A.atoms(s, d, BOND_SCALE).withColumn("atom", F.concat("element", F.col("atom_id") % 4))
    keys = a.where("atom_id % 5 < 2").select(curves.id_key(F.col("chain"), F.col("resnum"), F.col("resname"), F.col("atom"), F.lit("\x00")).alias("key")).distinct()
    return omission.resolve_owners(keys, a, "atoms").select(F.regexp_replace("owner", "\\x00", "").alias("owner"), "atom_id")


# Curves and lookups


@query
def radius_step(s: SparkSession, d: str) -> DataFrame:
    v = A.atoms(s, d, 1)
    return v.select("atom_id", radii.radius_step(F.col("element"), (F.col("atom_id") % 40) / 10.0).alias("radius"))


@query
def radius_interp(s: SparkSession, d: str) -> DataFrame:
    v = A.atoms(s, d, 1).withColumn("charge", (F.col("atom_id") % 3).cast("int"))
    return rounded(radii.with_radius_interp(v, radii.default_table(s), (F.col("atom_id") % 40) / 10.0).select("atom_id", "radius"), "radius")


@query
def weight_parabola(s: SparkSession, d: str) -> DataFrame:
    v = A.atoms(s, d, 1)
    return rounded(v.select("atom_id", curves.parabola_weight((F.col("atom_id") % 80) / 20.0, F.col("label") / 5.0).alias("weight")), "weight")


@query
def weight_gaussian(s: SparkSession, d: str) -> DataFrame:
    v = A.atoms(s, d, 1)
    return rounded(v.select("atom_id", curves.gaussian_weight((F.col("atom_id") % 80) / 40.0).alias("weight")), "weight")


@query
def density_clip(s: SparkSession, d: str) -> DataFrame:
    v, cfg = A.atoms(s, d, 10), Scoring(normalization=MapNormalization(normalize=True))
    return rounded(v.select("atom_id", curves.density_score(F.col("x"), F.lit(0.1), F.lit(0.5), cfg.density, cfg.normalization).alias("z")), "z")


@query
def grid_oversampling(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "part").select("p_partkey", curves.oversampling(F.col("p_size") / 10.0).alias("factor"))


@query
def id_keys(s: SparkSession, d: str) -> DataFrame:
    k = _suppliers(s, d)
    return k.select("n", "key", curves.key_part(F.col("key"), 1).cast("int").alias("resnum"), curves.key_part(F.col("key"), 3).alias("atom"))


@query
def param_tokens(s: SparkSession, d: str) -> DataFrame:
    words = A.table(s, d, "customer").select("c_custkey", F.explode(F.array(F.col("c_custkey").cast("string"), F.format_string("%.2f", "c_acctbal"), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, "None").when(F.col("c_custkey") % 3 == 1, "TRUE").otherwise("false"))).alias("token"))
    return words.select("c_custkey", "token", curves.token_kind(F.col("token")).alias("kind"))


@query
def badge_bucket(s: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 100) / 100.0)
    return A.table(s, d, "orders").select("o_orderkey", curves.badge(v, *report.OPIA_BADGE).alias("badge"))


@query
def score_colours(s: SparkSession, d: str) -> DataFrame:
    v = A.atoms(s, d, 1)
    score = (F.col("atom_id") % 29) / 20.0 - 0.1
    return v.select("atom_id", curves.colour(score).alias("score"), curves.colour((F.col("atom_id") % 11) / 10.0, curves.P_VALUE_COLOURS).alias("p_value"))


# Space


def _with_radius(a: DataFrame, resolution: float = 2.0) -> DataFrame:
    return a.withColumn("radius", radii.radius_step(F.col("element"), F.lit(resolution)))


MAX_RADIUS = max(r[3] for r in radii.STEP_RADII.values())


@query
def voxel_owner_join(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "embeddings")
    voxels = e.select(F.col("vec_id").alias("voxel"), *[(F.element_at("embedding", i + 4).cast("double") * F.lit(40.0)).alias(c) for i, c in enumerate("xyz")])
    owned = A.atoms(s, d, BOND_SCALE).select((F.floor(F.col("atom_id") / 8)).alias("owner"), "x", "y", "z", (F.lit(2.0) + F.col("label") / 10.0).alias("radius"))
    return spatial.voxel_owners(voxels, owned, 2.9)


@query
def neighbour_pairs(s: SparkSession, d: str) -> DataFrame:
    a = _with_radius(A.atoms(s, d, BOND_SCALE)).select("atom_id", "x", "y", "z", "radius")
    near = spatial.neighbours(a, MAX_RADIUS)
    return rounded(near.groupBy(F.col("a_atom_id").alias("atom_id")).agg(F.count("*").alias("n"), F.min(curves.distance(spatial.xyz("a_"), spatial.xyz("b_"))).alias("nearest")), "nearest")


@query
def bond_edges(s: SparkSession, d: str) -> DataFrame:
    return spatial.bonds(A.atoms(s, d, BOND_SCALE), max_covalent=BOND_REACH)


@query
def clash_flags(s: SparkSession, d: str) -> DataFrame:
    return spatial.clashes(_with_radius(A.atoms(s, d, BOND_SCALE)), MAX_RADIUS)


@query
def clash_flags_unbonded(s: SparkSession, d: str) -> DataFrame:
    a = _with_radius(A.atoms(s, d, BOND_SCALE))
    return spatial.clashes(a, MAX_RADIUS, tolerance=0.4)


@query
def sphere_points(s: SparkSession, d: str) -> DataFrame:
    a = _with_radius(A.atoms(s, d, SCORE_SCALE)).select("atom_id", "x", "y", "z", (F.col("radius") * 2.0).alias("sphere"))
    p = spatial.with_values(spatial.sphere_points(a, CELL, A.DIMS), A.grid(s), A.DIMS)
    return rounded(p.groupBy("atom_id").agg(F.count("*").alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"), F.sum("w").alias("sw"), F.sum("value").alias("total")), "total")


# Scores


def _scored_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _with_radius(scoring.registry(A.atoms(s, d, SCORE_SCALE))), A.grid(s)


@query
def ownership_share(s: SparkSession, d: str) -> DataFrame:
    placed = scoring.places(_scored_inputs(s, d)[0])
    met = spatial.sphere_blocks(scoring.sites(placed), CELL, A.DIMS)
    shared = scoring.ownership(spatial.block_points(met, CELL, A.DIMS).select(*spatial.BLOCK, *scoring.POINT), met)
    sums = shared.groupBy("site").agg(F.count("*").alias("n"), F.sum("share").alias("share"))
    return rounded(scoring.of_atoms(sums, placed), "share")


def _protein_scores(s: SparkSession, d: str) -> DataFrame:
    a, grid = _scored_inputs(s, d)
    return scoring.protein_scores(a, grid, (0.0, 1.0), CELL, A.DIMS)


@query
def atom_score(s: SparkSession, d: str) -> DataFrame:
    return rounded(_protein_scores(s, d), "score", "score_positive", "score_negative")


@query
def water_score(s: SparkSession, d: str) -> DataFrame:
    a, grid = _scored_inputs(s, d)
    got = scoring.water_scores(a.where("is_water"), grid, (2.0, 0.5), CELL, A.DIMS, Scoring(water=WaterScoring()))
    return rounded(got, "score").select("atom_id", "score", "n_grid_points")


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Plain scores by arithmetic, for what builds on them."""
    a = A.atoms(s, d, BOND_SCALE)
    score = (F.col("atom_id") * 37 % 101) / 100.0
    return a.select(
        *aggregates.RESIDUE, "atom_id", "element", score.alias("score"), score.alias("score_positive"), (-(F.col("atom_id") * 11 % 50) / 100.0).alias("score_negative"), F.upper("resname").isin(*scoring.WATERS).alias("is_water")
    )


def _diagnosed(s: SparkSession, d: str) -> DataFrame:
    return aggregates.diagnosed(_scores(s, d), clash_flags(s, d))


@query
def residue_power_mean(s: SparkSession, d: str) -> DataFrame:
    got = aggregates.residue_scores(_diagnosed(s, d), flags=True)
    return rounded(got, "residue_score", "median_atom_score")


@query
def residue_profile(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.residue_profile(aggregates.residue_scores(_scores(s, d)), "residue_score", "A"), "value")


@query
def opia(s: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.opia_at(_scores(s, d), A.atoms(s, d, BOND_SCALE), 0.5, max_covalent=BOND_REACH), "opia")


@query
def flag_counts(s: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.summary(_diagnosed(s, d)), "mean_atom_score", "median_atom_score")


@query
def water_rank(s: SparkSession, d: str) -> DataFrame:
    return report.ranked_waters(_scores(s, d), 0.24)


@query
def water_counts(s: SparkSession, d: str) -> DataFrame:
    return report.ranked_waters(_scores(s, d), 0.24).agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_removed"))


# Ligands and reports


@query
def lig_neighbourhood(s: SparkSession, d: str) -> DataFrame:
    return report.ligand_neighbours(A.atoms(s, d, BOND_SCALE), 4.0)


@query
def lig_counts(s: SparkSession, d: str) -> DataFrame:
    return report.neighbour_counts(report.ligand_neighbours(A.atoms(s, d, BOND_SCALE), 4.0))


@query
def lig_centroid(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.ligand_centroid(A.atoms(s, d, BOND_SCALE)), "cx", "cy", "cz", digits=3)


@query
def lig_extract(s: SparkSession, d: str) -> DataFrame:
    got = report.ligand_scores(aggregates.residue_scores(_scores(s, d)), _scores(s, d))
    return rounded(got.select("residue_score", F.size("atoms").cast("long").alias("n_atoms"), F.aggregate("atoms", F.lit(0.0), lambda a, x: a + x["score"]).alias("total")), "residue_score", "total")


def _results(s: SparkSession, d: str) -> DataFrame:
    o = A.table(s, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("stem"), F.when(F.col("o_orderkey") % 11 != 0, F.round((F.col("o_orderkey") * 7 % 1000) / 1000.0, 3)).alias("opia"))


@query
def screen_rank(s: SparkSession, d: str) -> DataFrame:
    return report.screen_rank(_results(s, d))


@query
def screen_summary(s: SparkSession, d: str) -> DataFrame:
    return report.screen_summary(_results(s, d))


@query
def experiment_assembly(s: SparkSession, d: str) -> DataFrame:
    docs = A.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("stem"), "source")
    raw = A.table(s, d, "labels").select(F.col("doc_id").cast("string").alias("stem"), F.when(F.col("toxic") == 1, "n/a").otherwise(F.col("quality").cast("string")).alias("opia"), F.lit("12").alias("n_atoms"))
    return report.assembled(docs, report.typed_summaries(raw))


@query
def experiment_json(s: SparkSession, d: str) -> DataFrame:
    return report.experiment_json(_results(s, d).withColumn("opia", F.when(F.col("opia").isNotNull(), F.format_string("%.3f", "opia"))))


# Screening, jobs and files


def _screening(s: SparkSession, d: str) -> DataFrame:
    o = A.table(s, d, "orders")
    n = F.col("o_orderkey")

    def path(skip: int, name: str) -> Column:
        return F.when(n % skip != 0, F.concat(F.lit(f"/data/{name}/x"), n.cast("string"), F.lit(".pdb")))

    return o.select(n.alias("row"), F.when(n % 13 != 0, F.concat(F.lit("x"), n.cast("string"))).alias("CrystalName"), F.when(n % 7 != 0, F.col("o_orderpriority")).alias("RefinementOutcome"), path(3, "ref").alias("RefinementPDB_latest"), path(5, "mtz").alias("RefinementMTZ_latest"), path(2, "dim").alias("DimplePathToPDB"), path(4, "dmz").alias("DimplePathToMTZ"))


@query
def screening_best_pairs(s: SparkSession, d: str) -> DataFrame:
    return screening.best_pairs(_screening(s, d))


@query
def outcome_filter(s: SparkSession, d: str) -> DataFrame:
    return screening.with_outcome(_screening(s, d), "URGENT, HIGH").select("row", "RefinementOutcome")


@query
def screening_cap(s: SparkSession, d: str) -> DataFrame:
    return screening.best_pairs(_screening(s, d), cap=100, order="row")


@query
def screening_csv(s: SparkSession, d: str) -> DataFrame:
    p = A.table(s, d, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias(" Model "), F.col("url").alias("SF"))
    return screening.screening_pairs(p)


@query
def label_priority(s: SparkSession, d: str) -> DataFrame:
    lines = A.table(s, d, "lineitem")
    names = [x for pair in workspace.AMPLITUDES for x in pair] + workspace.FREE_SETS
    rows = lines.select(F.col("l_orderkey").alias("crystal"), F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") * 5 % len(names) + 1).cast("int")).alias("label"))
    return workspace.first_label(rows.unionByName(rows.select("crystal", F.lit("SIGF").alias("label"))), workspace.AMPLITUDES, workspace.FREE_SETS)


def _listing(s: SparkSession, d: str) -> DataFrame:
    lines = A.table(s, d, "lineitem")
    return lines.select(F.col("l_orderkey").cast("string").alias("stem"), F.concat(F.lit("/r/"), F.col("l_orderkey").cast("string"), F.lit("_k_"), F.when(F.col("l_partkey") % 3 == 0, "1.5").otherwise("1.0"), F.lit("_cap_"), F.element_at(F.array(*[F.lit(c) for c in ("10", "30", "50", "100")]), (F.col("l_suppkey") % 4 + 1).cast("int")), F.lit("_snr.ccp4")).alias("path")).distinct()


@query
def map_resolver(s: SparkSession, d: str) -> DataFrame:
    return workspace.chosen_maps(_listing(s, d), 1.5, None)


@query
def null_param_lookup(s: SparkSession, d: str) -> DataFrame:
    rows = _listing(s, d).withColumn("k", F.regexp_extract("path", r"k_([0-9.]+)_", 1).cast("double")).withColumn("cap", F.regexp_extract("path", r"cap_([0-9]+)", 1).cast("int"))
    rows = rows.select("stem", "path", "k", "cap", (F.col("cap") + 1.0).alias("df"), F.lit(0.0).alias("loc"), F.col("k").alias("scale"))
    return workspace.null_parameters(rows, 1.0, 50)


@query
def job_chunks(s: SparkSession, d: str) -> DataFrame:
    return jobs.chunked(A.table(s, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("job")), 4, ["job"], ["customer"])


@query
def job_fan_out(s: SparkSession, d: str) -> DataFrame:
    return jobs.fan_out(A.table(s, d, "customer").select("c_custkey"), (F.col("c_custkey") % 4 + 1).cast("int"))


@query
def job_pending(s: SparkSession, d: str) -> DataFrame:
    done = A.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return jobs.pending(A.table(s, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query
def manifest_lines(s: SparkSession, d: str) -> DataFrame:
    pairs = screening.best_pairs(_screening(s, d))
    return jobs.manifest_lines(pairs.select("id", F.col("pdb").alias("model"), F.col("mtz").alias("reflections")))


@query
def selection_text(s: SparkSession, d: str) -> DataFrame:
    return jobs.selection_text(_suppliers(s, d).select("crystal", "key"), ["crystal"])


@query
def common_prefix(s: SparkSession, d: str) -> DataFrame:
    return workspace.common_prefix(_screening(s, d).where("RefinementPDB_latest is not null").select(F.col("RefinementPDB_latest").alias("path")))


@query
def map_files(s: SparkSession, d: str) -> DataFrame:
    got = workspace.maps_by_suffix(_listing(s, d).withColumn("path", F.when(F.col("path").contains("cap_50"), F.regexp_replace("path", "_snr", "_mean")).otherwise(F.col("path"))), "snr")
    return got.select("stem", F.array_join("paths", ",").alias("paths"))


@query
def manifest_reflections(s: SparkSession, d: str) -> DataFrame:
    o = _screening(s, d)
    stems = o.select(F.concat(F.lit("x"), F.col("row").cast("string")).alias("stem"))
    manifest = o.where("RefinementPDB_latest is not null").select(F.col("RefinementPDB_latest").alias("model"), F.col("RefinementMTZ_latest").alias("reflections"))
    parsed = o.where("row % 2 = 0").select(F.concat(F.lit("x"), F.col("row").cast("string")).alias("stem"), F.col("DimplePathToMTZ").alias("value"))
    return workspace.original_reflections(stems, manifest, parsed)


@query
def scored_model(s: SparkSession, d: str) -> DataFrame:
    """Model lines with scores as B factors; atoms without score have 0."""
    from densika.sources import structures

    a = A.atoms(s, d, BOND_SCALE).select(
        "atom_id", F.lit("ATOM").alias("record"), F.col("atom_id").alias("serial"), F.concat(F.lit("C"), (F.col("atom_id") % 8).cast("string")).alias("atom"), "altloc", "resname", "chain", "resnum", "icode",
        *[F.floor(c).cast("double").alias(c) for c in "xyz"], F.lit(1.0).alias("occupancy"), F.lit("C").alias("element"),
    )
    scores = a.where("atom_id % 3 = 0").select("chain", "resnum", "icode", "atom", ((F.col("atom_id") * 37 % 101) / 100.0).alias("score"))
    return structures.scored_lines(a, scores)


# Statistics


@query
def t_sf(s: SparkSession, d: str) -> DataFrame:
    v = A.atoms(s, d, 10)
    return rounded(v.select("atom_id", student_t.survival_column(F.col("x"), 2.0, 0.1, 0.5).alias("p_value")), "p_value")


@query
def t_sf_by_group(s: SparkSession, d: str) -> DataFrame:
    v = A.atoms(s, d, 10).select("atom_id", "chain", F.col("x").alias("snr"))
    params = s.createDataFrame([("A", 1.0, 0.0, 1.0), ("B", 2.0, 0.1, 0.5)], "chain string, df double, loc double, scale double")
    return rounded(student_t.p_values(v, params, ["chain"]).select("atom_id", F.nanvl("p_value", F.lit(None).cast("double")).alias("p_value")), "p_value")


@query
def t_threshold(s: SparkSession, d: str) -> DataFrame:
    rows = [(i, student_t.quantile(1 - i / 100, 2.0, 1.0, 2.0)) for i in range(1, 50)]
    return rounded(s.createDataFrame(rows, "percent int, threshold double"), "threshold")


@query
def t_fit(s: SparkSession, d: str) -> DataFrame:
    v = A.atoms(s, d, 10).select("chain", F.col("x").alias("snr"))
    return rounded(student_t.fit_groups(v, ["chain"]), "df", "loc", "scale", digits=3)


def queries() -> dict[str, Query]:
    from densika.plans import file_queries, given_queries  # noqa: F401  add their own

    return dict(QUERIES)
