"""SQL of ``densika.plans.file_queries``: what was written must be read again, and expected values stand as literals."""

from __future__ import annotations

from densika.plans.analogues import DIMS, atoms_sql, grid_value, step_case
from densika.plans.oracles import BOND_SCALE, POWER_MEAN, SCHEDULE, SCORE_SCALE, SCORES, SCREEN, SQL, WATER_POINTS, biases, bonded, dist, r4, solved

SQL["omission_json"] = f"WITH {SCHEDULE} SELECT CAST(crystal AS INTEGER) AS crystal, key, CAST(CASE WHEN maps = '' THEN 0 ELSE len(string_split(maps, ',')) END AS BIGINT) AS n_maps FROM sparse"

_hkl = """hkl AS (SELECT h, k, l, 10 + (7 * h + 5 * k + 3 * l) % 11 AS f, radians((40 * h + 70 * k + 110 * l) % 360) AS phi
FROM (SELECT unnest(range(0, 4)) AS h), (SELECT unnest(range(0, 4)) AS k), (SELECT unnest(range(1, 4)) AS l)),
lim AS (SELECT 1 / sqrt(max(h * h / CAST(100 AS DOUBLE) + k * k / CAST(121 AS DOUBLE) + l * l / CAST(144 AS DOUBLE))) AS d FROM hkl),
smooth AS (SELECT n FROM (SELECT unnest([2, 4, 6, 8, 10, 12, 16, 18, 20, 24, 30, 32, 36, 40]) AS n)),
dim AS (SELECT d, (SELECT min(n) FROM smooth WHERE n >= 10 * 3 / d) AS nu, (SELECT min(n) FROM smooth WHERE n >= 11 * 3 / d) AS nv, (SELECT min(n) FROM smooth WHERE n >= 12 * 3 / d) AS nw FROM lim)"""
SQL["mtz_map"] = f"""WITH {_hkl}, node AS (SELECT i, j, k AS m, nu, nv, nw FROM dim, (SELECT unnest(range(0, 40)) AS i), (SELECT unnest(range(0, 40)) AS j), (SELECT unnest(range(0, 40)) AS k) WHERE i < nu AND j < nv AND k < nw)
SELECT 'x1' AS stem, CAST(0 AS INTEGER) AS map_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(m AS INTEGER) AS k,
{r4("sum(2 * f * cos(2 * pi() * (h * i / CAST(nu AS DOUBLE) + hkl.k * j / CAST(nv AS DOUBLE) + l * m / CAST(nw AS DOUBLE)) - phi)) / 1320", 3)} AS value FROM node, hkl GROUP BY i, j, m"""
SQL["mtz_header"] = f"WITH {_hkl} SELECT {r4('d')} AS resolution, CAST(nu AS INTEGER) AS nu, CAST(nv AS INTEGER) AS nv, CAST(nw AS INTEGER) AS nw, CAST(1 AS INTEGER) AS spacegroup, CAST(12 AS DOUBLE) AS c FROM dim"
_nodes = ", ".join(f"(SELECT CAST(unnest(range(0, {n})) AS INTEGER) AS {g})" for g, n in zip("ijk", DIMS, strict=True))
SQL["ccp4_round_trip"] = f"SELECT i, j, k, {r4(grid_value('i', 'j', 'k'))} AS value FROM {_nodes}"

_model = f"{atoms_sql(BOND_SCALE)}, model AS (SELECT atom_id AS serial, CASE WHEN resname IN ('HOH', 'LIG') THEN 'HETATM' ELSE 'ATOM' END AS record, 'C' || (atom_id % 8) AS atom, resname, chain, CAST(resnum % 9000 AS INTEGER) AS resnum, {', '.join(f'{r4(c, 3)} AS {c}' for c in 'xyz')} FROM atoms)"
SQL["pdb_round_trip"] = f"WITH {_model} SELECT *, CAST(0 AS DOUBLE) AS b_iso FROM model"
SQL["mmcif_round_trip"] = f"WITH {_model} SELECT * FROM model"
SQL["screening_sqlite"] = f"WITH {SCREEN} SELECT b.id, b.pdb, b.mtz FROM best b JOIN scr USING (row) WHERE regexp_matches(outcome, 'URGENT|HIGH') ORDER BY row LIMIT 500"
SQL["screening_csv_file"] = SQL["screening_csv"]
SQL["parameter_files"] = """WITH n AS (SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, n_regionkey FROM nation)
SELECT n_nationkey, 'input.kept' AS name, '1.5' AS value, 'float' AS kind FROM n
UNION ALL SELECT n_nationkey, 'input.name', n_name, 'str' FROM n
UNION ALL SELECT n_nationkey, 'input.xray.region', CAST(n_regionkey AS VARCHAR), 'int' FROM n
UNION ALL SELECT n_nationkey, 'input.xray.flag', CASE WHEN n_nationkey % 2 = 0 THEN 'True' ELSE 'False' END, 'bool' FROM n
UNION ALL SELECT n_nationkey, 'output.title', '"the ' || n_name || ' job"', 'str' FROM n
UNION ALL SELECT n_nationkey, 'output.none', 'None', 'none' FROM n"""
SQL["map_parameters"] = """SELECT * FROM (VALUES
('map', 'input.pdb.file_name', '/m.pdb', 'str'), ('map', 'input.xray_data.file_name', '/m.mtz', 'str'), ('map', 'input.xray_data.labels', 'FP,SIGFP', 'str'),
('map', 'input.xray_data.r_free_flags.label', 'FREE', 'str'), ('map', 'output.file_name', '/r/x_0.mtz', 'str'), ('map', 'output.job_title', 'x_0', 'str'),
('map', 'omit_map.type', 'simple *refinement', 'list'), ('map', 'omit_map.boxing.selection', '"(chain A and resseq 1)"', 'str'), ('map', 'omit_map.boxing.refinement.main.simulated_annealing', 'True', 'bool'),
('pdbtools.params', 'remove', 'water', 'str'), ('pdbtools.params', 'output.prefix', '/p/x', 'str'),
('ready_set.params', 'ready_set.input.pdb_file_name', '/p/x_no_waters.pdb', 'str'), ('ready_set.params', 'ready_set.input.output_dir', '/p/', 'str'), ('ready_set.params', 'ready_set.input.cif_dir_name', '/p/', 'str'),
('ready_set.params', 'ready_set.input.cif_file_name', '/p/cif_file.cif', 'str'), ('ready_set.params', 'ready_set.input.output_file_name', '/p/x_updated', 'str'), ('ready_set.params', 'ready_set.input.ligand_cache_directory', '/p/', 'str')
) AS t(file, name, value, kind)"""
SQL["experiment_discovery"] = """SELECT 'x' || s_suppkey AS stem, 'x' || s_suppkey || CASE WHEN s_suppkey % 2 = 1 THEN '_updated.cif' ELSE '_updated.pdb' END AS processed_pdb,
CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 7 = 0 THEN 'other.pdb' ELSE 'x' || s_suppkey || '.pdb' END AS original_pdb, 'x' || s_suppkey || '_omission_map.json' AS omission_json
FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0"""
SQL["null_parameter_files"] = "SELECT 'n' || n_nationkey AS stem, n_nationkey + CAST(1 AS DOUBLE) AS df, CAST(0.5 AS DOUBLE) AS loc, CASE WHEN n_nationkey % 2 = 1 THEN CAST(50 AS DOUBLE) ELSE CAST(30 AS DOUBLE) END AS scale, n_nationkey % 2 = 1 AS exact FROM nation"
SQL["event_log"] = """WITH n AS (SELECT count(*) AS n, count(*) FILTER (n_nationkey % 5 = 0) AS five FROM nation)
SELECT kind AS message_type, status, CAST(level AS INTEGER) AS level, CASE status WHEN 'succeeded' THEN n - five WHEN 'failed' THEN five ELSE n END AS n, CASE status WHEN 'failed' THEN five ELSE 0 END AS n_reasons
FROM n, (VALUES ('region', 'started', 1), ('region', 'succeeded', 1), ('region', 'failed', 1), ('nation', 'started', 2), ('nation', 'succeeded', 2), ('nation', 'failed', 2), ('note', NULL, 2)) AS t(kind, status, level)"""

SQL["exported_atoms"] = f"""WITH {SCORES} SELECT chain AS stem, resnum, resname, 'C' || (atom_id % 8) AS atom, round(score, 6) AS score, round(score_negative, 6) AS score_negative, is_water, has_clash,
missing AS has_missing_density, extra AS has_unaccounted_density, CAST(1.25 AS DOUBLE) AS radius, atom_id % 7 AS n_grid_points FROM diag"""
SQL["exported_residues"] = f"""WITH {SCORES} SELECT resname, resnum, {r4(POWER_MEAN)} AS residue_score, min(score) AS min_atom_score, {r4('median(score)')} AS median_atom_score, max(score) AS max_atom_score, count(*) AS n_atoms,
count(*) FILTER (has_clash) AS n_clashes, count(*) FILTER (missing) AS n_missing_density, count(*) FILTER (extra) AS n_unaccounted_density FROM diag GROUP BY chain, resname, resnum"""
SQL["exported_summary"] = f"""WITH {SCORES}, {bonded(BOND_SCALE)}, good AS (SELECT atom_id, chain FROM scores WHERE score >= CAST(0.5 AS DOUBLE)),
tied AS (SELECT DISTINCT src AS atom_id FROM bonded JOIN good g ON g.atom_id = src JOIN good h ON h.atom_id = dst AND h.chain = g.chain)
SELECT chain AS stem, {r4('count(tied.atom_id) / CAST(count(*) AS DOUBLE)')} AS opia, {r4('avg(score)')} AS mean_atom_score, {r4('median(score)')} AS median_atom_score, count(*) AS n_atoms, count(DISTINCT (resname, resnum)) AS n_residues,
count(*) FILTER (has_clash) AS n_clashes, count(*) FILTER (missing) AS n_missing_density, count(*) FILTER (extra) AS n_unaccounted_density, CASE WHEN chain = 'A' THEN CAST(0.75 AS DOUBLE) END AS significance_snr_threshold
FROM diag LEFT JOIN tied USING (atom_id) GROUP BY chain"""
SQL["report_page"] = "SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderkey * 7 % 1000 >= 800 THEN 'green' WHEN o_orderkey * 7 % 1000 >= 600 THEN 'yellow' ELSE 'red' END AS badge, count(*) AS n FROM orders GROUP BY 1"
SQL["viewer_scripts"] = """WITH l AS (SELECT n_nationkey, unnest(['# ' || n_name, 'model = read_pdb("/m/' || n_nationkey || '.pdb")', 'reflections = auto_read_make_and_draw_maps("/m.mtz")',
'map_0 = handle_read_ccp4_map("/snr.ccp4", 0)', 'set_contour_level_absolute(map_0, ' || CASE WHEN n_nationkey % 2 = 1 THEN '2.5000' ELSE '1.0000' END || ')', 'map_1 = handle_read_ccp4_map("/mean.ccp4", 0)',
'set_contour_level_absolute(map_1, 1.0000)', printf('set_rotation_centre(1.000, 2.000, %.3f)', n_nationkey / CAST(4 AS DOUBLE))]) AS value, unnest(range(0, 8)) AS line FROM nation)
SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, CAST(line AS INTEGER) AS line, value FROM l"""
SQL["settings_layers"] = "SELECT '/x' AS output_dir, CAST(0.25 AS DOUBLE) AS omit_fraction, CAST(2 AS INTEGER) AS iterations, CAST(9 AS INTEGER) AS seed, CAST(7 AS INTEGER) AS chunk_size, 'atoms' AS omit_type"

# The residue of a key is that of the number that comes first, with its insertion code.
SQL["owner_resolution_residues"] = f"""WITH {atoms_sql(BOND_SCALE)} SELECT chain || '|' || resnum || '|' || resname AS owner, atom_id, element FROM atoms
WHERE resnum % 3 < 2 AND atom_id % 8 <= 5 AND upper(element) <> 'H'"""
_corner = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def interpolated(source: str, at: list[str], key: str) -> str:
    """Sum over the eight nodes around ``at`` (in steps of the map), each weighted by nearness."""
    n = DIMS[0]
    low, share = [f"floor({x})" for x in at], [f"({x} - floor({x}))" for x in at]
    terms = []
    for bits in _corner:
        node = [f"(((CAST({a} AS BIGINT) + {b}) % {n} + {n}) % {n})" for a, b in zip(low, bits, strict=True)]
        weight = " * ".join(s if b else f"(1 - {s})" for s, b in zip(share, bits, strict=True))
        terms.append(f"{weight} * {grid_value(*node)}")
    return f"SELECT {key}, {' + '.join(terms)} AS value FROM {source}"


_uvw = f"(SELECT vec_id AS atom_id, {', '.join(f'CAST(floor(CAST(embedding[{i + 1}] AS DOUBLE) * 100) AS BIGINT) AS {u}' for i, u in enumerate('uvw'))} FROM embeddings)"
SQL["trilinear_values"] = f"SELECT atom_id, u, v, w, {r4('value', 6)} AS value FROM ({interpolated(_uvw, ['u / CAST(4 AS DOUBLE)', 'v / CAST(2 AS DOUBLE)', 'w / CAST(5 AS DOUBLE)'], 'atom_id, u, v, w')})"
_points = f"(SELECT vec_id AS id, {', '.join(f'floor(CAST(embedding[{i + 4}] AS DOUBLE) * 256) / 256 AS {c}' for i, c in enumerate(('fa', 'fb', 'fc')))} FROM embeddings)"
SQL["null_sampling"] = f"SELECT id, {r4('value + CAST(1e-9 AS DOUBLE)', 6)} AS snr FROM ({interpolated(_points, [f'(f{c} * {n})' for c, n in zip('abc', DIMS, strict=True)], 'id')})"


def least_image(edge: int, a: str, b: str) -> str:
    """The distance of two fractions along an edge to the nearest image."""
    gap = f"({a} - {b} - round({a} - {b}))"
    return f"({gap} * {gap} * {edge * edge})"


_copies = ["fx", "fy", "fz"], ["(-fx)", "(fy + CAST(0.5 AS DOUBLE))", "(-fz)"]
_edges = (30, 40, 50)
_near = " OR ".join(
    f"sqrt({' + '.join(least_image(e, f'p.f{c}', f'({x})') for e, c, x in zip(_edges, 'abc', copy, strict=True))}) <= vdw + CAST(0.2 AS DOUBLE)" for copy in _copies
)
_fractions = ", ".join(f"{c} / CAST({e} AS DOUBLE) AS f{c}" for c, e in zip("xyz", _edges, strict=True))
SQL["solvent_points"] = f"""WITH {atoms_sql(SCORE_SCALE)}, m AS (SELECT {_fractions}, CAST(1 AS DOUBLE) + label / CAST(10 AS DOUBLE) AS vdw FROM atoms)
SELECT id FROM {_points} p WHERE NOT EXISTS (SELECT 1 FROM m WHERE {_near})"""
SQL["normal_points"] = "SELECT n_name AS stem, CAST(2000 AS BIGINT) AS n, true AS mean_fa, true AS std_fa, true AS mean_fb, true AS std_fb, true AS mean_fc, true AS std_fc FROM nation"


def water(part: str) -> str:
    return f"""WITH {WATER_POINTS},
sc AS (SELECT atom_id, {r4(f"CASE WHEN sum(weight) <> 0 THEN sum(weight * {part}) / sum(weight) ELSE CAST(0 AS DOUBLE) END")} AS score, count(*) AS n FROM wt GROUP BY 1)
SELECT atom_id, coalesce(score, CAST(0 AS DOUBLE)) AS score, coalesce(n, 0) AS n_grid_points FROM wa LEFT JOIN sc USING (atom_id)"""


SQL["water_score_normalised"] = water("CASE WHEN value >= CAST(2.5 AS DOUBLE) THEN (value - CAST(2 AS DOUBLE)) / CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")
SQL["water_score_positive"] = water("greatest(value, CAST(0 AS DOUBLE))")
SQL["t_fit_known"] = "SELECT * FROM (VALUES ('known', CAST(4 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(2 AS DOUBLE)), ('none', CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE))) AS t(name, df, loc, scale)"
SQL["sampler_iterations"] = """SELECT CAST(p AS INTEGER) AS percent, p > 0 AND p < 100 AS valid, CASE WHEN p > 0 AND p < 100 THEN CAST(ceil(50 / ceil(1 / least(p / CAST(100 AS DOUBLE), 1 - p / CAST(100 AS DOUBLE)))) AS INTEGER) END AS iterations
FROM (SELECT unnest(range(-10, 120)) AS p)"""
SQL["sampled_coverage"] = "SELECT c_nationkey AS stem, 'A|' || c_custkey AS key, true AS as_told FROM customer"
SQL["selection_union"] = "SELECT c_nationkey AS crystal, c_custkey AS key, CAST(CASE WHEN c_nationkey BETWEEN 3 AND 4 THEN 2 ELSE 1 END AS BIGINT) AS n FROM customer WHERE c_nationkey < 7"
SQL["neighbour_list"] = SQL["lig_neighbourhood"].replace("SELECT * FROM nb", "SELECT CAST(row_number() OVER (ORDER BY chain, resnum, resname) - 1 AS INTEGER) AS place, category, chain, resnum, resname FROM nb")

# Nodes of two grids, owners within the radius that the element has at the crystal's resolution.
def _grid(stem: str, edges: tuple[int, int, int], dims: tuple[int, int, int]) -> str:
    at = ", ".join(f"{g} / CAST({n} AS DOUBLE) * {e} AS {c}" for g, n, e, c in zip("ijk", dims, edges, "xyz", strict=True))
    return f"SELECT '{stem}' AS stem, i, j, k, {at} FROM " + ", ".join(f"(SELECT unnest(range(0, {n})) AS {g})" for g, n in zip("ijk", dims, strict=True))


_two = f"""{atoms_sql(10)}, nodes AS ({_grid('a', (12, 10, 8), (6, 5, 4))} UNION ALL {_grid('b', (8, 8, 8), (5, 5, 5))}),
held AS (SELECT *, CASE WHEN resnum % 2 = 0 THEN 'a' ELSE 'b' END AS stem, CASE WHEN resnum % 2 = 0 THEN {step_case('element', 3)} ELSE {step_case('element', 1)} END AS radius FROM atoms WHERE upper(trim(element)) <> 'H'),
vox AS (SELECT stem || '/' || i || '/' || j || '/' || k AS voxel, * FROM nodes),
ens AS (SELECT voxel, m AS map_id, ((7 * i + 13 * j + 17 * k + 29 * m) % 101) / CAST(20 AS DOUBLE) AS value FROM vox, (SELECT unnest(range(0, 5)) AS m)), fill AS (SELECT * FROM ens)"""
_owns = f"owns AS (SELECT DISTINCT voxel, a.resnum AS owner FROM vox JOIN held a ON a.stem = vox.stem AND {dist('vox', 'a')} <= a.radius)"
_sched = "omission AS (SELECT DISTINCT resnum AS owner, m AS map_id FROM atoms, (SELECT unnest(range(0, 5)) AS m) WHERE (resnum + 3 * m) % 5 = 0)"
_place = "string_split(voxel, '/')[1] AS stem, " + ", ".join(f"CAST(string_split(voxel, '/')[{n}] AS INTEGER) AS {g}" for n, g in enumerate("ijk", 2))
SQL["quantify_two_crystals"] = f"SELECT {_place}, mean, std, snr FROM ({solved(biases(_two, _owns, _sched))})"

#: From the publications named in ``densika.functions.radii``.
SQL["radius_literals"] = """WITH e AS (SELECT * FROM (VALUES ('H', [1.08, 1.20, 1.20, 1.68, 1.98], 0.31, 1.20), ('c', [1.02, 1.14, 1.14, 1.65, 1.98], 0.76, 1.70), (' N', [0.96, 1.11, 1.11, 1.62, 1.95], 0.71, 1.55),
('SE', [0.84, 0.99, 0.99, 1.59, 1.89], 1.20, 1.90), ('Zz', [1.02, 1.14, 1.14, 1.65, 1.98], 0.77, 1.70), ('CA', [0.87, 1.02, 1.02, 1.62, 1.92], 1.76, 1.70)) AS t(element, r, covalent, vdw))
SELECT element, unnest([CAST(0.2 AS DOUBLE), 1.0, 1.4, 2.6, 9.0]) AS resolution, CAST(unnest(r) AS DOUBLE) AS radius, CAST(covalent AS DOUBLE) AS covalent, CAST(vdw AS DOUBLE) AS vdw FROM e"""
SQL["name_literals"] = """SELECT * FROM (VALUES ('ALA', 'protein'), ('mse', 'protein'), ('HOH', 'water'), ('dod', 'water'), ('LIG', 'other_solvent'), ('SEC', 'protein'), ('SO4', 'other_solvent'), ('PYL', 'protein'), ('WAT', 'water'),
('1', 'FP,SIGFP/Status'), ('2', '-/FREE')) AS t(resname, category)"""


def ramp(value: str, stops: list[tuple[float, tuple[int, int, int]]]) -> str:
    at = f"least(greatest({value}, {stops[0][0]}), {stops[-1][0]})"
    parts = []
    for k in range(3):
        pieces = " ".join(f"WHEN {at} <= {b} THEN (({at}) - {a}) / CAST({b - a} AS DOUBLE) * ({y[k] - x[k]}) + {x[k]}" for (a, x), (b, y) in zip(stops, stops[1:], strict=False))
        parts.append(f"upper(lpad(to_hex(CAST(round(CASE {pieces} END) AS BIGINT)), 2, '0'))")
    return "'#' || " + " || ".join(parts)


SQL["score_colours"] = f"""SELECT vec_id AS atom_id, {ramp("((vec_id % 29) / CAST(20 AS DOUBLE) - CAST(0.1 AS DOUBLE))", [(0, (214, 39, 40)), (0.4, (255, 152, 150)), (0.8, (174, 199, 232)), (1.2, (31, 119, 180))])} AS score,
{ramp("((vec_id % 11) / CAST(10 AS DOUBLE))", [(0, (214, 39, 40)), (0.5, (255, 221, 113)), (1, (44, 160, 44))])} AS p_value FROM embeddings"""

# Four maps of one crystal, scaled alike; owners within the radii that nitrogen and carbon have at 2.1 angstrom.
_staged = f"""{_hkl}, node AS (SELECT i, j, k AS m, nu, nv, nw FROM dim, (SELECT unnest(range(0, 40)) AS i), (SELECT unnest(range(0, 40)) AS j), (SELECT unnest(range(0, 40)) AS k) WHERE i < nu AND j < nv AND k < nw),
base AS (SELECT i, j, m, any_value(i / CAST(nu AS DOUBLE) * 10) AS x, any_value(j / CAST(nv AS DOUBLE) * 11) AS y, any_value(m / CAST(nw AS DOUBLE) * 12) AS z,
  sum(2 * f * cos(2 * pi() * (h * i / CAST(nu AS DOUBLE) + hkl.k * j / CAST(nv AS DOUBLE) + l * m / CAST(nw AS DOUBLE)) - phi)) / 1320 AS b FROM node, hkl GROUP BY i, j, m),
vox AS (SELECT i || '/' || j || '/' || m AS voxel, * FROM base), model AS (SELECT * FROM (VALUES ('N', CAST(2 AS DOUBLE), CAST(3 AS DOUBLE), CAST(4 AS DOUBLE), CAST(1.35 AS DOUBLE)), ('CA', CAST(5 AS DOUBLE), CAST(5 AS DOUBLE), CAST(5 AS DOUBLE), CAST(1.38 AS DOUBLE))) AS t(owner, x, y, z, radius)),
ens AS (SELECT voxel, map_id, b * (1 + map_id * map_id / CAST(8 AS DOUBLE)) AS value FROM vox, (SELECT unnest(range(0, 4)) AS map_id)), fill AS (SELECT * FROM ens)"""
_staged_owns = f"owns AS (SELECT voxel, owner FROM vox JOIN model ON {dist('vox', 'model')} <= model.radius)"
_staged_omitted = "omission AS (SELECT * FROM (VALUES ('N', 0), ('N', 2), ('CA', 1)) AS t(owner, map_id))"
_ijk = ", ".join(f"CAST(string_split(voxel, '/')[{n}] AS INTEGER) AS {g}" for n, g in enumerate("ijk", 1))
SQL["stage_quantify"] = f"""SELECT {_ijk}, round(mean, 2) + CAST(0 AS DOUBLE) AS mean, round(std, 2) + CAST(0 AS DOUBLE) AS std FROM ({solved(biases(_staged, _staged_owns, _staged_omitted))})
UNION ALL SELECT -1, -1, -1, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)"""
SQL["stage_analyse"] = """SELECT * FROM (VALUES ('x1', true, CAST(3 AS BIGINT), CAST(2 AS BIGINT), CAST(0.1 AS DOUBLE), true, true, CAST(3 AS BIGINT)), ('x2', false, NULL, NULL, NULL, NULL, true, NULL))
AS t(stem, done, n_atoms, n_residues, significance_alpha, limited, shown, n_lines)"""
