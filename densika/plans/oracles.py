"""The queries of ``densika.plans.queries`` in SQL, written out plainly: distances by all pairs, biases by maps."""

from __future__ import annotations

from densika.functions.radii import COVALENT_SCALE, STEPS
from densika.operators.report import AMINO
from densika.plans.analogues import DIMS, ENS, MANY, MANY_OWNS, N_MAPS, OMISSION, OWNS, SPACING, atoms_sql, covalent_case, grid_value, omission_sql, step_case
from densika.plans.queries import BOND_SCALE, SCORE_SCALE
from densika.sources.workspace import AMPLITUDES, FREE_SETS

SQL: dict[str, str] = {}


def dist(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz") + ")"


def r4(x: str, digits: int = 4) -> str:
    return f"round({x}, {digits}) + CAST(0 AS DOUBLE)"


FILL = f"{ENS}, fill AS (SELECT v.voxel, m AS map_id, coalesce(value, CAST(0 AS DOUBLE)) AS value FROM (SELECT DISTINCT voxel FROM ens) v CROSS JOIN (SELECT unnest(range(0, {N_MAPS})) AS m) LEFT JOIN ens ON ens.voxel = v.voxel AND ens.map_id = m)"


def plain_stats(source: str) -> str:
    return f"SELECT voxel, avg(value) AS mean, stddev_samp(value) AS std FROM {source} GROUP BY voxel"


def rounded_stats(source: str) -> str:
    snr = "CASE WHEN std IS NULL OR isnan(std) OR std <= 1e-12 THEN CAST(0 AS DOUBLE) ELSE mean / std END"
    return f"SELECT voxel, {r4('mean')} AS mean, {r4('std')} AS std, {r4(snr)} AS snr FROM ({source})"


SQL["ensemble_snr"] = f"WITH {FILL} {rounded_stats(plain_stats('fill'))}"
SQL["ensemble_zero_fill"] = f"WITH {FILL} SELECT voxel, CAST(map_id AS INTEGER) AS map_id, {r4('value', 8)} AS value FROM fill"
SQL["ensemble_map_cap"] = f"WITH {ENS} SELECT voxel, {r4('value', 8)} AS mean, CAST(0 AS DOUBLE) AS snr FROM ens WHERE map_id = 0"
SQL["ensemble_skip_missing"] = f"WITH {ENS} {rounded_stats(plain_stats(f'(SELECT * FROM ens WHERE map_id < {N_MAPS})'))}"


def biases(filled: str, owns: str = OWNS, omitted: str = OMISSION) -> str:
    """Status of each part in each map of ``fill``, and its bias."""
    return f"""{filled}, {owns}, {omitted},
status AS (SELECT o.voxel, o.owner, f.map_id, f.value, om.owner IS NULL AS present FROM owns o JOIN fill f USING (voxel) LEFT JOIN omission om ON om.owner = o.owner AND om.map_id = f.map_id),
bias AS (SELECT voxel, owner, CASE WHEN count(*) FILTER (present) > 0 AND count(*) FILTER (NOT present) > 0 THEN avg(value) FILTER (present) - avg(value) FILTER (NOT present) ELSE CAST(0 AS DOUBLE) END AS bias FROM status GROUP BY 1, 2)"""


def solved(given: str) -> str:
    return f"""WITH {given}, off AS (SELECT voxel, map_id, sum(CASE WHEN present THEN bias ELSE CAST(0 AS DOUBLE) END) AS b FROM status JOIN bias USING (voxel, owner) GROUP BY 1, 2),
clean AS (SELECT voxel, map_id, value - coalesce(b, CAST(0 AS DOUBLE)) AS value FROM fill LEFT JOIN off USING (voxel, map_id)) {rounded_stats(plain_stats('clean'))}"""


SQL["bias_per_owner"] = f"WITH {biases(FILL)} SELECT voxel, owner, {r4('bias')} AS bias FROM bias"
SQL["bias_solve"] = solved(biases(FILL))
SQL["bias_solve_skip"] = solved(biases(f"{ENS}, fill AS (SELECT * FROM ens WHERE map_id < {N_MAPS})"))
SQL["bias_solve_50_maps"] = solved(biases(FILL.replace(ENS, MANY).replace(f"range(0, {N_MAPS})", "range(0, 50)"), MANY_OWNS, omission_sql(50)))
SQL["map_stats"] = f"""SELECT l_linenumber - 1 AS map_id, {r4("avg(l_extendedprice / l_quantity)")} AS mean,
{r4("CASE WHEN stddev_pop(l_extendedprice / l_quantity) = 0 THEN CAST(1 AS DOUBLE) ELSE stddev_pop(l_extendedprice / l_quantity) END")} AS sigma FROM lineitem GROUP BY 1"""

KEYS = "keys AS (SELECT s_suppkey AS n, 'A|' || (s_suppkey // 3) || '|SER|' || (s_suppkey % 3) AS key, s_nationkey AS crystal FROM supplier)"
SCHEDULE = f"""{KEYS}, sched AS (SELECT crystal, key, m AS map_id FROM keys, (SELECT unnest(range(0, {N_MAPS})) AS m)
WHERE ((CASE WHEN crystal % 2 = 0 THEN n // 3 ELSE n END) + 3 * m) % 11 < 2),
sparse AS (SELECT k.crystal, k.key, coalesce(string_agg(CAST(map_id AS VARCHAR), ',' ORDER BY map_id), '') AS maps FROM keys k LEFT JOIN sched s ON s.crystal = k.crystal AND s.key = k.key GROUP BY 1, 2)"""
SQL["omission_sparse_map"] = f"WITH {SCHEDULE} SELECT crystal, key, maps FROM sparse"
SQL["omission_incidence"] = f"WITH {SCHEDULE} SELECT crystal, key AS owner, CAST(map_id AS INTEGER) AS map_id FROM sched"
SQL["omission_mode"] = f"""WITH {SCHEDULE}, res AS (SELECT crystal, string_split(key, '|')[2] AS r, count(DISTINCT maps) > 1 AS varied FROM sparse GROUP BY 1, 2)
SELECT crystal, CASE WHEN bool_or(varied) THEN 'atoms' ELSE 'amino_acids' END AS mode FROM res GROUP BY 1"""


def batches(fraction: str) -> str:
    return f"""many AS (SELECT c_nationkey AS crystal, c_custkey AS key, it AS iteration FROM customer, (SELECT unnest(range(0, 2)) AS it)),
dealt AS (SELECT *, (row_number() OVER (PARTITION BY crystal, iteration ORDER BY (key * 7919 + iteration * 104729) % 10007, key) - 1)
  // greatest(1, CAST(round_even(count(*) OVER (PARTITION BY crystal, iteration) * {fraction}, 0) AS BIGINT)) AS batch FROM many)"""


SQL["sample_chunks"] = f"WITH {batches('CAST(0.3 AS DOUBLE)')} SELECT crystal, CAST(iteration AS INTEGER) AS iteration, CAST(batch AS BIGINT) AS batch, key FROM dealt"
SQL["sample_complement"] = f"""WITH {batches('(CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE))')}, b AS (SELECT DISTINCT crystal, iteration, batch AS other FROM dealt)
SELECT crystal, CAST(iteration AS INTEGER) AS iteration, CAST(other AS BIGINT) AS batch, key FROM dealt JOIN b USING (crystal, iteration) WHERE batch <> other"""
SQL["always_omit_split"] = f"WITH {KEYS} SELECT key, CASE WHEN n % 7 = 0 AND n >= 3 THEN 'always' ELSE 'remaining' END AS part FROM keys"
SQL["polymer_ids"] = f"WITH {atoms_sql(BOND_SCALE)} SELECT chain || '|' || resnum || '|' || resname AS key, min(atom_id) AS ordinal FROM atoms WHERE resname NOT IN ('HOH', 'LIG') GROUP BY 1"
SQL["owner_resolution"] = f"""WITH {atoms_sql(BOND_SCALE)}, named AS (SELECT *, element || CAST(atom_id % 4 AS VARCHAR) AS atom FROM atoms),
k AS (SELECT DISTINCT chain, resnum, resname, atom FROM named WHERE atom_id % 5 < 2)
SELECT k.chain || '|' || k.resnum || '|' || k.resname || '|' || k.atom || '|' AS owner, min(n.atom_id) AS atom_id FROM k JOIN named n USING (chain, resnum, atom) GROUP BY 1"""

RES = "(atom_id % 40) / CAST(10.0 AS DOUBLE)"


def by_level(res: str, element: str = "element") -> str:
    out = step_case(element, 0)
    for i, low in enumerate(STEPS[1:], 1):
        out = f"CASE WHEN {res} >= {low} THEN {step_case(element, i)} ELSE {out} END"
    return out


def interpolated(values: list[str], res: str) -> str:
    out = f"CASE WHEN {res} <= 0.5 THEN {values[0]}"
    for i in range(5):
        out += f" WHEN {res} <= {STEPS[i + 1]} THEN {values[i]} + ({res} - {STEPS[i]}) / CAST(0.5 AS DOUBLE) * ({values[i + 1]} - {values[i]})"
    return out + f" ELSE {values[5]} END"


SQL["radius_step"] = f"WITH {atoms_sql(1)} SELECT atom_id, {by_level(RES)} AS radius FROM atoms"
# Rows of the table with charges that the analogue's elements meet, as literals; others fall back to the neutral atom.
_NEUTRAL = {"H": (1.08, 1.20, 1.29, 1.41, 1.68, 1.98), "C": (1.02, 1.14, 1.26, 1.38, 1.65, 1.98), "N": (0.96, 1.11, 1.23, 1.35, 1.62, 1.95), "O": (0.93, 1.08, 1.20, 1.32, 1.62, 1.92), "P": (0.90, 1.05, 1.17, 1.32, 1.62, 1.95), "S": (0.90, 1.05, 1.17, 1.32, 1.62, 1.92), "CL": (0.90, 1.05, 1.17, 1.32, 1.62, 1.92), "MG": (0.87, 1.02, 1.14, 1.32, 1.62, 1.92)}
_CASES = [("MG", "atom_id % 3 = 2", (0.81, 0.96, 1.08, 1.26, 1.56, 1.89)), *((e, "true", r) for e, r in _NEUTRAL.items())]
_when = " ".join(f"WHEN upper(trim(element)) = '{e}' AND {c} THEN {interpolated([f'CAST({x} AS DOUBLE)' for x in r], RES)}" for e, c, r in _CASES)
SQL["radius_interp"] = f"""WITH {atoms_sql(1)} SELECT atom_id, {r4(f'CASE {_when} ELSE {covalent_case("element")} * ({interpolated([f"CAST({x} AS DOUBLE)" for x in COVALENT_SCALE], RES)}) END')} AS radius FROM atoms"""


def parabola(d: str, r: str) -> str:
    def piece(m: float, c: float, b: float) -> str:
        return f"({m}) / ({r} * {r}) * ({d} - {c} * {r}) * ({d} - {c} * {r}) + ({b})"

    return f"""CASE WHEN {r} <= 0 THEN CAST(0 AS DOUBLE) WHEN {d} <= CAST(1.0822 AS DOUBLE) * {r} THEN {piece(-1.0, 0.0, 1.0)} WHEN {d} <= CAST(1.4043 AS DOUBLE) * {r} THEN {piece(5.1177, 1.29366, -0.4)}
WHEN {d} <= 2 * {r} THEN {piece(-0.9507, 2.0, 0.0)} ELSE CAST(0 AS DOUBLE) END"""


def gaussian(d: str) -> str:
    knee = "(CAST(0.76 AS DOUBLE) + sqrt(CAST(0.5776 AS DOUBLE) - CAST(0.4356 AS DOUBLE)))"
    bell = f"exp(-0.5 * ({d} / CAST(0.66 AS DOUBLE)) * ({d} / CAST(0.66 AS DOUBLE)))"
    end = f"exp(-0.5 * ({knee} / CAST(0.66 AS DOUBLE)) * ({knee} / CAST(0.66 AS DOUBLE)))"
    return f"CASE WHEN {d} < 0 OR {d} > 1.52 THEN CAST(0 AS DOUBLE) WHEN {d} <= {knee} THEN {bell} ELSE {end} / ({knee} - 1.52) * ({d} - 1.52) END"


SQL["weight_parabola"] = f"WITH {atoms_sql(1)} SELECT atom_id, {r4(parabola('((atom_id % 80) / CAST(20.0 AS DOUBLE))', '(label / CAST(5.0 AS DOUBLE))'))} AS weight FROM atoms"
SQL["weight_gaussian"] = f"WITH {atoms_sql(1)} SELECT atom_id, {r4(gaussian('((atom_id % 80) / CAST(40.0 AS DOUBLE))'))} AS weight FROM atoms"
SQL["density_clip"] = f"WITH {atoms_sql(10)} SELECT atom_id, {r4('least(greatest((x - CAST(0.1 AS DOUBLE)) / CAST(0.5 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1.2 AS DOUBLE))')} AS z FROM atoms"
SQL["grid_oversampling"] = "SELECT p_partkey, CAST(greatest(1, ceil(p_size / CAST(10.0 AS DOUBLE) / CAST(0.7 AS DOUBLE))) AS INTEGER) AS factor FROM part"
SQL["id_keys"] = "SELECT s_suppkey AS n, 'A|' || (s_suppkey // 3) || '|SER|' || (s_suppkey % 3) AS key, CAST(s_suppkey // 3 AS INTEGER) AS resnum, CAST(s_suppkey % 3 AS VARCHAR) AS atom FROM supplier"
SQL["param_tokens"] = """WITH t AS (SELECT c_custkey, unnest([CAST(c_custkey AS VARCHAR), printf('%.2f', c_acctbal), c_name, CASE c_custkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'TRUE' ELSE 'false' END]) AS token FROM customer)
SELECT c_custkey, token, CASE WHEN lower(token) = 'none' THEN 'none' WHEN lower(token) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(token, '-?[0-9]+') THEN 'int' WHEN regexp_full_match(token, '-?[0-9]+[.][0-9]+') THEN 'float' ELSE 'str' END AS kind FROM t"""
SQL["badge_bucket"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderkey % 100 >= 80 THEN 'green' WHEN o_orderkey % 100 >= 60 THEN 'yellow' ELSE 'red' END AS badge FROM orders"

LEVEL = 3  # resolution 2.0
NEAR = f"{atoms_sql(BOND_SCALE)}, ra AS (SELECT *, {step_case('element', LEVEL)} AS radius FROM atoms)"
SQL["voxel_owner_join"] = f"""WITH {atoms_sql(BOND_SCALE)}, v AS (SELECT vec_id AS voxel, {", ".join(f"CAST(embedding[{i + 4}] AS DOUBLE) * CAST(40 AS DOUBLE) AS {c}" for i, c in enumerate("xyz"))} FROM embeddings)
SELECT DISTINCT v.voxel, a.atom_id // 8 AS owner FROM v, atoms a WHERE {dist('v', 'a')} <= CAST(2.0 AS DOUBLE) + a.label / CAST(10.0 AS DOUBLE)"""
SQL["neighbour_pairs"] = f"""WITH {NEAR} SELECT a.atom_id, count(*) AS n, {r4(f"min({dist('a', 'b')})")} AS nearest FROM ra a, ra b
WHERE a.atom_id <> b.atom_id AND {dist('a', 'b')} <= a.radius * 2 + CAST(3.0 AS DOUBLE) GROUP BY 1"""


def bonded(scale: float, name: str = "bonded") -> str:
    return f"""{atoms_sql(scale, name + "_a")}, {name}_h AS (SELECT *, {covalent_case('element')} AS cov FROM {name}_a WHERE upper(trim(element)) NOT IN ('H', 'D')),
{name} AS (SELECT a.atom_id AS src, b.atom_id AS dst FROM {name}_h a, {name}_h b WHERE a.atom_id <> b.atom_id AND {dist('a', 'b')} <= a.cov + b.cov + CAST(0.4 AS DOUBLE))"""


SQL["bond_edges"] = f"WITH {bonded(BOND_SCALE)} SELECT src, dst FROM bonded"
CLASH = f"(a.radius + b.radius - {dist('a', 'b')}) / (a.radius + b.radius + CAST(1e-12 AS DOUBLE)) > CAST(0.1 AS DOUBLE)"
SQL["clash_flags"] = f"WITH {NEAR} SELECT DISTINCT a.atom_id FROM ra a, ra b WHERE a.atom_id <> b.atom_id AND {CLASH}"
SQL["clash_flags_unbonded"] = f"WITH {NEAR}, {bonded(BOND_SCALE)} SELECT DISTINCT a.atom_id FROM ra a JOIN ra b ON a.atom_id <> b.atom_id AND {CLASH} LEFT JOIN bonded k ON k.src = a.atom_id AND k.dst = b.atom_id WHERE k.src IS NULL"


def points(source: str, radius: str) -> str:
    """Grid points of spheres, with the value at the wrapped index."""
    n = DIMS[0]
    edge = f"CAST({n * SPACING} AS DOUBLE)"
    out = f"SELECT *, {radius} AS sphere FROM {source}"
    for name, c in zip("uvw", "xyz", strict=True):
        f, reach = f"({c} * (CAST(1 AS DOUBLE) / {edge}))", f"sphere / {edge}"
        out = f"SELECT *, unnest(range(CAST(floor(({f} - {reach}) * {n}) AS BIGINT), CAST(ceil(({f} + {reach}) * {n}) AS BIGINT) + 1)) AS {name} FROM ({out})"
    at = ", ".join(f"{u} / CAST({n} AS DOUBLE) * {edge} AS p{c}" for u, c in zip("uvw", "xyz", strict=True))
    d2 = " + ".join(f"(p{c} - {c}) * (p{c} - {c})" for c in "xyz")
    wrapped = [f"((({u} % {n}) + {n}) % {n})" for u in "uvw"]
    return f"SELECT *, sqrt({d2}) AS d, {grid_value(*wrapped)} AS value FROM (SELECT *, {at} FROM ({out})) WHERE {d2} <= sphere * sphere"


FAR = f"{atoms_sql(SCORE_SCALE)}, fa AS (SELECT *, {step_case('element', LEVEL)} AS radius FROM atoms)"
SQL["sphere_points"] = f"""WITH {FAR}, pts AS ({points('fa', 'radius * 2')})
SELECT atom_id, count(*) AS n, CAST(sum(u) AS BIGINT) AS su, CAST(sum(v) AS BIGINT) AS sv, CAST(sum(w) AS BIGINT) AS sw, {r4('sum(value)')} AS total FROM pts GROUP BY 1"""
SHARE = f"""{FAR}, {bonded(SCORE_SCALE)}, reg AS (SELECT *, resname = 'HOH' AS is_water FROM fa WHERE upper(trim(element)) NOT IN ('H', 'D')),
pts AS ({points('(SELECT * FROM reg WHERE NOT is_water)', 'radius * 2')}),
near AS (SELECT a.atom_id, b.atom_id AS other, b.x AS ox, b.y AS oy, b.z AS oz, b.radius AS orad, k.src IS NOT NULL AS tied
  FROM reg a JOIN reg b ON a.atom_id <> b.atom_id AND {dist('a', 'b')} <= a.radius * 2 + CAST(3.0 AS DOUBLE) LEFT JOIN bonded k ON k.src = a.atom_id AND k.dst = b.atom_id),
pair AS (SELECT p.atom_id, p.u, p.v, p.w, p.d, p.radius, p.value, orad, tied, sqrt((px - ox) * (px - ox) + (py - oy) * (py - oy) + (pz - oz) * (pz - oz)) AS od FROM pts p LEFT JOIN near n ON n.atom_id = p.atom_id),
agg AS (SELECT atom_id, u, v, w, any_value(d) AS d, any_value(radius) AS radius, any_value(value) AS value,
  count(*) FILTER (od <= orad) AS n_in, count(*) FILTER (od <= orad AND NOT tied) AS n_free, coalesce(sum(od) FILTER (od <= orad AND NOT tied), CAST(0 AS DOUBLE)) AS d_free,
  count(*) FILTER (od > orad AND od <= 2 * orad) AS n_ring, coalesce(sum(od) FILTER (od > orad AND od <= 2 * orad), CAST(0 AS DOUBLE)) AS d_ring FROM pair GROUP BY 1, 2, 3, 4),
shares AS (SELECT *, CASE WHEN d <= radius THEN CASE WHEN n_free = 0 THEN CAST(1 AS DOUBLE) WHEN d + d_free > 0 THEN 1 - d / (d + d_free) ELSE CAST(1 AS DOUBLE) / (n_free + 1) END
  WHEN d > 2 * radius THEN CAST(0 AS DOUBLE) WHEN n_in > 0 THEN CAST(0 AS DOUBLE)
  ELSE CASE WHEN n_ring = 0 THEN CAST(1 AS DOUBLE) WHEN d + d_ring > 0 THEN 1 - d / (d + d_ring) ELSE CAST(1 AS DOUBLE) / (n_ring + 1) END END AS share FROM agg)"""
SQL["ownership_share"] = f"WITH {SHARE} SELECT atom_id, count(*) AS n, {r4('sum(share)')} AS share FROM shares GROUP BY 1"


def over_positive(condition: str) -> str:
    top = f"coalesce(sum(weight * share * least(greatest(value, CAST(0 AS DOUBLE)), CAST(1.2 AS DOUBLE))) FILTER ({condition}), CAST(0 AS DOUBLE))"
    total = "coalesce(sum(weight) FILTER (weight > 0), CAST(0 AS DOUBLE))"
    return r4(f"CASE WHEN {total} > 0 THEN {top} / {total} ELSE CAST(0 AS DOUBLE) END")


SQL["atom_score"] = f"""WITH {SHARE}, wt AS (SELECT *, {parabola('d', 'radius')} AS weight FROM shares),
sc AS (SELECT atom_id, {over_positive('true')} AS score, {over_positive('weight > 0')} AS score_positive, {over_positive('weight < 0')} AS score_negative, count(*) AS n_grid_points FROM wt GROUP BY 1)
SELECT a.atom_id, coalesce(score, CAST(0 AS DOUBLE)) AS score, coalesce(score_positive, CAST(0 AS DOUBLE)) AS score_positive, coalesce(score_negative, CAST(0 AS DOUBLE)) AS score_negative, coalesce(n_grid_points, 0) AS n_grid_points
FROM reg a LEFT JOIN sc USING (atom_id) WHERE NOT a.is_water"""
WATER_POINTS = f"""{FAR}, wa AS (SELECT * FROM fa WHERE resname = 'HOH' AND upper(trim(element)) NOT IN ('H', 'D')), pts AS ({points('wa', 'CAST(1.52 AS DOUBLE)')}),
wt AS (SELECT atom_id, {gaussian('d')} AS weight, value FROM pts)"""
SQL["water_score"] = f"""WITH {WATER_POINTS},
sc AS (SELECT atom_id, {r4("CASE WHEN sum(weight) <> 0 THEN sum(weight * CASE WHEN value >= CAST(2.5 AS DOUBLE) THEN value ELSE CAST(0 AS DOUBLE) END) / sum(weight) ELSE CAST(0 AS DOUBLE) END")} AS score, count(*) AS n FROM wt GROUP BY 1)
SELECT atom_id, coalesce(score, CAST(0 AS DOUBLE)) AS score, coalesce(n, 0) AS n_grid_points FROM wa LEFT JOIN sc USING (atom_id)"""

SCORES = f"""{NEAR}, scores AS (SELECT *, '' AS icode, (atom_id * 37 % 101) / CAST(100.0 AS DOUBLE) AS score, -(atom_id * 11 % 50) / CAST(100.0 AS DOUBLE) AS score_negative, resname = 'HOH' AS is_water FROM atoms),
clash AS (SELECT DISTINCT a.atom_id FROM ra a, ra b WHERE a.atom_id <> b.atom_id AND {CLASH}),
diag AS (SELECT scores.*, clash.atom_id IS NOT NULL AS has_clash, score < CAST(0.8 AS DOUBLE) AS missing, abs(score_negative) > CAST(0.2 AS DOUBLE) AS extra FROM scores LEFT JOIN clash USING (atom_id))"""
POWER_MEAN = "greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) / sqrt(avg(CAST(1 AS DOUBLE) / (greatest(score + CAST(0.1 AS DOUBLE), CAST(1e-10 AS DOUBLE)) * greatest(score + CAST(0.1 AS DOUBLE), CAST(1e-10 AS DOUBLE))))) - CAST(0.1 AS DOUBLE))"
SQL["residue_power_mean"] = f"""WITH {SCORES} SELECT chain, resname, resnum, icode, {r4(POWER_MEAN)} AS residue_score, min(score) AS min_atom_score, {r4('median(score)')} AS median_atom_score, max(score) AS max_atom_score, count(*) AS n_atoms,
count(*) FILTER (has_clash) AS n_clashes, count(*) FILTER (missing) AS n_missing_density, count(*) FILTER (extra) AS n_unaccounted_density FROM diag GROUP BY 1, 2, 3, 4"""
SQL["residue_profile"] = f"WITH {SCORES} SELECT chain, resnum, {r4(POWER_MEAN)} AS value FROM scores WHERE chain = 'A' GROUP BY 1, 2"
SQL["opia"] = f"""WITH RECURSIVE {SCORES}, {bonded(BOND_SCALE)}, good AS (SELECT atom_id FROM scores WHERE score >= CAST(0.5 AS DOUBLE)),
links AS (SELECT src, dst FROM bonded JOIN good g ON g.atom_id = src JOIN good h ON h.atom_id = dst),
reach(root, atom_id) AS (SELECT atom_id, atom_id FROM good UNION SELECT reach.root, links.dst FROM reach JOIN links ON links.src = reach.atom_id),
comp AS (SELECT root, count(*) AS size FROM reach GROUP BY root)
SELECT {r4("CAST((SELECT count(*) FROM comp WHERE size >= 2) AS DOUBLE) / (SELECT count(*) FROM scores)")} AS opia"""
SQL["flag_counts"] = f"""WITH {SCORES} SELECT count(*) AS n_atoms, count(DISTINCT (chain, resname, resnum)) AS n_residues, {r4('avg(score)')} AS mean_atom_score, {r4('median(score)')} AS median_atom_score,
count(*) FILTER (has_clash) AS n_clashes, count(*) FILTER (missing) AS n_missing_density, count(*) FILTER (extra) AS n_unaccounted_density FROM diag"""
WATER = f"WITH {SCORES}, wat AS (SELECT atom_id, score, CAST(row_number() OVER (ORDER BY score DESC, atom_id) AS INTEGER) AS rank, score >= CAST(0.24 AS DOUBLE) AS kept FROM scores WHERE is_water)"
SQL["water_rank"] = f"{WATER} SELECT * FROM wat"
SQL["water_counts"] = f"{WATER} SELECT count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_removed FROM wat"

_amino = ", ".join(f"'{a}'" for a in AMINO)
LIGAND = f"""{atoms_sql(BOND_SCALE)}, hv AS (SELECT * FROM atoms WHERE upper(trim(element)) NOT IN ('H', 'D')), lg AS (SELECT * FROM hv WHERE resname = 'LIG'),
nb AS (SELECT DISTINCT a.chain, a.resnum, a.resname, CASE WHEN a.resname = 'HOH' THEN 'water' WHEN a.resname IN ({_amino}) THEN 'protein' ELSE 'other_solvent' END AS category FROM hv a, lg b WHERE a.resname <> 'LIG' AND {dist('a', 'b')} <= 4)"""
SQL["lig_neighbourhood"] = f"WITH {LIGAND} SELECT * FROM nb"
SQL["lig_counts"] = f"WITH {LIGAND} SELECT count(*) FILTER (category = 'protein') AS n_protein, count(*) FILTER (category = 'water') AS n_water, count(*) FILTER (category = 'other_solvent') AS n_other FROM nb"
SQL["lig_centroid"] = f"""WITH {LIGAND} SELECT {r4('avg(x)', 3)} AS cx, {r4('avg(y)', 3)} AS cy, {r4('avg(z)', 3)} AS cz, count(*) AS n_atoms, arg_max(chain, atom_id) AS lig_chain, arg_max(resnum, atom_id) AS lig_seqid FROM lg"""
SQL["lig_extract"] = f"""WITH {SCORES}, res AS (SELECT chain, resnum, {POWER_MEAN} AS m FROM scores WHERE resname = 'LIG' GROUP BY 1, 2)
SELECT {r4('(SELECT m FROM res ORDER BY chain, resnum LIMIT 1)')} AS residue_score, count(*) AS n_atoms, {r4('sum(score)')} AS total FROM scores WHERE resname = 'LIG'"""

RESULTS = "results AS (SELECT CAST(o_orderkey AS VARCHAR) AS stem, CASE WHEN o_orderkey % 11 <> 0 THEN round((o_orderkey * 7 % 1000) / CAST(1000.0 AS DOUBLE), 3) END AS opia FROM orders)"
SQL["screen_rank"] = f"WITH {RESULTS} SELECT stem, opia, CAST(row_number() OVER (ORDER BY opia DESC NULLS LAST, stem) AS INTEGER) AS rank, CASE WHEN opia IS NULL THEN 'none' WHEN opia >= 0.8 THEN 'green' WHEN opia >= 0.6 THEN 'yellow' ELSE 'red' END AS badge FROM results"
SQL["screen_summary"] = f"WITH {RESULTS} SELECT count(*) AS n_experiments, count(opia) AS n_complete, round(avg(opia), 4) AS mean_opia FROM results"
SQL["experiment_assembly"] = """SELECT CAST(d.doc_id AS VARCHAR) AS stem, source, round(CASE WHEN toxic = 1 THEN NULL ELSE CAST(quality AS DOUBLE) END, 4) AS opia, CASE WHEN l.doc_id IS NOT NULL THEN CAST(12 AS BIGINT) END AS n_atoms, l.doc_id IS NOT NULL AS analysis_complete
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
SQL["experiment_json"] = f"""WITH {RESULTS} SELECT stem, '{{"stem":"' || stem || '","opia":"' || coalesce(printf('%.3f', opia), 'N/A') || '"}}' AS json FROM results"""


def _path(skip: int, name: str) -> str:
    return f"CASE WHEN o_orderkey % {skip} <> 0 THEN '/data/{name}/x' || o_orderkey || '.pdb' END"


SCREEN = f"""scr AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 13 <> 0 THEN 'x' || o_orderkey END AS name, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS outcome,
{_path(3, 'ref')} AS a, {_path(5, 'mtz')} AS b, {_path(2, 'dim')} AS c, {_path(4, 'dmz')} AS e FROM orders),
best AS (SELECT row, name AS id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE c END AS pdb, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE e END AS mtz FROM scr
WHERE name IS NOT NULL AND ((a IS NOT NULL AND b IS NOT NULL) OR (c IS NOT NULL AND e IS NOT NULL)))"""
SQL["screening_best_pairs"] = f"WITH {SCREEN} SELECT id, pdb, mtz FROM best"
SQL["screening_cap"] = f"WITH {SCREEN} SELECT id, pdb, mtz FROM best ORDER BY row LIMIT 100"
SQL["outcome_filter"] = f"WITH {SCREEN} SELECT row, outcome AS \"RefinementOutcome\" FROM scr WHERE regexp_matches(outcome, 'URGENT|HIGH')"
SQL["screening_csv"] = r"""SELECT regexp_replace(regexp_replace(regexp_extract(u, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1'), '(-sf|_sf|-SF|_SF)$', '') AS id, u AS pdb, url AS mtz FROM (SELECT url, regexp_replace(url, '[?#].*$', '') AS u FROM pages)"""
_labels = [x for pair in AMPLITUDES for x in pair] + FREE_SETS
_list = "[" + ", ".join(f"'{x}'" for x in _labels) + "]"
_pairs = " ".join(f"WHEN list_contains(has, '{a}') AND list_contains(has, '{b}') THEN '{a},{b}'" for a, b in AMPLITUDES)
_frees = " ".join(f"WHEN list_contains(has, '{a}') THEN '{a}'" for a in FREE_SETS)
SQL["label_priority"] = f"""WITH c AS (SELECT l_orderkey AS crystal, list({_list}[l_partkey * 5 % {len(_labels)} + 1]) || ['SIGF'] AS has FROM lineitem GROUP BY 1),
f AS (SELECT crystal, CASE {_pairs} END AS f_label, CASE {_frees} END AS rfree_label FROM c)
SELECT *, nullif(concat_ws('; ', CASE WHEN f_label IS NULL THEN 'no amplitude pair found' END, CASE WHEN rfree_label IS NULL THEN 'no free-set column found' END), '') AS error FROM f"""
LISTING = """lst AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS stem, CASE WHEN l_partkey % 3 = 0 THEN '1.5' ELSE '1.0' END AS ks, [10, 30, 50, 100][l_suppkey % 4 + 1] AS cap FROM lineitem),
pth AS (SELECT stem, '/r/' || stem || '_k_' || ks || '_cap_' || cap || '_snr.ccp4' AS path, CAST(ks AS DOUBLE) AS k, cap FROM lst)"""
SQL["map_resolver"] = f"""WITH {LISTING}, rk AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY CASE WHEN k = 1.5 THEN 0 ELSE 1 END, cap DESC, path) AS n FROM pth WHERE k = 1.5 OR (k = 1.0 AND cap = 50)) SELECT stem, path, k, CAST(cap AS INTEGER) AS cap FROM rk WHERE n = 1"""
SQL["null_param_lookup"] = f"""WITH {LISTING}, rk AS (SELECT *, k = 1.0 AND cap = 50 AS exact, row_number() OVER (PARTITION BY stem ORDER BY CASE WHEN k = 1.0 AND cap = 50 THEN 0 ELSE 1 END, path) AS n FROM pth)
SELECT stem, cap + CAST(1.0 AS DOUBLE) AS df, CAST(0 AS DOUBLE) AS loc, k AS scale, exact FROM rk WHERE n = 1"""
SQL["job_chunks"] = "SELECT o_custkey AS customer, o_orderkey AS job, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS chunk, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 4 AS INTEGER) AS slot FROM orders"
SQL["job_fan_out"] = "SELECT c_custkey, CAST(unnest(range(0, CAST(c_custkey % 4 + 1 AS BIGINT))) AS INTEGER) AS map_id FROM customer"
SQL["job_pending"] = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"
SQL["manifest_lines"] = f"WITH {SCREEN} SELECT id || '|' || pdb || '|' || mtz AS value FROM best"
SQL["selection_text"] = f"WITH {KEYS} SELECT crystal, string_agg('(chain A and resseq ' || (n // 3) || ' and name ' || (n % 3) || ')', ' or ' ORDER BY n // 3, key) AS selection FROM keys GROUP BY 1"
SQL["common_prefix"] = f"""WITH {SCREEN}, p AS (SELECT string_split(a, '/') AS s FROM scr WHERE a IS NOT NULL), parts AS (SELECT i, s[i] AS part FROM (SELECT s, unnest(range(1, len(s))) AS i FROM p)),
g AS (SELECT i, count(DISTINCT part) AS k, count(*) AS n, min(part) AS part FROM parts GROUP BY i), bad AS (SELECT coalesce(min(i), 1000) AS b FROM g WHERE k > 1 OR n < (SELECT count(*) FROM p))
SELECT string_agg(part, '/' ORDER BY i) AS prefix FROM g, bad WHERE i < b"""
SQL["map_files"] = f"WITH {LISTING} SELECT stem, string_agg(path, ',' ORDER BY path) AS paths FROM pth WHERE cap <> 50 GROUP BY 1"
SQL["manifest_reflections"] = f"""WITH {SCREEN} SELECT 'x' || row AS stem, coalesce(CASE WHEN a IS NOT NULL THEN b END, CASE WHEN row % 2 = 0 THEN e END) AS reflections FROM scr"""
SQL["scored_model"] = f"""WITH {atoms_sql(BOND_SCALE)} SELECT atom_id, printf('%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s', 'ATOM', atom_id, ' C' || (atom_id % 8), ' ', resname, chain, resnum, ' ', floor(x), floor(y), floor(z), 1.0,
CASE WHEN atom_id % 3 = 0 THEN (atom_id * 37 % 101) / CAST(100.0 AS DOUBLE) * 100 ELSE CAST(0 AS DOUBLE) END, 'C') AS value FROM atoms"""
SQL["t_sf"] = f"WITH {atoms_sql(10)}, z AS (SELECT atom_id, (x - CAST(0.1 AS DOUBLE)) / CAST(0.5 AS DOUBLE) AS z FROM atoms) SELECT atom_id, {r4('0.5 - z / (2 * sqrt(2 + z * z))')} AS p_value FROM z"
SQL["t_sf_by_group"] = f"""WITH {atoms_sql(10)}, z AS (SELECT atom_id, chain, x, (x - CAST(0.1 AS DOUBLE)) / CAST(0.5 AS DOUBLE) AS z FROM atoms)
SELECT atom_id, {r4("CASE chain WHEN 'A' THEN 0.5 - atan(x) / pi() WHEN 'B' THEN 0.5 - z / (2 * sqrt(2 + z * z)) END")} AS p_value FROM z"""
SQL["t_threshold"] = f"SELECT CAST(i AS INTEGER) AS percent, {r4('1 + 2 * (1 - 2 * i / CAST(100 AS DOUBLE)) * sqrt(2 / (4 * (i / CAST(100 AS DOUBLE)) * (1 - i / CAST(100 AS DOUBLE))))')} AS threshold FROM (SELECT unnest(range(1, 50)) AS i)"


def oracle_sql() -> dict[str, str]:
    from densika.plans import file_oracles, given_queries  # noqa: F401  add their own

    return dict(SQL)
