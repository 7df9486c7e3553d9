"""Density sphere radii by element and resolution: a step table, and an interpolated one that users may give."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower bounds of resolution, and radii of ten elements from each bound on, as published by
#: Meyder et al. (2017), J. Chem. Inf. Model. 57, 2437-2447.
STEPS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
STEP_RADII = {
    "H": (1.08, 1.20, 1.29, 1.41, 1.68, 1.98),
    "C": (1.02, 1.14, 1.26, 1.38, 1.65, 1.98),
    "N": (0.96, 1.11, 1.23, 1.35, 1.62, 1.95),
    "O": (0.93, 1.08, 1.20, 1.32, 1.62, 1.92),
    "S": (0.90, 1.05, 1.17, 1.32, 1.62, 1.92),
    "P": (0.90, 1.05, 1.17, 1.32, 1.62, 1.95),
    "SE": (0.84, 0.99, 1.11, 1.29, 1.59, 1.89),
    "MG": (0.87, 1.02, 1.14, 1.32, 1.62, 1.92),
    "CL": (0.90, 1.05, 1.17, 1.32, 1.62, 1.92),
    "CA": (0.87, 1.02, 1.17, 1.32, 1.62, 1.92),
}
#: Element, charge and the radii from each bound on, of the same publication; by atomic number, up to
#: krypton and the heavier elements that are common in models.  A file of the same form may hold more.
IONS = """
H 0 1.08 1.20 1.29 1.41 1.68 1.98
H -1 1.47 1.56 1.68 1.74 1.95 2.16
He 0 0.93 1.05 1.17 1.32 1.59 1.92
Li 0 0.90 1.08 1.23 1.38 1.68 2.01
Li 1 0.81 0.96 1.08 1.26 1.53 1.86
Be 0 1.02 1.20 1.32 1.44 1.71 2.01
Be 2 0.78 0.90 1.05 1.23 1.53 1.86
B 0 1.05 1.20 1.32 1.44 1.71 1.98
C 0 1.02 1.14 1.26 1.38 1.65 1.98
N 0 0.96 1.11 1.23 1.35 1.62 1.95
O 0 0.93 1.08 1.20 1.32 1.62 1.92
O -1 0.99 1.11 1.23 1.35 1.65 1.95
F 0 0.90 1.05 1.17 1.32 1.59 1.92
F -1 0.93 1.08 1.20 1.32 1.62 1.92
Ne 0 0.87 1.02 1.14 1.29 1.59 1.89
Na 0 0.87 0.99 1.14 1.29 1.59 1.92
Na 1 0.84 0.99 1.11 1.26 1.56 1.89
Mg 0 0.87 1.02 1.14 1.32 1.62 1.92
Mg 2 0.81 0.96 1.08 1.26 1.56 1.89
Al 0 0.87 1.02 1.17 1.32 1.62 1.95
Al 3 0.78 0.93 1.08 1.26 1.53 1.86
Si 0 0.87 1.05 1.17 1.32 1.62 1.95
Si 4 0.78 0.93 1.08 1.23 1.53 1.86
P 0 0.90 1.05 1.17 1.32 1.62 1.95
S 0 0.90 1.05 1.17 1.32 1.62 1.92
Cl 0 0.90 1.05 1.17 1.32 1.62 1.92
Cl -1 0.93 1.08 1.20 1.35 1.62 1.95
Ar 0 0.90 1.05 1.17 1.32 1.59 1.92
K 0 0.87 1.02 1.17 1.32 1.59 1.92
K 1 0.87 1.02 1.14 1.29 1.59 1.92
Ca 0 0.87 1.02 1.17 1.32 1.62 1.92
Ca 2 0.87 0.99 1.14 1.29 1.56 1.89
Sc 0 0.87 1.02 1.17 1.32 1.62 1.92
Sc 3 0.84 0.99 1.11 1.26 1.56 1.89
Ti 0 0.87 1.02 1.14 1.32 1.59 1.92
Ti 2 0.84 0.99 1.11 1.29 1.56 1.89
Ti 3 0.84 0.99 1.11 1.26 1.56 1.89
Ti 4 0.81 0.96 1.11 1.26 1.56 1.89
V 0 0.87 1.02 1.14 1.32 1.59 1.92
V 2 0.84 0.99 1.11 1.29 1.56 1.89
V 3 0.84 0.99 1.11 1.26 1.56 1.89
V 5 0.81 0.96 1.08 1.26 1.56 1.89
Cr 0 0.87 1.02 1.14 1.29 1.59 1.92
Cr 2 0.84 0.99 1.11 1.29 1.56 1.89
Cr 3 0.84 0.96 1.11 1.26 1.56 1.89
Mn 0 0.87 1.02 1.14 1.29 1.59 1.92
Mn 2 0.84 0.99 1.11 1.26 1.56 1.89
Mn 3 0.84 0.96 1.11 1.26 1.56 1.89
Mn 4 0.81 0.96 1.11 1.26 1.56 1.89
Fe 0 0.84 0.99 1.14 1.29 1.59 1.92
Fe 2 0.84 0.96 1.11 1.26 1.56 1.89
Fe 3 0.81 0.96 1.11 1.26 1.56 1.89
Co 0 0.84 0.99 1.14 1.29 1.59 1.92
Co 2 0.84 0.96 1.11 1.26 1.56 1.89
Co 3 0.81 0.96 1.11 1.26 1.56 1.89
Ni 0 0.84 0.99 1.14 1.29 1.59 1.89
Ni 2 0.81 0.96 1.11 1.26 1.56 1.89
Ni 3 0.81 0.96 1.08 1.26 1.56 1.89
Cu 0 0.84 0.99 1.11 1.29 1.56 1.89
Cu 1 0.84 0.96 1.11 1.26 1.56 1.89
Cu 2 0.81 0.96 1.11 1.26 1.56 1.89
Zn 0 0.84 0.99 1.11 1.29 1.56 1.89
Zn 2 0.81 0.96 1.08 1.26 1.56 1.89
Ga 0 0.84 0.99 1.11 1.29 1.56 1.89
Ga 3 0.81 0.96 1.08 1.26 1.53 1.86
Ge 0 0.84 0.99 1.11 1.29 1.59 1.89
Ge 4 0.78 0.93 1.08 1.26 1.53 1.86
As 0 0.84 0.99 1.11 1.29 1.59 1.89
Se 0 0.84 0.99 1.11 1.29 1.59 1.89
Br 0 0.84 0.99 1.11 1.29 1.59 1.89
Br -1 0.84 0.99 1.14 1.29 1.59 1.92
Kr 0 0.84 0.99 1.14 1.29 1.59 1.89
Mo 0 0.84 0.99 1.11 1.29 1.59 1.89
Mo 3 0.81 0.96 1.11 1.26 1.56 1.89
Mo 5 0.81 0.96 1.08 1.26 1.56 1.89
Mo 6 0.78 0.93 1.08 1.26 1.53 1.86
Ag 0 0.84 0.99 1.11 1.29 1.56 1.89
Ag 1 0.84 0.96 1.11 1.26 1.56 1.89
Ag 2 0.81 0.96 1.11 1.26 1.56 1.89
Cd 0 0.84 0.99 1.11 1.29 1.56 1.89
Cd 2 0.81 0.96 1.11 1.26 1.56 1.89
I 0 0.84 0.99 1.11 1.29 1.56 1.89
I -1 0.84 0.99 1.14 1.29 1.59 1.92
Xe 0 0.84 0.99 1.11 1.29 1.56 1.89
Cs 0 0.84 0.99 1.11 1.29 1.56 1.89
Cs 1 0.84 0.99 1.11 1.29 1.56 1.89
Ba 0 0.81 0.99 1.11 1.29 1.56 1.89
Ba 2 0.81 0.96 1.11 1.26 1.56 1.89
Gd 0 0.81 0.96 1.11 1.26 1.56 1.89
Gd 3 0.81 0.96 1.08 1.26 1.56 1.89
W 0 0.81 0.96 1.11 1.26 1.56 1.89
W 6 0.78 0.93 1.08 1.23 1.53 1.86
Pt 0 0.81 0.96 1.11 1.26 1.56 1.89
Pt 2 0.81 0.96 1.08 1.26 1.56 1.89
Pt 4 0.78 0.93 1.08 1.26 1.53 1.86
Au 0 0.81 0.96 1.11 1.26 1.56 1.89
Au 1 0.81 0.96 1.08 1.26 1.56 1.89
Au 3 0.78 0.93 1.08 1.26 1.53 1.86
Hg 0 0.81 0.96 1.11 1.26 1.56 1.89
Hg 1 0.81 0.96 1.08 1.26 1.56 1.89
Hg 2 0.81 0.96 1.08 1.26 1.56 1.89
Pb 0 0.81 0.96 1.11 1.26 1.56 1.89
Pb 2 0.81 0.96 1.08 1.26 1.56 1.89
Pb 4 0.78 0.93 1.08 1.26 1.53 1.86
"""
#: carbon's radii over its covalent radius, for elements without an entry.
COVALENT_SCALE = (1.325, 1.481, 1.636, 1.792, 2.143, 2.571)
#: Covalent radii in angstrom (Cordero et al. 2008, Dalton Trans., 2832), carbon as sp3, iron, manganese
#: and cobalt of low spin; by atomic number, deuterium as hydrogen.
COVALENT = {
    "H": 0.31, "D": 0.31, "HE": 0.28, "LI": 1.28, "BE": 0.96, "B": 0.84, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "NE": 0.58, "NA": 1.66, "MG": 1.41,
    "AL": 1.21, "SI": 1.11, "P": 1.07, "S": 1.05, "CL": 1.02, "AR": 1.06, "K": 2.03, "CA": 1.76, "SC": 1.70, "TI": 1.60, "V": 1.53, "CR": 1.39, "MN": 1.39,
    "FE": 1.32, "CO": 1.26, "NI": 1.24, "CU": 1.32, "ZN": 1.22, "GA": 1.22, "GE": 1.20, "AS": 1.19, "SE": 1.20, "BR": 1.20, "KR": 1.16, "RB": 2.20, "SR": 1.95,
    "Y": 1.90, "ZR": 1.75, "NB": 1.64, "MO": 1.54, "TC": 1.47, "RU": 1.46, "RH": 1.42, "PD": 1.39, "AG": 1.45, "CD": 1.44, "IN": 1.42, "SN": 1.39, "SB": 1.39,
    "TE": 1.38, "I": 1.39, "XE": 1.40, "CS": 2.44, "BA": 2.15, "LA": 2.07, "CE": 2.04, "PR": 2.03, "ND": 2.01, "PM": 1.99, "SM": 1.98, "EU": 1.98, "GD": 1.96,
    "TB": 1.94, "DY": 1.92, "HO": 1.92, "ER": 1.89, "TM": 1.90, "YB": 1.87, "LU": 1.87, "HF": 1.75, "TA": 1.70, "W": 1.62, "RE": 1.51, "OS": 1.44, "IR": 1.41,
    "PT": 1.36, "AU": 1.36, "HG": 1.32, "TL": 1.45, "PB": 1.46, "BI": 1.48, "PO": 1.40, "AT": 1.50, "RN": 1.50, "FR": 2.60, "RA": 2.21, "AC": 2.15, "TH": 2.06,
    "PA": 2.00, "U": 1.96, "NP": 1.90, "PU": 1.87, "AM": 1.80, "CM": 1.69,
}
UNKNOWN_COVALENT = 0.77
#: Van der Waals radii in angstrom (Bondi 1964, J. Phys. Chem. 68, 441).
VAN_DER_WAALS = {
    "H": 1.20, "D": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "CL": 1.75, "BR": 1.85, "I": 1.98, "SE": 1.90,
    "SI": 2.10, "NA": 2.27, "MG": 1.73, "K": 2.75, "NI": 1.63, "CU": 1.40, "ZN": 1.39,
}
UNKNOWN_VAN_DER_WAALS = 1.70


def _lookup(element: Column, table: dict[str, float], otherwise: float) -> Column:
    held = F.expr("map(" + ", ".join(f"'{name}', {radius}D" for name, radius in table.items()) + ")")  # in one call, not two hundred
    return F.coalesce(F.try_element_at(held, element), F.lit(otherwise))


def covalent_radius(element: Column) -> Column:
    return _lookup(F.upper(F.trim(element)), COVALENT, UNKNOWN_COVALENT)


def van_der_waals(element: Column) -> Column:
    return _lookup(F.upper(F.trim(element)), VAN_DER_WAALS, UNKNOWN_VAN_DER_WAALS)


def radius_step(element: Column, resolution: Column) -> Column:
    """The radius of the largest bound not above the resolution; the first below all, carbon's if unknown."""
    pairs = [x for e, r in STEP_RADII.items() for x in (F.lit(e), F.array(*map(F.lit, r)))]
    table = F.create_map(*pairs)
    radii = F.coalesce(F.try_element_at(table, F.upper(F.trim(element))), F.array(*map(F.lit, STEP_RADII["C"])))
    level = sum(((resolution >= s).cast("int") for s in STEPS[1:]), F.lit(1))
    return F.element_at(radii, level)


def interpolated(radii: Column, resolution: Column) -> Column:
    """Linear between the bounds, constant outside; ``radii`` is an array of six."""
    at = F.least(F.greatest(resolution, F.lit(STEPS[0])), F.lit(STEPS[-1]))
    left = F.least(F.floor((at - STEPS[0]) / 0.5), F.lit(len(STEPS) - 2)).cast("int")
    low = F.get(radii, left)
    return low + (at - (left * 0.5 + STEPS[0])) / 0.5 * (F.get(radii, left + 1) - low)


TABLE = "element string, charge int, radii array<double>"


def parsed_table(text: str) -> list[tuple[str, int, list[float]]]:
    """Lines of element, charge and six radii; blank ones and comments are skipped."""
    rows = [line.partition("#")[0].replace(",", " ").split() for line in text.splitlines()]
    return [(r[0], int(r[1]), [float(x) for x in r[2:]]) for r in rows if r]


def default_table(spark: SparkSession) -> DataFrame:
    """``(element, charge, radii)``; a fuller table of the same form may replace it."""
    return spark.createDataFrame(parsed_table(IONS), TABLE)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A user's table, over the built-in one."""
    own = parsed_table(Path(path).read_text(encoding="utf-8"))
    if bad := [r[:2] for r in own if len(r[2]) != len(STEPS)]:
        raise ValueError(f"radii of {bad} are not {len(STEPS)} numbers")
    known = {(e.upper(), q): (e, q, r) for e, q, r in [*parsed_table(IONS), *own]}
    return spark.createDataFrame(list(known.values()), TABLE)


def with_radius_interp(atoms: DataFrame, table: DataFrame, resolution: Column) -> DataFrame:
    """Adds ``radius``: of (element, charge), else (element, 0), else the scaled covalent radius."""
    # Elements times charges: a few hundred rows by nature.
    own = F.broadcast(table.select(F.upper("element").alias("e1"), F.col("charge").alias("q1"), F.col("radii").alias("r1")))
    neutral = F.broadcast(table.where("charge = 0").select(F.upper("element").alias("e2"), F.col("radii").alias("r2")))
    name = F.upper(F.trim(atoms["element"]))
    joined = atoms.join(own, (name == F.col("e1")) & (atoms["charge"] == F.col("q1")), "left").join(neutral, name == F.col("e2"), "left")
    scaled = covalent_radius(atoms["element"]) * interpolated(F.array(*map(F.lit, COVALENT_SCALE)), resolution)
    found = F.coalesce("r1", "r2")
    return joined.withColumn("radius", F.when(found.isNotNull(), interpolated(found, resolution)).otherwise(scaled)).drop("e1", "q1", "r1", "e2", "r2")
