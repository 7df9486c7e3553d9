"""Inputs of the operators derived from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densika.runtime import visible

N_MAPS = 7
DIMS, SPACING = (40, 40, 40), 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return visible(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("voxel"), (F.col("l_linenumber") - 1).alias("map_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))


ENS = "ens AS (SELECT l_partkey AS voxel, l_linenumber - 1 AS map_id, avg(l_extendedprice / l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("voxel"), F.col("l_suppkey").alias("owner")).distinct()


OWNS = "owns AS (SELECT DISTINCT l_partkey AS voxel, l_suppkey AS owner FROM lineitem)"


def omission(spark: SparkSession, sf_dir: str, n_maps: int = N_MAPS) -> DataFrame:
    maps = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("owner"), F.explode(F.sequence(F.lit(0), F.lit(n_maps - 1))).alias("map_id"))
    return maps.where((F.col("owner") + 3 * F.col("map_id")) % 5 == 0)


def omission_sql(n_maps: int = N_MAPS) -> str:
    return f"omission AS (SELECT s_suppkey AS owner, m AS map_id FROM supplier, (SELECT unnest(range(0, {n_maps})) AS m) WHERE (s_suppkey + 3 * m) % 5 = 0)"


OMISSION = omission_sql()


def many_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ensemble of 50 maps of few voxels."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_partkey") % 200).alias("voxel"), (F.col("l_orderkey") % 50).cast("int").alias("map_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))


def many_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("voxel"), (F.col("l_suppkey") % 10).alias("owner")).distinct()


MANY = "ens AS (SELECT l_partkey % 200 AS voxel, l_orderkey % 50 AS map_id, avg(l_extendedprice / l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
MANY_OWNS = "owns AS (SELECT DISTINCT l_partkey % 200 AS voxel, l_suppkey % 10 AS owner FROM lineitem)"

ELEMENTS = ("C", "N", "O", "S", "P", "Cl", "Mg", " c", "Zz", "H")


def atoms(spark: SparkSession, sf_dir: str, scale: float) -> DataFrame:
    """Positions from three components; residues of eight, of which one kind is the ligand and one water."""
    v = table(spark, sf_dir, "embeddings")
    res = F.floor(F.col("vec_id") / 8)
    name = F.when(res % 10 == 9, "HOH").when(res % 10 == 8, "LIG").when(res % 3 == 0, "ALA").when(res % 3 == 1, "GLY").otherwise("SER")
    return v.select(
        F.col("vec_id").alias("atom_id"), F.element_at(F.array(*map(F.lit, "ABC")), (res % 3 + 1).cast("int")).alias("chain"),
        res.cast("int").alias("resnum"), name.alias("resname"), F.lit("").alias("icode"), F.lit("").alias("altloc"),
        F.element_at(F.array(*map(F.lit, ELEMENTS)), F.col("label") + 1).alias("element"), F.lit(0).alias("charge"), F.col("label"),
        *[(F.element_at("embedding", i + 1).cast("double") * F.lit(float(scale))).alias(c) for i, c in enumerate("xyz")],
    )


def atoms_sql(scale: float, name: str = "atoms") -> str:
    xyz = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * CAST({scale} AS DOUBLE) AS {c}" for i, c in enumerate("xyz"))
    elements = "[" + ", ".join(f"'{e}'" for e in ELEMENTS) + "]"
    return f"""{name} AS (SELECT vec_id AS atom_id, ['A', 'B', 'C'][(vec_id // 8) % 3 + 1] AS chain, CAST(vec_id // 8 AS INTEGER) AS resnum,
  CASE WHEN (vec_id // 8) % 10 = 9 THEN 'HOH' WHEN (vec_id // 8) % 10 = 8 THEN 'LIG' WHEN (vec_id // 8) % 3 = 0 THEN 'ALA' WHEN (vec_id // 8) % 3 = 1 THEN 'GLY' ELSE 'SER' END AS resname,
  {elements}[label + 1] AS element, label, {xyz} FROM embeddings)"""


def grid(spark: SparkSession) -> DataFrame:
    n = DIMS[0] * DIMS[1] * DIMS[2]
    i, j, k = F.floor(F.col("id") / (DIMS[1] * DIMS[2])), F.floor(F.col("id") / DIMS[2]) % DIMS[1], F.col("id") % DIMS[2]
    at = spark.range(n).select(i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"))
    return at.withColumn("value", ((7 * F.col("i") + 13 * F.col("j") + 17 * F.col("k")) % 101) / 20.0)


#: The grid's value at wrapped indices is arithmetic, so SQL needs no join.
def grid_value(u: str, v: str, w: str) -> str:
    return f"((7 * ({u}) + 13 * ({v}) + 17 * ({w})) % 101) / CAST(20.0 AS DOUBLE)"


def step_case(element: str, level: int) -> str:
    """A radius of the step table at one level, as CASE."""
    from densika.functions.radii import STEP_RADII

    name = f"upper(trim({element}))"
    return f"CASE {name} " + " ".join(f"WHEN '{e}' THEN CAST({r[level]} AS DOUBLE)" for e, r in STEP_RADII.items()) + f" ELSE CAST({STEP_RADII['C'][level]} AS DOUBLE) END"


def covalent_case(element: str) -> str:
    from densika.functions.radii import COVALENT, UNKNOWN_COVALENT

    return f"CASE upper(trim({element})) " + " ".join(f"WHEN '{e}' THEN CAST({r} AS DOUBLE)" for e, r in COVALENT.items()) + f" ELSE CAST({UNKNOWN_COVALENT} AS DOUBLE) END"
