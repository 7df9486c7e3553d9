"""Omission sampling: what is left out of which map, and who owns which atoms."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from densika.functions.curves import id_key, key_part
from densika.operators.spatial import HYDROGENS

TARGET_MAPS = 50


def validate_sampling(fraction: float, iterations: int | None) -> None:
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must be > 0.0 and < 1.0")
    if iterations is not None and iterations < 1:
        raise ValueError("iterations must be >= 1")


def default_iterations(iterations: int | None, fraction: float) -> int:
    """Enough iterations for about fifty maps, unless told."""
    if iterations is not None:
        return int(iterations)
    return math.ceil(TARGET_MAPS / math.ceil(1 / min(fraction, 1 - fraction)))


def polymer_ids(atoms: DataFrame, mode: str, by: Sequence[str] = ()) -> DataFrame:
    """``(key, ordinal)`` of the polymer's atoms or residues, each once, in the order first seen."""
    parts = ["chain", "resnum", "resname"] + (["atom", "altloc"] if mode == "atoms" else [])
    keyed = atoms.where("record = 'ATOM'").select(*by, id_key(*map(F.col, parts)).alias("key"), "serial")
    return keyed.groupBy(*by, "key").agg(F.min("serial").alias("ordinal"))


def split_always(items: DataFrame, selectors: DataFrame, prefix: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items that a selector names, and the others; by equality, or where ``prefix`` by leading parts."""
    if prefix:
        hit = (items["key"] == selectors["selector"]) | items["key"].startswith(F.concat(selectors["selector"], F.lit("|")))
        named = F.broadcast(selectors)  # typed in by hand
        return items.join(named, hit, "left_semi"), items.join(named, hit, "left_anti")
    keyed = selectors.withColumnRenamed("selector", "key")
    return items.join(keyed, "key", "left_semi"), items.join(keyed, "key", "left_anti")


def parse_selectors(text: str | None) -> list[str]:
    """Comma-separated tuples of words to keys; the second word is a whole number."""
    out = []
    for item in (text or "").split(","):
        words = item.split()
        if words:
            words[1:2] = [str(int(w)) for w in words[1:2]]
            out.append("|".join(words))
    return out


def batch_size(n: int, fraction: float) -> int:
    """Items of a batch, rounded half to even: those left out, or above one half those kept."""
    return max(1, round(n * (fraction if fraction <= 0.5 else 1 - fraction)))


def sample_keys(keys: Sequence[str], always: Sequence[str], fraction: float, iterations: int | None, seed: int | None) -> list[list[str]]:
    """Selections of one crystal, on the driver: the permutations are those of one seeded NumPy generator."""
    validate_sampling(fraction, iterations)
    rounds = default_iterations(iterations, fraction)
    if not keys:
        return [[]]
    named = set(always)
    fixed = [k for k in always if k in set(keys)]
    rest = [k for k in keys if k not in named]
    if not rest:
        return [list(fixed)] * (rounds * math.ceil(1 / min(fraction, 1 - fraction)))
    rng, size, out = np.random.default_rng(seed), batch_size(len(rest), fraction), []
    for _ in range(rounds):
        order = rng.permutation(len(rest))
        for batch in np.split(order, range(size, len(rest), size)):
            if fraction > 0.5:
                away = set(batch.tolist())
                batch = [i for i in range(len(rest)) if i not in away]
            out.append(fixed + [rest[i] for i in batch])
    return out


def sample_crystals(keys: DataFrame, always: Sequence[str], fraction: float, iterations: int | None, seed: int | None, by: str = "stem") -> DataFrame:
    """``(by, map_id, key)``: ``sample_keys`` of each crystal ``(by, key, ordinal)``; a group is one model's parts."""
    validate_sampling(fraction, iterations)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf.sort_values(["ordinal", "key"])["key"].tolist()
        chosen = sample_keys(names, always, fraction, iterations, seed)
        return pd.DataFrame([(key[0], m, k) for m, part in enumerate(chosen) for k in part], columns=[by, "map_id", "key"])

    return keys.groupBy(by).applyInPandas(run, f"`{by}` {keys.schema[by].dataType.simpleString()}, map_id int, key string")


def sample_batches(items: DataFrame, fraction: float, iterations: int, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """``(by, iteration, batch, key)`` for all crystals at once: disjoint batches in the order of ``order``.

    Above one half a batch lists its complement.  ``order`` may use the column ``iteration``.
    """
    many = items.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    group = Window.partitionBy(*by, "iteration")
    share = fraction if fraction <= 0.5 else 1 - fraction
    size = F.greatest(F.lit(1), F.bround(F.count("*").over(group) * F.lit(share)).cast("long"))
    rank = F.row_number().over(group.orderBy(*order)) - 1
    dealt = many.withColumn("batch", F.floor(rank / size))
    if fraction <= 0.5:
        return dealt.select(*by, "iteration", "batch", "key")
    batches = dealt.select(*by, "iteration", F.col("batch").alias("other")).distinct()
    joined = dealt.join(batches, [*by, "iteration"]).where("batch != other")
    return joined.select(*by, "iteration", F.col("other").alias("batch"), "key")


def omission_map(items: DataFrame, selections: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(key, map_ids)`` of every item, sorted; items never omitted have an empty list."""
    listed = selections.groupBy(*by, "key").agg(F.sort_array(F.collect_set(F.col("map_id").cast("int"))).alias("map_ids"))
    return items.select(*by, "key").join(listed, [*by, "key"], "left").withColumn("map_ids", F.coalesce("map_ids", F.array().cast("array<int>")))


def omission_incidence(omissions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return omissions.select(*by, F.col("key").alias("owner"), F.explode("map_ids").alias("map_id"))


def infer_mode(omissions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``mode``: atoms if any residue's atoms have different schedules; keys of fewer than four parts don't count."""
    parts = F.split("key", r"\|")
    residues = omissions.where(F.size(parts) >= 4).withColumn("residue", F.concat_ws("|", F.slice(parts, 1, 2)))
    varied = residues.groupBy(*by, "residue").agg((F.countDistinct(F.sort_array("map_ids")) > 1).alias("varied"))
    return varied.groupBy(*by).agg(F.when(F.coalesce(F.max("varied"), F.lit(False)), "atoms").otherwise("amino_acids").alias("mode"))


def resolve_owners(omissions: DataFrame, atoms: DataFrame, mode: str, by: Sequence[str] = ()) -> DataFrame:
    """``(owner, atom_id, x, y, z, element)``: a key's atoms, unmatched keys left out.

    ``atoms``: the first atom of the name, of the alternative location only if the key has one.
    ``amino_acids``: all atoms but hydrogen of the residue of the number that comes first.
    """
    keys = omissions.select(*by, F.col("key").alias("owner"), key_part(F.col("key"), 0).alias("chain"), key_part(F.col("key"), 1).cast("int").alias("resnum"), key_part(F.col("key"), 3).alias("atom"), key_part(F.col("key"), 4).alias("alt"))
    on = [*by, "chain", "resnum"]
    out = [*by, "owner", "atom_id", "x", "y", "z", "element"]
    if mode == "atoms":
        joined = keys.join(atoms, [*on, "atom"]).where(F.coalesce("alt", F.lit("")).isin("") | (F.col("alt") == F.col("altloc")))
        first = F.row_number().over(Window.partitionBy(*by, "owner").orderBy("atom_id"))
        return joined.withColumn("_n", first).where("_n = 1").select(out)
    joined = keys.drop("atom", "alt").join(atoms, on)
    first = F.first(F.struct("resname", F.coalesce("icode", F.lit("")))).over(Window.partitionBy(*by, "owner").orderBy("atom_id"))
    same = joined.withColumn("_r", first).where(F.col("_r") == F.struct("resname", F.coalesce("icode", F.lit(""))))
    return same.where(F.upper("element") != HYDROGENS[0]).select(out)


def selections_frame(spark: SparkSession, selections: list[list[str]]) -> DataFrame:
    rows = [(m, k) for m, chosen in enumerate(selections) for k in chosen]
    return spark.createDataFrame(rows, "map_id int, key string")
