"""Map ensembles: packing, plain statistics, and the removal of the bias of present and omitted parts.

The working form of a voxel is one row with the array of its values by map.  Everything after packing is
array arithmetic in that row, so an ensemble is shuffled once however many maps it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densika.functions.cell import CellOf, apply
from densika.functions.curves import distance, ratio_or_zero
from densika.operators.spatial import FRACTIONS, XYZ, range_join, symmetry_images, with_values, xyz


def packed(ensemble: DataFrame, keys: Sequence[str], n_maps: int, missing: str = "zero") -> DataFrame:
    """``(keys, map_id, value)`` to ``(keys, vals)`` with the maps 0 .. n_maps-1, by position.

    A missing map is all zero and still counts (``missing="zero"``), or is null and doesn't (``"skip"``); maps
    from ``n_maps`` on are not read.  Several values of a voxel in a map are averaged.
    """
    if missing not in ("zero", "skip"):
        raise ValueError("missing must be 'zero' or 'skip'")
    # Values rarely share voxel and map, so partial sums would save nothing: one shuffle serves both groupings.
    used = ensemble.where((F.col("map_id") >= 0) & (F.col("map_id") < n_maps)).select(*keys, "map_id", "value").repartition(*keys)
    single = used.groupBy(*keys, "map_id").agg(F.avg("value").alias("value"))
    held = single.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("map_id", "value"))).alias("held"))
    by_map = F.transform(F.sequence(F.lit(0), F.lit(n_maps - 1)), lambda m: F.try_element_at(F.col("held"), m))
    vals = F.transform(by_map, lambda v: F.coalesce(v, F.lit(0.0))) if missing == "zero" else by_map
    return held.select(*keys, vals.alias("vals"))


def require_first_map(ensemble: DataFrame) -> None:
    """The first map must be there; the others need not."""
    if ensemble.where("map_id = 0").isEmpty():
        raise FileNotFoundError("map 0 of the ensemble is missing")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_stats(vals: Column) -> Column:
    """Mean, sample deviation (null of fewer than two) and their ratio as a struct; nulls don't count."""

    def spread(x: Column, n: Column, mean: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        return F.struct(mean.alias("mean"), F.when(n > 1, F.sqrt(total / (n - 1))).alias("std"))

    def of(x: Column) -> Column:
        n = F.nullif(F.size(x), F.lit(0))
        return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n, lambda mean: spread(x, n, mean))

    return let(F.filter(vals, lambda v: v.isNotNull()), of)


def stats(voxels: DataFrame, keys: Sequence[str], vals: str = "vals") -> DataFrame:
    out = voxels.select(*keys, array_stats(F.col(vals)).alias("stats")).select(*keys, "stats.mean", "stats.std")
    return out.withColumn("snr", ratio_or_zero(F.col("mean"), F.col("std")))


def _total(vals: Column) -> Column:
    """Sum and number of the maps that are there."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(vals, start, lambda a, v: F.struct((a["sum"] + F.coalesce(v, F.lit(0.0))).alias("sum"), (a["n"] + v.isNotNull().cast("int")).alias("n")))


def owner_bias(vals: Column, omitted: Column, total: Column | None = None) -> Column:
    """Mean of the maps with the part present less that of those without; 0 if either is empty."""
    if total is None:
        return let(_total(vals), lambda t: owner_bias(vals, omitted, t))

    def of(without: Column) -> Column:
        n, n0 = total["n"], without["n"]
        return F.when((n0 > 0) & (n0 < n), (total["sum"] - without["sum"]) / (n - n0) - without["sum"] / n0).otherwise(F.lit(0.0))

    return let(_total(F.transform(omitted, lambda m: F.get(vals, m))), of)


def schedules(omission: DataFrame, n_maps: int, keys: Sequence[str] = ("owner",)) -> DataFrame:
    """``(owner, map_id)`` to ``(owner, omitted)``: distinct maps in [0, n_maps)."""
    used = omission.where((F.col("map_id") >= 0) & (F.col("map_id") < n_maps))
    return used.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col("map_id").cast("int"))).alias("omitted"))


def with_omissions(voxels: DataFrame, owners: DataFrame, omission: DataFrame, keys: Sequence[str], n_maps: int) -> DataFrame:
    """Adds ``omits``, an array of owner and omitted maps; an owner without schedule is never omitted."""
    joined = owners.join(schedules(omission, n_maps), "owner", "left")
    joined = joined.withColumn("omitted", F.coalesce("omitted", F.array().cast("array<int>")))
    listed = joined.groupBy(*keys).agg(F.collect_list(F.struct("owner", "omitted")).alias("omits"))
    empty = F.array().cast(listed.schema["omits"].dataType)
    return voxels.join(listed, list(keys), "left").withColumn("omits", F.coalesce("omits", empty))


def with_schedules(voxels: DataFrame, owners: DataFrame, omission: DataFrame, keys: Sequence[str], n_maps: int) -> DataFrame:
    """Adds ``omits``, an array of omitted maps and of how many distinct owners share that schedule.

    Owners of one schedule have one bias, and those without any have none: both are counted before they are shuffled.
    """
    shared = owners.join(schedules(omission, n_maps), "owner").groupBy(*keys, "omitted").agg(F.count("*").alias("n"))
    listed = shared.groupBy(*keys).agg(F.collect_list(F.struct("omitted", "n")).alias("omits"))
    empty = F.array().cast(listed.schema["omits"].dataType)
    return voxels.join(listed, list(keys), "left").withColumn("omits", F.coalesce("omits", empty))


def cleaned(vals: Column, omits: Column) -> Column:
    """Values less the biases of the parts present in each map; ``omits`` are those of ``with_schedules``.

    All biases are taken off at once, and those of the parts omitted from a map are put back: only the sparse
    omissions are looked at, not the matrix of parts by maps.
    """

    def of(biases: Column, everything: Column) -> Column:
        def back(m: Column) -> Column:
            return F.aggregate(biases, F.lit(0.0), lambda a, x: a + F.when(F.array_contains(x["z"], m), x["b"]).otherwise(F.lit(0.0)))

        return F.transform(vals, lambda v, m: v - everything + back(m))

    def summed(biases: Column) -> Column:
        # A part whose bias is 0 is never put back.
        return let(F.aggregate(biases, F.lit(0.0), lambda a, x: a + x["b"]), lambda everything: of(F.filter(biases, lambda x: x["b"] != 0), everything))

    def found(total: Column) -> Column:
        return F.transform(omits, lambda o: F.struct((owner_bias(vals, o["omitted"], total) * o["n"]).alias("b"), o["omitted"].alias("z")))

    return let(let(_total(vals), found), summed)


def bias_table(voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, owner, bias)`` of voxels that have ``omits``."""
    out = voxels.select(*keys, "vals", F.explode("omits").alias("o"))
    return out.select(*keys, "o.owner", owner_bias(F.col("vals"), F.col("o.omitted")).alias("bias"))


def quantify(ensemble: DataFrame, owners: DataFrame | None, omission: DataFrame | None, keys: Sequence[str], n_maps: int, missing: str = "zero") -> DataFrame:
    """``(keys, mean, std, snr)`` of every voxel; without owners the plain statistics.  ``ensemble`` may be ``packed`` already."""
    voxels = ensemble if "vals" in ensemble.columns else packed(ensemble, keys, n_maps, missing)
    if owners is None or omission is None:
        return stats(voxels, keys)
    voxels = with_schedules(voxels, owners, omission, keys, n_maps)
    return stats(voxels.withColumn("vals", F.when(F.size("omits") > 0, cleaned(F.col("vals"), F.col("omits"))).otherwise(F.col("vals"))), keys)


def map_statistics(grid: DataFrame, by: Sequence[str] = (), mean: float | None = None, sigma: float | None = None) -> DataFrame:
    """``mean`` and population ``sigma`` (1 where it is 0) of maps, or what is given instead."""
    m = F.lit(mean) if mean is not None else F.avg("value")
    spread = F.stddev_pop("value")
    s = F.lit(sigma) if sigma is not None else F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return grid.groupBy(*by).agg(m.alias("mean"), s.alias("sigma"))


def null_points(crystals: DataFrame, n: int = 20_000, seed: int = 0, by: str = "stem") -> DataFrame:
    """``(by, id, fa, fb, fc)``: standard normal fractional coordinates of each crystal.

    They follow from hashes of crystal, number and seed, and so are the same however the rows are dealt.
    """

    def uniform(k: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.col(by).cast("string"), "id", F.lit(seed), F.lit(k)), 11)
        return (bits + 0.5) * 2.0**-53

    def normal(k: int) -> Column:
        return F.sqrt(F.log(uniform(2 * k)) * -2.0) * F.cos(uniform(2 * k + 1) * (2.0 * math.pi))

    numbered = crystals.select(by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("id"))
    return numbered.select(by, "id", *[normal(k).alias(c) for k, c in enumerate(FRACTIONS)])


def outside_model(points: DataFrame, atoms: DataFrame, crystals: DataFrame, probe: float = 1.1, shrink: float = 0.9, by: str = "stem") -> DataFrame:
    """Points ``(by, id, fa, fb, fc)`` that none of the model's images reaches.

    ``atoms`` have ``vdw``, their van der Waals radius; a point is in an atom's reach within that and the probe's
    radius less what the solvent takes back.
    """
    images, most = _images(atoms, crystals, probe - shrink, by)
    inside = [F.col(f) - F.floor(f) for f in FRACTIONS]
    wrapped = points.join(crystals.select(by, "orth"), by)
    wrapped = wrapped.select(by, "id", *[c.alias(n) for n, c in zip(XYZ, apply(CellOf().orthogonal(), tuple(inside)), strict=True)])
    near = range_join(wrapped, images, most, [by])
    hit = near.where(distance(xyz("a_"), xyz("b_")) <= F.col("b_vdw") + (probe - shrink))
    return points.join(hit.select(F.col(f"a_{by}").alias(by), F.col("a_id").alias("id")).distinct(), [by, "id"], "left_anti")


def _images(atoms: DataFrame, crystals: DataFrame, beyond: float, by: str) -> tuple[DataFrame, float]:
    """Images ``(by, vdw, x, y, z)`` of the model that may reach the unit cell, and the largest reach."""
    most = max(0.1, (atoms.agg(F.max("vdw")).first()[0] or 0.0) + beyond)
    return symmetry_images(atoms.select(by, "vdw", *XYZ), crystals, most, [by]).select(by, "vdw", *XYZ), most


_NODE = ["ni", "nj", "nk"]


def bulk_solvent(points: DataFrame, atoms: DataFrame, crystals: DataFrame, probe: float = 1.1, shrink: float = 0.9, spacing: float = 0.5, by: str = "stem") -> DataFrame:
    """Points ``(by, id, fa, fb, fc)`` in the solvent that a probe reaches, and what the solvent takes back around it.

    On a periodic grid of ``spacing`` or finer a node is free if the probe's centre may be there, further from all images
    than van der Waals radius and probe.  Solvent are the free nodes and those within ``shrink`` of a free one, so that a
    gap in which no probe fits is none, whatever the distance to its walls.  A point is kept where all nodes around it
    are solvent.  Only nodes around points are looked at, and further ones only around those that the first pass
    leaves open: within the probe of an atom, but not so near that no free node can be within ``shrink``.
    """
    images, most = _images(atoms, crystals, probe, by)
    sizes = [F.ceil(F.get("edges", F.lit(a)) / spacing).cast("int") for a in range(3)]
    told = crystals.select(by, "orth", "frac", F.array(*sizes).alias("sizes"))
    n = [F.get("sizes", F.lit(a)) for a in range(3)]
    around = points.select(by, "id", *FRACTIONS).join(told.select(by, "sizes"), by)
    for f, k, size in zip(FRACTIONS, _NODE, n, strict=True):
        low = F.floor(F.col(f) * size)
        around = around.withColumn(k, F.explode(F.when(F.col(f) * size > low, F.array(low, low + 1)).otherwise(F.array(low)))).withColumn(k, F.pmod(k, size).cast("int"))
    around = around.select(by, "id", *_NODE)

    def classified(nodes: DataFrame) -> DataFrame:
        """``free``, or ``lost``, or neither."""
        at = nodes.join(told, by)
        place = apply(CellOf().orthogonal(), tuple(F.col(k) / size for k, size in zip(_NODE, n, strict=True)))
        at = at.select(by, *_NODE, *[c.alias(x) for x, c in zip(XYZ, place, strict=True)])
        gap = distance(xyz("a_"), xyz("b_")) - F.col("b_vdw")
        met = range_join(at, images, most, [by]).select(*[F.col(f"a_{k}").alias(k) for k in (by, *_NODE)], gap.alias("gap")).where(F.col("gap") <= probe)
        least = met.groupBy(by, *_NODE).agg(F.min("gap").alias("gap"))
        both = nodes.join(least, [by, *_NODE], "left")
        return both.select(by, *_NODE, F.col("gap").isNull().alias("free"), (F.col("gap") <= probe - shrink).alias("lost"))

    first = classified(around.select(by, *_NODE).distinct())
    open_ = first.where("not free and not lost").select(by, *_NODE)
    # Offsets within reach are found once a crystal; nodes take only those.
    steps = told
    for a, size in enumerate(n):
        row = [F.get("frac", F.lit(3 * a + c)) for c in range(3)]
        reach = F.ceil(F.sqrt(sum((x * x for x in row[1:]), row[0] * row[0])) * shrink * size)
        steps = steps.withColumn(f"_d{a}", F.explode(F.sequence(-reach, reach)))
    away = apply(CellOf().orthogonal(), tuple(F.col(f"_d{a}") / size for a, size in enumerate(n)))
    steps = steps.where(sum((c * c for c in away[1:]), away[0] * away[0]) <= shrink * shrink)
    steps = steps.groupBy(by).agg(F.first("sizes").alias("sizes"), F.collect_list(F.struct("_d0", "_d1", "_d2")).alias("steps"))
    beside = open_.join(steps, by).select(by, *_NODE, "sizes", F.explode("steps").alias("step"))
    beside = beside.select(by, *_NODE, *[F.pmod(F.col(k) + F.col(f"step._d{a}"), size).cast("int").alias(f"o{k}") for a, (k, size) in enumerate(zip(_NODE, n, strict=True))])
    others = beside.select(by, *[F.col(f"o{k}").alias(k) for k in _NODE]).distinct()
    free = classified(others).where("free").select(by, *[F.col(k).alias(f"o{k}") for k in _NODE])
    back = beside.join(free, [by, *[f"o{k}" for k in _NODE]], "left_semi").select(by, *_NODE).distinct()
    bad = first.where("not free").select(by, *_NODE).join(back, [by, *_NODE], "left_anti")
    return points.join(around.join(bad, [by, *_NODE], "left_semi").select(by, "id").distinct(), [by, "id"], "left_anti")


def null_samples(points: DataFrame, grid: DataFrame, crystals: DataFrame, by: str = "stem") -> DataFrame:
    """``(by, id, snr)``: the map ``(by, i, j, k, value)`` at the points, by trilinear interpolation."""
    fine = 1 << 20  # points as nodes of a grid so much finer
    dims = tuple(F.get("dims", F.lit(i)) for i in range(3))
    at = points.join(crystals.select(by, "dims"), by)
    at = at.select(by, "id", "dims", *[F.round(F.col(f) * n * fine).cast("long").alias(u) for u, f, n in zip("uvw", FRACTIONS, dims, strict=True)])
    sized = grid.join(crystals.select(by, "dims"), by)
    return with_values(at, sized, dims, (fine, fine, fine), [by]).select(by, "id", F.col("value").alias("snr"))
