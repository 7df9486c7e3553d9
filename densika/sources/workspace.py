"""Experiment folders: discovery, derived paths, and the choice among candidate files.

Listings are tables ``(stem, path)``, whether of a local folder or of an object store, so that choices are
joins and minima over all experiments at once.
"""

from __future__ import annotations

import json
import logging
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from glob import escape
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from densika.sources.files import local_path, write_groups

log = logging.getLogger(__name__)
MODEL_EXTENSIONS = (".pdb", ".cif")


@dataclass(frozen=True)
class Experiment:
    """One crystal's folder; ``files`` are the paths below it that a listing found, else the folder itself is looked into."""

    stem: str
    root: Path
    files: frozenset[str] | None = None

    def has(self, name: str) -> bool:
        return (self.root / name).is_file() if self.files is None else name in self.files

    def matching(self, pattern: str) -> list[Path]:
        """Sorted files below the folder; a ``*`` stays within one part of the path."""
        if self.files is None:
            return sorted(p for p in self.root.glob(pattern) if p.is_file())
        parts = pattern.split("/")
        fits = (f for f in self.files if f.count("/") == len(parts) - 1 and all(map(fnmatchcase, f.split("/"), parts)))
        return sorted(self.root / f for f in fits)

    @property
    def processed(self) -> Path:
        named = [f"processed/{self.stem}_updated{e}" for e in MODEL_EXTENSIONS]
        return self.root / next((n for n in named if self.has(n)), named[0])

    @property
    def original(self) -> Path | None:
        named = [self.root / f"{self.stem}{e}" for e in MODEL_EXTENSIONS if self.has(f"{self.stem}{e}")]
        return next(iter([*named, *(p for e in MODEL_EXTENSIONS for p in self.matching(f"*{e}"))]), None)

    @property
    def omission_json(self) -> Path:
        return self.root / "metadata" / f"{self.stem}_omission_map.json"

    @property
    def quantify_dir(self) -> Path:
        return self.root / "quantify_results"

    def map_files(self, cap: int | None) -> dict[int, Path]:
        """The maps there are, by number, below ``cap``."""
        found = {}
        for path in self.matching(f"results/{escape(self.stem)}_*/{escape(self.stem)}_*.mtz"):
            number = path.stem.removeprefix(f"{self.stem}_")
            if number.isdigit() and path.parent.name == path.stem and (cap is None or int(number) < cap):
                found[int(number)] = path
        return found

    def null_json(self, k: float, cap: int) -> Path:
        return self.root / "metadata" / f"{self.stem}_null_params_k{k}_cap{cap}.json"

    def missing(self) -> list[Path]:
        return [p for p in (self.processed, self.omission_json) if not self.has(p.relative_to(self.root).as_posix())]


def listing(spark: SparkSession, root: str | Path) -> DataFrame:
    """``(path, below, size)`` of all files under ``root`` through Spark's file source: no contents are read."""
    top = str(root) if ":/" in str(root) else os.path.abspath(root)
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top).select("path", "length")
    except AnalysisException as fault:
        if "PATH_NOT_FOUND" not in str(fault):
            raise
        return spark.createDataFrame([], "path string, below string, size long")
    plain = F.regexp_replace("path", "^file:/+", "/")  # here names aren't encoded
    start = re.sub("^file:/+", "/", top).rstrip("/")
    return found.select(plain.alias("path"), F.substring(plain, F.lit(len(start) + 2), F.length(plain)).alias("below"), F.col("length").alias("size"))


def experiments(spark: SparkSession, root: str | Path) -> list[Experiment]:
    """The folder itself if it is an experiment, else those of its sub-folders that are; others are warned of.

    Files are listed and gathered by folder on the cluster; the driver gets a row a crystal.
    """
    top, rows = Path(root), listing(spark, root)
    inner = F.substring_index("below", "/", 1)
    own = rows.where(F.col("below").startswith("processed/") | F.col("below").startswith("metadata/")).select("below")
    here = Experiment(top.name, top, frozenset(r.below for r in own.where(F.col("below").contains(f"/{top.name}_updated.") | F.col("below").endswith("_omission_map.json")).toLocalIterator()))
    if not here.missing():
        return [Experiment(top.name, top, frozenset(r.below for r in rows.select("below").toLocalIterator()))]
    folders = rows.where("below like '%/%'").groupBy(inner.alias("folder")).agg(F.collect_list(F.substring("below", F.length(inner) + 2, F.length("below"))).alias("files"))
    out = []
    for r in folders.orderBy("folder").toLocalIterator():
        found = Experiment(r.folder, top / r.folder, frozenset(r.files))
        if gone := found.missing():
            log.warning("%s is no experiment: %s missing", found.root, ", ".join(map(str, gone)))
        else:
            out.append(found)
    return out


def find_experiments(path: str | Path) -> Iterator[Experiment]:
    """``experiments`` of a local folder, without a session."""
    root = Path(path)
    own = Experiment(root.name, root)
    if (root / "processed").is_dir() and not own.missing():
        yield own
        return
    for folder in sorted(p for p in root.iterdir() if p.is_dir()):
        found = Experiment(folder.name, folder)
        if gone := found.missing():
            log.warning("%s is no experiment: %s missing", folder, ", ".join(map(str, gone)))
        else:
            yield found


def experiments_frame(spark: SparkSession, path: str | Path) -> DataFrame:
    """``experiments`` as a table, with an empty original where there is none; a screen's folders don't pass the driver."""
    rows, top, schema = listing(spark, path), str(Path(path)), "stem string, root string, processed_pdb string, original_pdb string, omission_json string"
    if not rows.where(F.col("below").startswith("processed/") | F.col("below").startswith("metadata/")).isEmpty():
        return spark.createDataFrame([(e.stem, str(e.root), str(e.processed), str(e.original or ""), str(e.omission_json)) for e in experiments(spark, path)], schema)
    inner = F.substring_index("below", "/", 1)
    files = rows.where("below like '%/%'").select(inner.alias("stem"), F.substring("below", F.length(inner) + 2, F.length("below")).alias("name"))

    def there(start: str, end: str) -> Column:
        name = F.concat(F.lit(start), "stem", F.lit(end))
        return F.max(F.when(F.col("name") == name, name))

    def least(end: str) -> Column:
        return F.min(F.when(F.col("name").endswith(end) & ~F.col("name").contains("/"), F.col("name")))

    found = files.groupBy("stem").agg(
        F.coalesce(*[there("processed/", f"_updated{e}") for e in MODEL_EXTENSIONS]).alias("processed"), there("metadata/", "_omission_map.json").alias("omission"),
        F.coalesce(*[there("", e) for e in MODEL_EXTENSIONS], *map(least, MODEL_EXTENSIONS)).alias("original"),
    )
    root = F.concat(F.lit(f"{top}/"), "stem")
    placed = [F.coalesce(F.concat(root, F.lit("/"), c), F.lit("")).alias(n) for c, n in (("processed", "processed_pdb"), ("original", "original_pdb"), ("omission", "omission_json"))]
    return found.where("processed is not null and omission is not null").select("stem", root.alias("root"), *placed)


def map_name(path: Column) -> list[Column]:
    """``stem`` and ``map_id`` of a map's file name."""
    name = local_path(path)
    return [F.regexp_extract(name, r"([^/]*)_[0-9]+[.]mtz$", 1).alias("stem"), F.regexp_extract(name, r"_([0-9]+)[.]mtz$", 1).cast("int").alias("map_id")]


def map_keys() -> dict[str, Column]:
    """``stem`` and ``map_id`` of a map's ``path``, for readers that work them out once a file."""
    return dict(zip(("stem", "map_id"), map_name(F.col("path")), strict=True))


def read_null_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(stem, path, k, cap, df, loc, scale)`` of files of null parameters."""
    raw = spark.read.text(paths, wholetext=True).select(local_path(F.col("_metadata.file_path")).alias("path"), F.from_json("value", "df double, loc double, scale double").alias("p"))
    pattern = r"([^/]*)_null_params_k([0-9.]+)_cap([0-9]+)[.]json$"
    return raw.select(F.regexp_extract("path", pattern, 1).alias("stem"), "path", F.regexp_extract("path", pattern, 2).cast("double").alias("k"), F.regexp_extract("path", pattern, 3).cast("int").alias("cap"), "p.*")


def read_omissions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, key, map_ids)`` of omission files, each one JSON object of lists."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    held = raw.select("path", F.from_json("value", "map<string,array<int>>").alias("m"))
    return held.select("path", F.explode("m").alias("key", "map_ids"))


def omission_faults(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, error)`` of omission files that are no JSON object of lists of whole numbers."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "map<string,array<int>>").alias("m"))
    odd = F.exists(F.map_values("m"), lambda ids: ids.isNull() | F.exists(ids, lambda i: i.isNull()))
    return raw.where(F.col("m").isNull() | odd).select("path", F.lit("unreadable omission file").alias("error"))


def omission_bytes(pdf: pd.DataFrame) -> bytes:
    """One crystal's rows ``(key, map_ids)`` as its file holds them."""
    return json.dumps({k: [int(m) for m in ids] for k, ids in sorted(zip(pdf["key"], pdf["map_ids"], strict=True))}).encode()


def write_omissions(omissions: DataFrame, path: str | Path) -> None:
    """One crystal's omission file; its size is that of one model."""
    place = os.path.abspath(path)
    write_groups(omissions.select(F.lit(place).alias("path"), "key", "map_ids"), omission_bytes, os.path.dirname(place))


def chosen_maps(listing: DataFrame, k: float, cap: int | None) -> DataFrame:
    """Of ``(stem, path)`` the map of the asked cap, else that of the highest, else the one of k 1.0 and cap 50.

    Names hold ``k_<k>_cap_<cap>``; caps are compared as numbers.
    """
    named = listing.withColumn("k", F.regexp_extract("path", r"k_([0-9.]+)_cap_", 1).try_cast("double")).withColumn("cap", F.regexp_extract("path", r"_cap_([0-9]+)", 1).try_cast("int"))
    wanted = (F.col("k") == k) & (F.lit(True) if cap is None else F.col("cap") == cap)
    usual = (F.col("k") == 1.0) & (F.col("cap") == 50)
    rank = F.when(wanted, 0).when(usual, 1)
    order = Window.partitionBy("stem").orderBy("rank", F.col("cap").desc(), "path")
    out = named.withColumn("rank", rank).where("rank is not null").withColumn("n", F.row_number().over(order))
    return out.where("n = 1").select("stem", "path", "k", "cap")


def require_maps(experiments: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``path``, and ``error`` where there is none."""
    joined = experiments.join(chosen.select("stem", "path"), "stem", "left")
    return joined.withColumn("error", F.when(F.col("path").isNull(), F.concat(F.lit("no map found for "), "stem")))


def null_parameters(candidates: DataFrame, k: float, cap: int) -> DataFrame:
    """Of ``(stem, path, k, cap, df, loc, scale)`` the exact one of each stem, else the first by path."""
    exact = (F.col("k") == k) & (F.col("cap") == cap)
    best = F.min_by(F.struct("df", "loc", "scale", exact.alias("exact")), F.struct((~exact).alias("o"), "path"))
    return candidates.groupBy("stem").agg(best.alias("p")).select("stem", "p.*")


def first_label(columns: DataFrame, pairs: list[tuple[str, str]], singles: list[str]) -> DataFrame:
    """Of ``(crystal, label)``: the first pair with both labels present, and the first single one."""
    names = columns.groupBy("crystal").agg(F.collect_set("label").alias("has"))
    pair = F.coalesce(*[F.when(F.array_contains("has", a) & F.array_contains("has", b), F.lit(f"{a},{b}")) for a, b in pairs])
    single = F.coalesce(*[F.when(F.array_contains("has", s), F.lit(s)) for s in singles])
    faults = F.concat_ws("; ", F.when(F.col("f_label").isNull(), "no amplitude pair found"), F.when(F.col("rfree_label").isNull(), "no free-set column found"))
    out = names.select("crystal", pair.alias("f_label"), single.alias("rfree_label"))
    return out.withColumn("error", F.nullif(faults, F.lit("")))


#: Amplitude pairs and free-set labels, in order of priority.
AMPLITUDES = [
    ("F-obs-filtered", "SIGF-obs-filtered"), ("F-obs", "SIGF-obs"), ("FP", "SIGFP"), ("FOBS", "SIGFOBS"), ("Fobs", "SIGFobs"),
    ("F", "SIGF"), ("FTOT", "SIGTOT"), ("IMEAN", "SIGIMEAN"), ("I", "SIGI"), ("IOBS", "SIGIOBS"),
]
FREE_SETS = ["FreeR_flag", "FREE", "FREER", "R-free-flags", "Status"]


def common_prefix(paths: DataFrame, column: str = "path") -> DataFrame:
    """The longest common folder, ``prefix``; counts by depth, so that no path is gathered."""
    parts = paths.select(F.split(column, "/").alias("p")).select(F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("depth", "part"))
    total = paths.select(F.count("*").alias("n"))
    same = parts.groupBy("depth").agg(F.min("part").alias("part"), F.max("part").alias("other"), F.count("*").alias("n"))
    good = same.join(F.broadcast(total.withColumnRenamed("n", "all")), F.lit(True))  # one row
    held = good.withColumn("ok", (F.col("part") == F.col("other")) & (F.col("n") == F.col("all")))
    broken = F.min(F.when(~F.col("ok"), F.col("depth")))
    listed = F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("depth", "part"))))
    out = held.agg(broken.alias("b"), listed.alias("l"))
    return out.select(F.array_join(F.transform(F.filter("l", lambda x: F.col("b").isNull() | (x["depth"] < F.col("b"))), lambda x: x["part"]), "/").alias("prefix"))


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("sep", "|").schema("id string, model string, reflections string").csv(path)


def maps_by_suffix(listing: DataFrame, suffix: str) -> DataFrame:
    """``(stem, paths)``: the sorted map files of each experiment whose names end in ``_<suffix>.ccp4``."""
    return listing.where(F.col("path").endswith(f"_{suffix}.ccp4")).groupBy("stem").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def original_reflections(experiments: DataFrame, manifest: DataFrame, parsed: DataFrame) -> DataFrame:
    """``(stem, reflections)``: by the manifest's model name, else by the parameters ``(stem, value)`` of a job."""
    named = manifest.select(F.regexp_extract("model", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.col("reflections").alias("listed")).groupBy("stem").agg(F.min("listed").alias("listed"))
    written = parsed.groupBy("stem").agg(F.min("value").alias("written"))
    out = experiments.select("stem").join(named, "stem", "left").join(written, "stem", "left")
    return out.select("stem", F.coalesce("listed", "written").alias("reflections"))


def write_null_parameters(params: dict[str, float], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({k: float(params[k]) for k in ("df", "loc", "scale")}), encoding="utf-8")


def read_null_parameters(path: str | Path) -> dict[str, float] | None:
    return json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else None


def layout(root: str | Path, crystals: list[str]) -> list[tuple[str, str | None]]:
    """Folders of each crystal; one that can't be made is reported and doesn't stop the others."""
    out = []
    for name in crystals:
        try:
            for part in ("processed", "metadata", "params", "results", "quantify_results", "analyse_results"):
                (Path(root) / name / part).mkdir(parents=True, exist_ok=True)
            out.append((name, None))
        except OSError as fault:
            out.append((name, str(fault)))
    return out


def layouts(names: DataFrame, root: str | Path) -> DataFrame:
    """``layout`` of the crystals ``stem``, by the tasks that have their names: ``(stem, error)`` of those that can't be made."""
    place = str(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for x in layout(place, pdf["stem"].tolist()) if x[1]], columns=["stem", "error"]).astype(object)

    return names.select("stem").mapInPandas(run, "stem string, error string")
