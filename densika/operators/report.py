"""Ligand neighbourhoods, screen-wide assembly, ranking and rendering."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from densika.functions.curves import badge, colour, safe_float, safe_int
from densika.operators.scoring import WATERS
from densika.operators.spatial import HYDROGENS, bounding_box, groups_near, symmetry_images
from densika.sources import maps, parameters
from densika.sources.files import local_path, put, write_groups
from densika.sources.structures import IMAGES, read_structures, read_symmetry
from densika.sources.workspace import Experiment, map_name, maps_by_suffix, original_reflections, read_manifest

#: Names of amino acids.
AMINO = (
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS",
    "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "SEC", "PYL", "MSE",
)
#: Badge bounds, green and yellow.
OPIA_BADGE, SCORE_BADGE = (0.8, 0.6), (0.7, 0.4)


def category(resname: Column) -> Column:
    name = F.upper(resname)
    return F.when(name.isin(*WATERS), "water").when(name.isin(*AMINO), "protein").otherwise("other_solvent")


def _heavy(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.upper(F.trim("element")).isin(*HYDROGENS))


def ligand_neighbours(atoms: DataFrame, radius: float = 10.0, ligand: str = "LIG", by: Sequence[str] = (), crystals: DataFrame | None = None) -> DataFrame:
    """Distinct ``(chain, resnum, resname, category)`` with a heavy atom within ``radius`` of a ligand's.

    With ``crystals``, those of ``symmetry_images``, an image of either counts too; a crystal that is not among them has none.
    """
    heavy = _heavy(atoms).select(*by, "chain", "resnum", "resname", "x", "y", "z")
    is_ligand = F.upper("resname") == ligand.upper()
    around = heavy.where(is_ligand).select(*by, "x", "y", "z")
    if crystals is not None:
        # Ligands are few: theirs are the images, brought to where the model's atoms are.
        images = symmetry_images(around, crystals, radius, by, bounding_box(heavy.where(~is_ligand), crystals, by))
        around = around.unionByName(images.select(*by, "x", "y", "z"))
    near = groups_near(heavy.where(~is_ligand), around, radius, [*by, "chain", "resnum", "resname"], by)
    return near.withColumn("category", category(F.col("resname")))


def neighbour_counts(near: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return near.groupBy(*by).agg(*[F.count_if(F.col("category") == c).alias(n) for c, n in (("protein", "n_protein"), ("water", "n_water"), ("other_solvent", "n_other"))])


def neighbour_lists(near: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``neighbours``: the residues around, sorted by chain and number; as many as fit around a ligand."""
    return near.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chain", "resnum", "resname", "category"))).alias("neighbours"))


def ligand_centroid(atoms: DataFrame, ligand: str = "LIG", by: Sequence[str] = ()) -> DataFrame:
    """Centre of the heavy ligand atoms, their number, and the chain and number of the last ligand residue."""
    own = _heavy(atoms).where(F.upper("resname") == ligand.upper())
    last = F.max_by(F.struct("chain", "resnum"), "atom_id")
    return own.groupBy(*by).agg(
        F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy"), F.round(F.avg("z"), 3).alias("cz"),
        F.count("*").alias("n_atoms"), last["chain"].alias("lig_chain"), last["resnum"].alias("lig_seqid"),
    )


def ligand_scores(residues: DataFrame, scores: DataFrame, ligand: str = "LIG", by: Sequence[str] = ()) -> DataFrame:
    """The first ligand residue's score with all ligand atoms, as a sorted list with the colours of their scores."""
    own = [c for c in ("chain", "resnum", "atom") if c in scores.columns]
    first = residues.where(F.upper("resname") == ligand.upper()).groupBy(*by).agg(F.min_by("residue_score", F.struct("chain", "resnum", "icode")).alias("residue_score"))
    atoms = scores.where(F.upper("resname") == ligand.upper()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("atom_id", "score", colour(F.col("score")).alias("colour"), *own))).alias("atoms"))
    return first.join(atoms, list(by), "full") if by else first.crossJoin(atoms)  # one row each


def ranked_waters(scores: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Waters from the best supported down, and whether they stay."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "atom_id"))
    return scores.where("is_water").select(*by, "atom_id", "score", rank.alias("rank"), (F.col("score") >= threshold).alias("kept"))


def residue_profile(residues: DataFrame, field: str, chain: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(chain, resnum, value)`` of a score field; of a number that repeats the last name and code count."""
    rows = residues if chain is None else residues.where(F.col("chain") == chain)
    return rows.groupBy(*by, "chain", "resnum").agg(F.max_by(field, F.struct("icode", "resname")).alias("value"))


def assembled(experiments: DataFrame, summaries: DataFrame, *parts: DataFrame) -> DataFrame:
    """All experiments, with nulls where an analysis failed; every other table has one row a stem at most."""
    out = experiments.join(summaries.withColumn("analysis_complete", F.lit(True)), "stem", "left")
    for part in parts:
        out = out.join(part, "stem", "left")
    return out.withColumn("analysis_complete", F.coalesce("analysis_complete", F.lit(False)))


def typed_summaries(raw: DataFrame) -> DataFrame:
    """Text fields to numbers; what is no number becomes null."""
    return raw.select("stem", *[safe_float(F.col(c)).alias(c) if kind == "f" else safe_int(F.col(c)).alias(c) for c, kind in (("opia", "f"), ("mean_atom_score", "f"), ("n_atoms", "i")) if c in raw.columns])


#: Experiments that one task ranks, and that one page shows.
RANK_ROWS, PAGE_ROWS = 250_000, 20_000


def screen_rank(results: DataFrame, n: int | None = None) -> DataFrame:
    """Best experiment first, failed ones last; ``n`` is their number, where it is known.

    A large screen is cut into ranges of that order, which tasks number each for itself from where the range begins.
    """
    order = F.col("opia").desc_nulls_last(), F.col("stem")
    parts = -(-(results.count() if n is None else n) // RANK_ROWS)
    if parts < 2:
        rank = F.row_number().over(Window.orderBy(*order))
        return results.select("*", rank.alias("rank"), badge(F.col("opia"), *OPIA_BADGE).alias("badge"))
    bounds = _bounds(results.select("opia", "stem"), order, parts, n)
    ranged = results.withColumn("_range", _range(bounds, 0, len(bounds)))
    held = dict(ranged.groupBy("_range").count().toLocalIterator())  # a row a range
    before = F.array(*[F.lit(sum(held.get(j, 0) for j in range(i))) for i in range(len(bounds) + 1)])
    rank = F.get(before, F.col("_range")) + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.select(*results.columns, rank.cast("int").alias("rank"), badge(F.col("opia"), *OPIA_BADGE).alias("badge"))


def _bounds(keys: DataFrame, order: Sequence[Column], parts: int, n: int | None) -> list[tuple]:
    """Keys that cut the order into about equal ranges, from a sample: any bounds give the same ranks."""
    share = min(1.0, 100 * parts / (n or keys.count()))
    some = [tuple(r) for r in keys.sample(share, 1).orderBy(*order).toLocalIterator()]  # about 100 rows a range
    return list(dict.fromkeys(some[len(some) * i // parts] for i in range(1, parts))) if some else []


def _range(bounds: Sequence[tuple], low: int, high: int) -> Column:
    """How many of the sorted ``bounds`` aren't behind a row, by bisection."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    opia, stem = bounds[middle]
    first = F.col("stem") < stem
    if opia is None:
        earlier = F.col("opia").isNotNull() | first
    else:
        earlier = F.coalesce((F.col("opia") > F.lit(opia)) | ((F.col("opia") == F.lit(opia)) & first), F.lit(False))
    return F.when(earlier, _range(bounds, low, middle)).otherwise(_range(bounds, middle + 1, high))


def screen_summary(results: DataFrame) -> DataFrame:
    complete = F.col("opia").isNotNull()
    return results.agg(F.count("*").alias("n_experiments"), F.count_if(complete).alias("n_complete"), F.round(F.avg("opia"), 4).alias("mean_opia"))


def experiment_json(results: DataFrame) -> DataFrame:
    """``(stem, json)``; nulls are written as "N/A"."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in results.columns]
    return results.select("stem", F.to_json(F.struct(*cells)).alias("json"))


def _svg(body: str, title: str, width: int = 840, height: int = 240) -> str:
    return f"<svg xmlns='http://www.w3.org/2000/svg' viewBox='0 0 {width} {height}' font-size='11'><title>{html.escape(title)}</title><text x='40' y='14'>{html.escape(title)}</text>{body}</svg>"


def _axis(values: Sequence[float], marks: Sequence[float]) -> Callable[[float], float]:
    low, high = min([0.0, *values, *marks]), max([1e-9, *values, *marks])
    return lambda v: 220.0 - 190.0 * (v - low) / (high - low or 1.0)


def profile_svg(profile: Sequence[tuple[int, float]], title: str = "Residue profile", marks: Sequence[float] = (0.4, 0.8)) -> str:
    """A line of one model's residue scores by number, with marks where support is poor and good."""
    rows = sorted(profile)
    y = _axis([v for _, v in rows], marks)
    first, last = (rows[0][0], rows[-1][0]) if rows else (0, 1)
    points = " ".join(f"{40 + 780 * (n - first) / max(1, last - first):.1f},{y(v):.1f}" for n, v in rows)
    lines = "".join(f"<line x1='40' x2='820' y1='{y(m):.1f}' y2='{y(m):.1f}' stroke='#999' stroke-dasharray='4'/><text x='4' y='{y(m):.1f}'>{m:g}</text>" for m in marks)
    return _svg(f"{lines}<polyline points='{points}' fill='none' stroke='#4878CF'/>", title)


def waters_svg(waters: Sequence[tuple[int, float, bool]], threshold: float, title: str = "Support of waters") -> str:
    """One model's waters by rank, those under the threshold in red, with their numbers."""
    if not waters:
        raise ValueError("no waters to show")
    y = _axis([v for _, v, _ in waters], [threshold])
    kept = sum(k for *_, k in waters)
    dots = "".join(f"<circle cx='{40 + 780 * (r - 1) / max(1, len(waters) - 1):.1f}' cy='{y(v):.1f}' r='3' fill='{'#2CA02C' if k else '#D62728'}'/>" for r, v, k in sorted(waters))
    line = f"<line x1='40' x2='820' y1='{y(threshold):.1f}' y2='{y(threshold):.1f}' stroke='#555' stroke-dasharray='4'/>"
    return _svg(f"{line}{dots}<text x='500' y='14'>threshold {threshold:.2f}: keep {kept}, remove {len(waters) - kept}</text>", title)


STYLE = ".green{background:#dfd}.yellow{background:#ffd}.red{background:#fdd}.more td{padding:0 1em}details table{display:inline-table;margin:0 2em 1em 0;vertical-align:top}.pill{border-radius:1em;background:#eee;padding:0 .6em}"
#: Columns with one path each, shown as links of that name.
LINKS = {"folder": "folder", "model": "model", "reflections": "reflections", "scored": "scored model", "profile": "residue profile", "waters": "waters", "viewer": "viewer script"}


def _link(path: str, label: str) -> str:
    return f"<a href='{quote('file://' + path if path.startswith('/') else path, safe=':/')}' title='{html.escape(path, quote=True)}'>{html.escape(label)}</a>"


def links(row: dict) -> str:
    """Of an experiment's files: those of ``LINKS``, and each of its maps."""
    out = [_link(row[c], label) for c, label in LINKS.items() if row.get(c)]
    for kind in ("snr", "mean"):
        paths = row.get(f"{kind}_maps") or []
        out += [_link(p, f"{kind} map" if len(paths) == 1 else f"{kind} map {n}") for n, p in enumerate(paths, 1)]
    return " ".join(out)


def _table(heads: Sequence[str], rows: Iterable[str]) -> str:
    return f"<table><tr>{''.join(f'<th>{html.escape(h)}</th>' for h in heads)}</tr>{''.join(rows)}</table>"


def neighbourhood(row: dict) -> str:
    """How many residues of each kind are around the ligand, and which."""
    near = row.get("neighbours")
    if not near:
        return ""
    pills = " ".join(f"<span class='pill'>{row.get(c) or 0} {label}</span>" for c, label in (("n_protein", "protein"), ("n_water", "water"), ("n_other", "other")))
    rows = (f"<tr>{''.join(f'<td>{html.escape(str(n[c]))}</td>' for c in ('chain', 'resname', 'resnum', 'category'))}</tr>" for n in near)
    return f"<p>{pills}</p>{_table(('Chain', 'Residue', 'Number', 'Kind'), rows)}"


def ligand_table(row: dict) -> str:
    """The ligand's atoms with their scores, in the colours of these."""
    atoms = row.get("atoms")
    if not atoms:
        return ""

    def line(a: dict) -> str:
        name = " ".join(str(a[c]) for c in ("chain", "resnum", "atom") if a.get(c) is not None) or str(a["atom_id"])
        score = "N/A" if a["score"] is None else f"{a['score']:.4f}"
        return f"<tr><td>{html.escape(name)}</td><td style='background:{a.get('colour') or '#FFFFFF'}'>{score}</td></tr>"

    return _table(("Ligand atom", "Score"), map(line, atoms))


def _head(names: Sequence[str], title: str, more: str = "") -> str:
    head = "".join(f"<th>{html.escape(n)}</th>" for n in [*names, "files"])
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{more}<table><tr>{head}</tr>\n"


def _rows(names: Sequence[str], r: dict) -> str:
    """An experiment's line of the table, with its files and what is around its ligand."""

    def cell(v: object) -> str:
        return f"<td>{html.escape('N/A' if v is None else f'{v:.4f}' if isinstance(v, float) else str(v))}</td>"

    more = neighbourhood(r) + ligand_table(r)
    more = f"<tr class='more'><td colspan='{len(names) + 1}'><details><summary>ligand of {html.escape(str(r.get('stem', '')))}</summary>{more}</details></td></tr>" if more else ""
    return f"<tr class='{r.get('badge', 'none')}'>{''.join(cell(r[n]) for n in names)}<td>{links(r)}</td></tr>{more}"


TAIL = "</table></body></html>"


def html_pages(names: Sequence[str], rows: Iterable[dict], title: str = "Screen report") -> Iterator[str]:
    """A page in parts: a table of all experiments, one at a time, each with its files and what is around its ligand."""
    yield _head(names, title)
    for r in rows:
        yield _rows(names, r) + "\n"
    yield TAIL


def page_path(path: str | Path, n: int) -> str:
    """Where the page of number ``n`` is: the first at ``path``, others beside it."""
    return str(path) if n == 1 else f"{str(path).removesuffix('.html')}_{n}.html"


def write_html(ranked: DataFrame, path: str | Path, title: str = "Screen report", n: int | None = None) -> None:
    """All ``n`` experiments by rank, ``PAGE_ROWS`` on a page that a task writes; pages link to those beside them."""
    path = os.path.abspath(path)
    names = [f.name for f in ranked.schema if not isinstance(f.dataType, (ArrayType, StructType)) and f.name not in LINKS]
    last = max(1, -(-(ranked.count() if n is None else n) // PAGE_ROWS))
    line = F.udf(lambda r: _rows(names, r.asDict(recursive=True)), "string", useArrow=False)
    page = (F.floor((F.col("rank") - 1) / PAGE_ROWS) + 1).cast("int")
    rows = ranked.select(page.alias("page"), F.col("rank").alias("turn"), line(F.struct(*ranked.columns)).alias("value"))
    place = F.when(F.col("page") == 1, path).otherwise(F.concat(F.lit(f"{path.removesuffix('.html')}_"), F.col("page").cast("string"), F.lit(".html")))

    def beside(number: int) -> str:
        found = [(m, label) for m, label in ((number - 1, "previous"), (number + 1, "next")) if 1 <= m <= last]
        return f"<p>page {number} of {last} {' '.join(_link(os.path.basename(page_path(path, m)), label) for m, label in found)}</p>" if last > 1 else ""

    def content(pdf: pd.DataFrame) -> bytes:
        lines = pdf.sort_values("turn")["value"].tolist()
        return (_head(names, title, beside(int(pdf["page"].iloc[0]))) + "\n".join(lines) + f"\n{TAIL}").encode()

    if not Path(path).exists():
        put(path, (_head(names, title) + TAIL).encode())  # of no experiment
    write_groups(rows.withColumn("path", place), content, os.path.dirname(path))
    while Path(page_path(path, last := last + 1)).exists():  # of a larger screen before
        Path(page_path(path, last)).unlink()


SUMMARY = "stem string, opia double, mean_atom_score double, median_atom_score double, n_atoms long, n_residues long, n_clashes long, n_missing_density long, n_unaccounted_density long, significance_alpha double, significance_snr_threshold double"
ATOMS = "chain string, resname string, resnum int, icode string, atom string, element string, score double, score_positive double, score_negative double, is_water boolean, has_clash boolean, has_missing_density boolean, has_unaccounted_density boolean, radius double, n_grid_points long"
RESIDUES = "chain string, resname string, resnum int, icode string, residue_score double, min_atom_score double, median_atom_score double, max_atom_score double, n_atoms long, n_clashes long, n_missing_density long, n_unaccounted_density long"


def read_results(spark: SparkSession, paths: Sequence[str], schema: str, suffix: str) -> DataFrame:
    """Exported CSV tables of many experiments with ``stem``; without files an empty table."""
    if not paths:
        return spark.createDataFrame([], "stem string, " + schema)
    raw = spark.read.option("header", True).schema(schema).csv(list(paths))
    return raw.select(F.regexp_extract(local_path(F.col("_metadata.file_path")), f"([^/]*)_{suffix}[.]csv$", 1).alias("stem"), "*")


def symmetry(spark: SparkSession, found: Sequence[Experiment], models: dict[str, str]) -> DataFrame:
    """Cells and operators of the models, those of the first map where a model names none."""
    own = read_symmetry(spark, models)
    lacking = {r.stem for r in own.where("size(images) < 2").select("stem").toLocalIterator()}  # a row a crystal
    first = {e.stem: str(p) for e in found if e.stem in lacking and (p := e.map_files(None).get(0))}
    if not first:
        return own
    heads = maps.read_mtz_headers(spark, list(first.values())).where("error is null").select("operators", *map_name(F.col("path")))
    rows = [(r.stem, [(x.ravel().tolist(), t.tolist()) for x, t in map(maps.operator, r.operators or ["X,Y,Z"])]) for r in heads.toLocalIterator()]  # a row a crystal
    named = spark.createDataFrame(rows, f"stem string, more {IMAGES}")
    return own.join(named, "stem", "left").withColumn("images", F.coalesce("more", "images")).drop("more")


def collected(spark: SparkSession, experiments: DataFrame, found: Sequence[Experiment], ligand: str = "LIG", reach: float = 10.0) -> DataFrame:
    """Everything known of each experiment: summary, the ligand's scores and surroundings, maps, reflections."""

    def there(suffix: str) -> list[str]:
        return [str(e.root / name) for e in found if e.has(name := f"analyse_results/{e.stem}_{suffix}")]

    jsons = there("summary.json")
    summaries = spark.read.schema(SUMMARY).json(jsons) if jsons else spark.createDataFrame([], SUMMARY)
    summaries = summaries.withColumns({c: F.round(c, 4) for c in ("opia", "mean_atom_score", "median_atom_score")})
    scores = read_results(spark, there("atoms.csv"), ATOMS, "atoms").withColumn("atom_id", F.monotonically_increasing_id())
    residues = read_results(spark, there("residues.csv"), RESIDUES, "residues")
    by, parts = ["stem"], [ligand_scores(residues, scores, ligand, ["stem"])]
    models = {e.stem: str(e.original) for e in found if e.original}
    if models:
        atoms = read_structures(spark, models)
        near = ligand_neighbours(atoms, reach, ligand, by, symmetry(spark, found, models))
        centre = ligand_centroid(atoms, ligand, by).withColumnRenamed("n_atoms", "n_ligand_atoms")
        parts += [neighbour_counts(near, by), neighbour_lists(near, by), centre]
    else:
        parts.append(spark.createDataFrame([], "stem string, n_protein long, n_water long, n_other long, cx double, cy double, cz double"))
    listing = spark.createDataFrame([(e.stem, str(p)) for e in found for p in e.matching("quantify_results/k_*_cap_*/*.ccp4")], "stem string, path string")
    parts += [maps_by_suffix(listing, s).withColumnRenamed("paths", f"{s}_maps") for s in ("snr", "mean")]
    jobs = [(e.stem, str(parameters.get(parameters.load(p), "input.xray_data.file_name", ""))) for e in found for p in e.matching(f"params/{e.stem}_0.params")]
    named = spark.createDataFrame(jobs, "stem string, value string")
    manifest = [str(p) for p in {e.root.parent / "manifest.txt" for e in found} if p.exists()]
    told = read_manifest(spark, manifest) if manifest else spark.createDataFrame([], "id string, model string, reflections string")
    parts.append(original_reflections(experiments, told, named))
    return assembled(experiments, summaries, *parts)


def viewer_script(stem: str, model: str, maps: Sequence[str], centre: Sequence[float] | None, level: float | None, reflections: str | None = None) -> str:
    """Python for a molecular viewer: opens the model, its reflections and maps, and goes to the ligand."""
    lines = [f"# {stem}"]
    if model:
        lines.append(f"model = read_pdb({json.dumps(model)})")
    if reflections:
        lines.append(f"reflections = auto_read_make_and_draw_maps({json.dumps(reflections)})")
    for i, path in enumerate(maps):
        lines.append(f"map_{i} = handle_read_ccp4_map({json.dumps(path)}, 0)")
        # The first map holds the ratio, which the significance threshold is about.
        lines.append(f"set_contour_level_absolute(map_{i}, {(level if level is not None and i == 0 else 1.0):.4f})")
    if centre is not None:
        lines.append(f"set_rotation_centre({', '.join(f'{c:.3f}' for c in centre)})")
    return "\n".join(lines) + "\n"
