"""Command line: ``densika debias|quantify|analyse|report``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from densika import api
from densika.config import Run, layered, read_settings
from densika.functions import radii


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="densika", description=__doc__)
    sub = top.add_subparsers(dest="stage", required=True)
    d = sub.add_parser("debias", help="sample omissions and write jobs")
    d.add_argument("--config", help="settings, JSON or YAML")
    for name in ("structure", "reflections", "screening"):
        d.add_argument(f"--{name}")
    d.add_argument("--output", default=".")
    d.add_argument("--fraction", type=float)
    d.add_argument("--iterations", type=int)
    d.add_argument("--seed", type=int)
    d.add_argument("--force", action="store_true")
    for stage in ("quantify", "analyse"):
        s = sub.add_parser(stage)
        s.add_argument("root", help="an experiment's folder, or one of many")
        s.add_argument("--k", type=float, default=1.0, help="factor of the radii; 0: no bias is removed")
        s.add_argument("--cap", type=int, default=50, help="maps that are read; 0: all")
        if stage == "quantify":
            s.add_argument("--force", action="store_true")
        else:
            s.add_argument("--alpha", type=float, default=0.05)
            s.add_argument("--map")
            s.add_argument("--model")
            s.add_argument("--radii", help="a table of element, charge and six radii, over the built-in one")
    for s in (sub.choices["analyse"], sub.add_parser("report")):
        s.add_argument("--ligand", default="LIG")
        s.add_argument("--reach", type=float, default=10.0)
    sub.choices["report"].add_argument("root")
    return top


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"densika {a.stage}").getOrCreate()
    if a.stage == "debias":
        given = {"structure_path": a.structure, "reflections_path": a.reflections, "screening_path": a.screening, "omit_fraction": a.fraction, "iterations": a.iterations, "seed": a.seed}
        over = {"output_dir": a.output, "force": a.force, "debias": {k: v for k, v in given.items() if v is not None}}
        file = read_settings(a.config) if a.config else {}
        api.debias(spark, layered(Run(), file, over)).show(truncate=False)
    elif a.stage == "quantify":
        api.run_quantification(spark, a.root, a.k, a.cap or None, a.force).show(truncate=False)
    elif a.stage == "analyse":
        api.run_analysis(spark, a.root, a.k, a.cap or None, a.alpha, a.map, a.model, ligand=a.ligand, reach=a.reach, table=radii.read_table(spark, a.radii) if a.radii else None).show(truncate=False)
    else:
        api.screen_report(spark, a.root, ligand=a.ligand, reach=a.reach).select("rank", "stem", "opia", "badge", "error").show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
