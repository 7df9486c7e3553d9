"""Job tables, manifests and batch scripts of the map computation that runs outside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densika.config import Slurm


def fan_out(crystals: DataFrame, n_maps: Column) -> DataFrame:
    """One row a crystal and map."""
    return crystals.withColumn("map_id", F.explode(F.sequence(F.lit(0), n_maps - 1)))


def chunked(jobs: DataFrame, size: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``chunk`` and ``slot``: ``size`` jobs to a submission, in order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return jobs.withColumn("chunk", F.floor(n / size)).withColumn("slot", n % size)


def pending(jobs: DataFrame, done: DataFrame, on: Sequence[str], force: bool = False) -> DataFrame:
    """Jobs without output yet; all of them if forced."""
    return jobs if force else jobs.join(done, list(on), "left_anti")


def manifest_lines(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.concat_ws("|", "id", "model", "reflections").alias("value"))


def selection_text(keys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Selections of residues, atoms and alternative locations joined by " or ", in order of residue number and key."""
    p = F.split("key", r"\|")
    alt = F.when(F.get(p, F.lit(4)).isin("", "\x00"), None).otherwise(F.get(p, F.lit(4)))
    text = F.concat(F.lit("(chain "), F.get(p, F.lit(0)), F.lit(" and resseq "), F.get(p, F.lit(1)))
    text = F.concat(text, F.coalesce(F.concat(F.lit(" and name "), F.get(p, F.lit(3))), F.lit("")), F.coalesce(F.concat(F.lit(" and altloc "), alt), F.lit("")), F.lit(")"))
    rows = keys.select(*by, F.struct(F.get(p, F.lit(1)).cast("int").alias("n"), F.col("key").alias("key"), text.alias("text")).alias("s")).distinct()
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), " or ").alias("selection"))


def array_script(slurm: Slurm, n: int, command: str, manifest: str, after: str | None = None) -> str:
    """A batch script that runs ``command`` on each line of a manifest."""
    head = ["#!/bin/bash", f"#SBATCH --job-name={slurm.job_name}", f"#SBATCH --array=1-{n}", f"#SBATCH --nodes={slurm.num_nodes}"]
    head += [f"#SBATCH --cpus-per-task={slurm.cpus_per_task}", f"#SBATCH --mem-per-cpu={slurm.mem_per_cpu}", f"#SBATCH --time={slurm.time_limit}"]
    if slurm.partition:
        head.append(f"#SBATCH --partition={slurm.partition}")
    if after:
        head.append(f"#SBATCH --dependency=afterok:{after}")
    return "\n".join([*head, "set -euo pipefail", f'LINE=$(sed -n "${{SLURM_ARRAY_TASK_ID}}p" "{manifest}")', f'{command} "$LINE"', ""])


def chain_script(scripts: Sequence[str]) -> str:
    """Submits scripts so that each waits for the one before to succeed."""
    lines = ["#!/bin/bash", "set -euo pipefail", 'last=""']
    for path in scripts:
        lines.append(f'last=$(sbatch --parsable ${{last:+--dependency=afterok:$last}} "{path}")')
    return "\n".join([*lines, 'echo "$last"', ""])
