"""One file for each group of rows, made by the task that holds the group and committed with all others of the job.

For files that are small by nature, as those of one model or one map.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densika.sources.sink import write_files


def local_path(path: Column) -> Column:
    """A file's path as the local file system has it, from the form in which readers give it."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def few_listing_tasks(stage: Callable) -> Callable:
    """Readers of many paths list them in a few tasks for each core while ``stage`` runs, not in a task for each path."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

    @wraps(stage)
    def run(spark: SparkSession, *args, **kwargs):
        before = spark.conf.get(name)
        spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
        try:
            return stage(spark, *args, **kwargs)
        finally:
            spark.conf.set(name, before)

    return run


def put(path: str, data: bytes) -> None:
    """One file from the driver, written beside its place and renamed."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    Path(beside).write_bytes(data)
    os.replace(beside, path)


def write_groups(rows: DataFrame, content: Callable[[pd.DataFrame], bytes], root: str) -> None:
    """Writes ``content`` of the rows of each ``path`` there, all of them somewhere under ``root``: all files or none."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]], "data": [content(pdf)]})

    write_files(rows.groupBy("path").applyInPandas(run, "path string, data binary"), root)


def write_lines(rows: DataFrame, root: str, header: str | None = None) -> None:
    """Text files of ``(path, turn, value)`` under ``root``, lines in order of ``turn``."""

    def content(pdf: pd.DataFrame) -> bytes:
        lines = ([header] if header else []) + pdf.sort_values("turn")["value"].tolist()
        return ("\n".join(lines) + "\n").encode()

    write_groups(rows.select("path", "turn", "value"), content, root)


def csv_lines(df: DataFrame, columns: dict[str, int | None]) -> tuple[DataFrame, str]:
    """Adds ``value``, a CSV line of the named columns with so many decimals; and the header."""

    def cell(name: str, decimals: int | None) -> Column:
        c = F.col(name)
        text = F.format_string(f"%.{decimals}f", c.cast("double")) if decimals is not None else c.cast("string")
        text = F.coalesce(text, F.lit(""))
        return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.withColumn("value", F.concat_ws(",", *[cell(n, d) for n, d in columns.items()])), ",".join(columns)
