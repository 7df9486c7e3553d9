"""Screening tables: CSV with aliased headers, and SQLite with refined and fallback pairs."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Headers of the two roles, in order of priority.
STRUCTURE_NAMES = ("pdb", "cif", "structure", "model", "structure_file")
REFLECTION_NAMES = ("mtz", "sf", "sf_cif", "reflections", "hkl", "cif_sf")
#: Columns of the table in screening databases.
REFINED = ("RefinementPDB_latest", "RefinementMTZ_latest")
FALLBACK = ("DimplePathToPDB", "DimplePathToMTZ")


def column_for(columns: list[str], names: tuple[str, ...], role: str) -> str:
    by_name = {c.strip().lower(): c for c in columns}
    for name in names:
        if name in by_name:
            return by_name[name]
    raise ValueError(f"no {role} column: accepted are {list(names)} in any case, found {columns}")


def file_stem(path: Column) -> Column:
    """The file's name without its last extension and without a mark of structure factors."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    for mark in ("-sf", "_sf", "-SF", "_SF"):
        stem = F.regexp_replace(stem, mark + "$", "")
    return stem


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    return screening_pairs(spark.read.option("header", True).csv(path))


def screening_pairs(table: DataFrame) -> DataFrame:
    """``(id, pdb, mtz)`` of all rows."""
    pdb = column_for(table.columns, STRUCTURE_NAMES, "structure")
    mtz = column_for(table.columns, REFLECTION_NAMES, "reflections")
    return table.select(file_stem(F.col(f"`{pdb}`")).alias("id"), F.col(f"`{pdb}`").alias("pdb"), F.col(f"`{mtz}`").alias("mtz"))


def with_outcome(table: DataFrame, outcomes: str | None, column: str = "RefinementOutcome") -> DataFrame:
    """Rows whose outcome holds any of the comma-separated patterns; null holds none."""
    if not outcomes:
        return table
    return table.where(F.coalesce(F.col(column).rlike("|".join(o.strip() for o in outcomes.split(","))), F.lit(False)))


def best_pairs(table: DataFrame, name: str = "CrystalName", refined: tuple[str, str] = REFINED, fallback: tuple[str, str] = FALLBACK, cap: int | None = None, order: str | None = None) -> DataFrame:
    """The complete refined pair, else the complete fallback, never a mix; the first ``cap`` by ``order``."""

    def whole(pair: tuple[str, str]) -> Column:
        a, b = map(F.col, pair)
        return F.when(F.col(name).isNotNull() & a.isNotNull() & b.isNotNull(), F.struct(a.alias("pdb"), b.alias("mtz")))

    rows = table.withColumn("_pair", F.coalesce(whole(refined), whole(fallback))).where("_pair is not null")
    if cap is not None:
        rows = rows.orderBy(order or name).limit(cap)
    return rows.select(F.col(name).alias("id"), "_pair.pdb", "_pair.mtz")


def _databases(path: str) -> list[str]:
    """The file itself, or the sorted databases of a folder."""
    return sorted(str(p) for p in Path(path).glob("*.sqlite")) if Path(path).is_dir() else [path]


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str], size: int):
        self.path, self.table, self.names, self.size = path, table, names, size

    def partitions(self) -> list[InputPartition]:
        out = []
        for number, path in enumerate(_databases(self.path)):
            with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                last = db.execute(f'SELECT max(rowid) FROM "{self.table}"').fetchone()[0] or 0
            out += [InputPartition((number, path, lo, lo + self.size)) for lo in range(0, last + 1, self.size)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, path, lo, hi = partition.value
        columns = ", ".join(f'"{n}"' for n in self.names)
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
            for row in db.execute(f'SELECT rowid, {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (lo, hi)):
                yield (f"{number:09d}{row[0]:018d}", *(None if v is None else str(v) for v in row[1:]))


class SqliteSource(DataSource):
    """All rows of a table as strings, by ranges of row ids; ``row`` keeps their order, in a folder that of its databases before it."""

    @classmethod
    def name(cls) -> str:
        return "densika_sqlite"

    def _names(self) -> list[str]:
        table, found = self.options.get("table", "mainTable"), _databases(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no database in {self.options['path']}")
        with closing(sqlite3.connect(f"file:{found[0]}?mode=ro", uri=True)) as db:
            return [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for n in ("row", *self._names())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options.get("table", "mainTable"), schema.names[1:], int(self.options.get("rows", 100_000)))


def from_sqlite(spark: SparkSession, path: str, outcomes: str | None = None, cap: int | None = None, table: str = "mainTable") -> DataFrame:
    spark.dataSource.register(SqliteSource)
    rows = spark.read.format("densika_sqlite").option("path", path).option("table", table).load()
    return best_pairs(with_outcome(rows, outcomes), cap=cap, order="row")
