"""Map files after their public format descriptions: CCP4 maps, and MTZ reflections.

A file is a task's unit: maps of one crystal fit a task by nature, screens have many.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densika.functions.cell import LATTICE, Cell, lattice
from densika.sources import files

VOXELS_A_BATCH = 100_000
#: Parts of a map that tasks of their own make, where a map is not a task's unit.
SLABS = 32
#: Neighbouring voxels that a map hands on as one row.
VOXELS_A_ROW = 4096
_LATTICE = ["edges", "orth", "frac", "dims"]
#: Map amplitude labels, in order of priority, with their phases.
MAP_LABELS = (
    ("2FOFCWT", "PH2FOFCWT"), ("2FOFC", "PH2FOFC"), ("2FOFCWT_no_fill", "PH2FOFCWT_no_fill"),
    ("2FOFCWT_fill", "PH2FOFCWT_fill"), ("FWT", "PHWT"), ("FDM", "PHFDM"),
)


def parse_ccp4(data: bytes) -> tuple[np.ndarray, Cell, int]:
    """Values by (u, v, w) as far as the file has them, the cell and the space group; NaN outside."""
    order = ">" if data[212:213] == b"\x11" else "<"
    head = struct.unpack(f"{order}10i6f3i3f2i", data[:96])
    nc, nr, ns, mode = head[:4]
    start, size = head[4:7], head[7:10]
    axes = [a - 1 for a in head[16:19]]
    kinds = {0: "i1", 1: "i2", 2: "f4", 6: "u2"}
    if mode not in kinds:
        raise ValueError(f"map mode {mode} is not supported")
    values = np.frombuffer(data, order + kinds[mode], nc * nr * ns, 1024 + head[23]).reshape(ns, nr, nc).astype(np.float32)
    full = np.full(size, np.nan, np.float32)
    index = [None] * 3
    for axis, first, n in zip(axes, start, (nc, nr, ns), strict=True):
        index[axis] = (first + np.arange(n)) % size[axis]
    by_axis = np.transpose(values, [(2, 1, 0)[axes.index(a)] for a in range(3)])
    full[np.ix_(*index)] = by_axis
    text = data[1024 : 1024 + head[23]].decode("ascii", "replace")
    return expanded(full, [t for i in range(0, len(text), 80) if (t := text[i : i + 80].strip())]), Cell(*head[10:16]), head[22]


def expanded(values: np.ndarray, operators: list[str]) -> np.ndarray:
    """Nodes without a value take it from a node that a symmetry operator carries onto them; others stay NaN."""
    known = np.argwhere(np.isfinite(values))
    size = np.array(values.shape)
    for text in operators:
        if not np.isnan(values).any():
            break
        rotation, shift = operator(text)
        at = (known / size) @ rotation.T + shift
        node = np.rint(at * size).astype(int)
        on = (np.abs(node - at * size) < 1e-3).all(1)
        to, source = tuple((node[on] % size).T), tuple(known[on].T)
        free = np.isnan(values[to])
        values[tuple(t[free] for t in to)] = values[source][free]
    return values


def format_ccp4(values: np.ndarray, cell: Cell, spacegroup: int = 1) -> bytes:
    v = np.ascontiguousarray(values, np.float32)
    nu, nv, nw = v.shape
    head = struct.pack("<10i6f3i3f2i", nu, nv, nw, 2, 0, 0, 0, nu, nv, nw, cell.a, cell.b, cell.c, cell.alpha, cell.beta, cell.gamma, 1, 2, 3, float(np.nanmin(v)), float(np.nanmax(v)), float(np.nanmean(v)), spacegroup, 0)
    head += b"\0" * (208 - len(head)) + b"MAP " + b"\x44\x44\0\0" + struct.pack("<fi", float(np.nanstd(v)), 0)
    return head.ljust(1024, b"\0") + np.transpose(v, (2, 1, 0)).tobytes()


def _voxels(spark: SparkSession, path: str | list[str], keys: Mapping[str, Column] | None, values: Callable[[bytes], np.ndarray], kind: str = "float") -> DataFrame:
    """``(path, keys, i, j, k, value)`` of map files; ``keys`` are worked out once a file, not for each of its voxels."""
    held = spark.read.format("binaryFile").load(path).select("path", *[c.alias(n) for n, c in (keys or {}).items()], "content")
    own = held.columns[:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for told, content in zip(pdf[own].itertuples(index=False), pdf["content"], strict=True):
                of_file, all_ = dict(zip(own, told, strict=True)), values(content)
                step = max(1, VOXELS_A_BATCH // max(1, all_[0].size))
                for first in range(0, all_.shape[0], step):
                    some = all_[first : first + step]
                    i, j, k = np.indices(some.shape).reshape(3, -1)
                    yield pd.DataFrame({**of_file, "i": i + first, "j": j, "k": k, "value": some.ravel()})

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.drop("content").schema)
    return held.mapInPandas(run, f"{named}, i int, j int, k int, value {kind}")


def read_ccp4(spark: SparkSession, path: str | list[str], keys: Mapping[str, Column] | None = None) -> DataFrame:
    """Voxels of CCP4 maps, with ``keys`` made of ``path``."""
    return _voxels(spark, path, keys, lambda content: parse_ccp4(content)[0])


def read_ccp4_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path`` with the cell and the grid of CCP4 maps, or ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    order = ">" if content[212:213] == b"\x11" else "<"
                    head = struct.unpack(f"{order}10i6f", content[:64])
                    rows.append((file, *lattice(Cell(*head[10:16]), head[7:10]), None))
                except (ValueError, ZeroDivisionError, struct.error) as fault:
                    rows.append((file, None, None, None, None, str(fault)))
            yield pd.DataFrame(rows, columns=["path", *_LATTICE, "error"])

    return spark.read.format("binaryFile").load(path).select("path", F.col("content")).mapInPandas(run, f"path string, {LATTICE}, error string")


def write_ccp4(voxels: DataFrame, crystals: DataFrame, root: str, by: str = "stem") -> None:
    """CCP4 files at ``path``, under ``root``, of voxels ``(by, path, i, j, k, value)``, a whole cell each; nodes without a row are 0."""

    def content(pdf: pd.DataFrame) -> bytes:
        out = np.zeros(tuple(pdf["dims"].iloc[0]), np.float32)
        out[pdf["i"], pdf["j"], pdf["k"]] = pdf["value"]
        return format_ccp4(out, Cell(*pdf["cell"].iloc[0]), int(pdf["spacegroup"].iloc[0]))

    files.write_groups(voxels.join(crystals.select(by, "dims", "cell", "spacegroup"), by), content, root)


def write_ccp4_maps(voxels: DataFrame, crystals: DataFrame, names: list[str], root: str, by: str = "stem") -> None:
    """CCP4 files ``<folder>/<by>_<name>.ccp4``, under ``root``, of the columns ``names``, as of ``write_ccp4``; a null is 0.

    ``crystals`` have a ``folder``. What is one value a crystal meets its voxels once, not in each row.
    """

    def run(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        made = []
        for name in names if len(rows) and len(told) else []:
            out = np.zeros(tuple(told["dims"].iloc[0]), np.float32)
            out[rows["i"], rows["j"], rows["k"]] = rows[name]
            made.append((f"{told['folder'].iloc[0]}/{key[0]}_{name}.ccp4", format_ccp4(out, Cell(*told["cell"].iloc[0]), int(told["spacegroup"].iloc[0]))))
        return pd.DataFrame(made, columns=["path", "data"])

    values = voxels.select(by, "i", "j", "k", *[F.coalesce(F.col(n), F.lit(0.0)).cast("float").alias(n) for n in names])
    both = values.groupBy(by).cogroup(crystals.select(by, "folder", "dims", "cell", "spacegroup").groupBy(by))
    files.write_files(both.applyInPandas(run, "path string, data binary"), root)


def ccp4_files(voxels: DataFrame, by: str, cell: Cell, dims: tuple[int, int, int]) -> DataFrame:
    """``(by, content)``: a CCP4 file of each group of ``(i, j, k, value)``; a group is one crystal's map."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(dims, np.float32)
        out[pdf["i"], pdf["j"], pdf["k"]] = pdf["value"]
        return pd.DataFrame({by: [key[0]], "content": [format_ccp4(out, cell)]})

    return voxels.groupBy(by).applyInPandas(run, f"`{by}` {voxels.schema[by].dataType.simpleString()}, content binary")


def format_mtz(columns: list[tuple[str, str]], table: np.ndarray, cell: Cell, operators: list[str] | None = None, spacegroup: int = 1) -> bytes:
    """An MTZ file of reflections; ``columns`` are labels and types, the first three h, k and l."""
    operators = operators or ["X,Y,Z"]
    lines = ["VERS MTZ:V1.1", f"NCOL {len(columns)} {len(table)} 0", f"CELL {cell.a} {cell.b} {cell.c} {cell.alpha} {cell.beta} {cell.gamma}"]
    lines += [f"SYMINF {len(operators)} {len(operators)} P {spacegroup} 'unknown' PG1", *[f"SYMM {o}" for o in operators]]
    lines += [f"COLUMN {label} {kind} 0 1 0" for label, kind in columns] + ["END"]
    body = np.asarray(table, "<f4").tobytes()
    head = b"MTZ " + (21 + len(body) // 4).to_bytes(4, "little") + b"\x44\x41\0\0"
    return head.ljust(80, b"\0") + body + b"".join(line.ljust(80).encode() for line in lines)


def parse_mtz(data: bytes) -> tuple[list[tuple[str, str]], np.ndarray, Cell, list[str]]:
    """Columns (label, type), the reflection table, the cell and the symmetry operators."""
    if data[:4] != b"MTZ ":
        raise ValueError("not an MTZ file")
    order = "<" if data[8] & 0xF0 == 0x40 else ">"
    at = (struct.unpack(order + "i", data[4:8])[0] - 1) * 4
    columns, operators, cell, n = [], [], Cell(1, 1, 1), 0
    for line in (data[i : i + 80].decode("ascii", "replace") for i in range(at, len(data), 80)):
        words = line.split()
        if words[:1] == ["END"]:
            break
        if words[:1] == ["NCOL"]:
            n = int(words[2])
        elif words[:1] == ["CELL"]:
            cell = Cell(*map(float, words[1:7]))
        elif words[:1] == ["SYMM"]:
            operators.append(" ".join(words[1:]))
        elif words[:1] == ["COLUMN"]:
            columns.append((words[1], words[2]))
    table = np.frombuffer(data, order + "f4", n * len(columns), 80).reshape(n, len(columns))
    return columns, table, cell, operators


def spacegroup_number(data: bytes) -> int:
    """Of the symmetry record of an MTZ file; 1 if it has none."""
    found = data.rfind(b"SYMINF")
    words = data[found : found + 80].split() if found >= 0 else []
    return int(words[4]) if len(words) > 4 and words[4].isdigit() else 1


def resolution_limit(table: np.ndarray, cell: Cell) -> float:
    """The finest spacing among the reflections, whose first three columns are h, k, l."""
    m = np.array(cell.fractional())
    s = table[:, :3].astype(float) @ m
    longest = np.sqrt((s * s).sum(1)).max(initial=0.0)
    return float(1 / longest) if longest > 0 else float("inf")


def map_labels(columns: list[tuple[str, str]], candidates: tuple[tuple[str, str], ...] = MAP_LABELS) -> tuple[str, str]:
    names = [c for c, _ in columns]
    for amplitude, phase in candidates:
        if amplitude in names:
            return amplitude, phase
    raise ValueError(f"no map amplitude among the columns {names}")


def operator(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A symmetry operator such as ``-X, Y+1/2, -Z`` as a rotation and a translation."""
    rotation, shift = np.zeros((3, 3)), np.zeros(3)
    for row, part in enumerate(text.replace(" ", "").lower().split(",")):
        for term in part.replace("-", "+-").split("+"):
            if term:
                sign, body = (-1.0, term[1:]) if term[0] == "-" else (1.0, term)
                if body in "xyz":
                    rotation[row, "xyz".index(body)] = sign
                else:
                    top, _, bottom = body.partition("/")
                    shift[row] += sign * float(top) / float(bottom or 1)
    return rotation, shift


def grid_size(table: np.ndarray, cell: Cell, sample_rate: float = 3.0) -> tuple[int, int, int]:
    """Even sizes of small prime factors with spacing of resolution / ``sample_rate`` or finer."""
    d = resolution_limit(table, cell)

    def good(n: int) -> bool:
        for p in (2, 3, 5):
            while n % p == 0:
                n //= p
        return n == 1

    def least(edge: float) -> int:
        n = max(2, int(np.ceil(edge * sample_rate / d)))
        while n % 2 or not good(n):
            n += 1
        return n

    return least(cell.a), least(cell.b), least(cell.c)


def _coefficients(table: np.ndarray, columns: list[tuple[str, str]], operators: list[str], labels: tuple[str, str] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and complex amplitudes, symmetry applied; of an index that comes again the last one counts."""
    f, phi = labels or map_labels(columns)
    names = [c for c, _ in columns]
    hkl = np.rint(table[:, :3]).astype(int)
    amplitude, phase = table[:, names.index(f)].astype(float), np.radians(table[:, names.index(phi)].astype(float))
    known = np.isfinite(amplitude) & np.isfinite(phase)
    hkl, value = hkl[known], (amplitude * np.exp(1j * phase))[known]
    for text in operators or ["X,Y,Z"]:
        rotation, shift = operator(text)
        turned = np.rint(hkl @ rotation).astype(int)
        moved = value * np.exp(-2j * np.pi * (hkl @ shift))
        yield turned, moved
        yield -turned, np.conj(moved)


def density(table: np.ndarray, columns: list[tuple[str, str]], cell: Cell, operators: list[str], labels: tuple[str, str] | None = None, sample_rate: float = 3.0) -> np.ndarray:
    """The map of amplitudes and phases (degrees) by inverse Fourier transform, symmetry applied."""
    size = grid_size(table, cell, sample_rate)
    space = np.zeros(size, complex)
    for index, v in _coefficients(table, columns, operators, labels):
        space[tuple((index % size).T)] = v
    return (np.fft.fftn(space).real / cell.volume()).astype(np.float32)


def _distinct(table: np.ndarray, columns: list[tuple[str, str]], operators: list[str], labels: tuple[str, str] | None, size: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the reciprocal grid that have an amplitude, and these: the last one of each."""
    parts = list(_coefficients(table, columns, operators, labels))
    index, value = np.concatenate([i for i, _ in parts])[::-1] % size, np.concatenate([v for _, v in parts])[::-1]
    last = np.unique(np.ravel_multi_index(tuple(index.T), size), return_index=True)[1]
    return index[last], value[last]


def density_near_origin(table: np.ndarray, columns: list[tuple[str, str]], cell: Cell, operators: list[str], box: tuple[int, int, int], labels: tuple[str, str] | None = None, sample_rate: float = 3.0) -> np.ndarray:
    """The nodes of ``density`` below ``box`` by direct sums: what is held grows with the reflections, not with the grid."""
    size = grid_size(table, cell, sample_rate)
    index, value = _distinct(table, columns, operators, labels, size)
    out = np.zeros([min(b, n) for b, n in zip(box, size, strict=True)], complex)
    for first in range(0, len(value), VOXELS_A_BATCH):
        some = slice(first, first + VOXELS_A_BATCH)
        # Whole turns are taken off as integers, so that large indices cost no precision.
        waves = [np.exp(-2j * np.pi * (np.outer(np.arange(b), index[some, a]) % n) / n) for a, (b, n) in enumerate(zip(out.shape, size, strict=True))]
        for i, wave in enumerate(waves[0]):
            out[i] += np.einsum("jn,kn,n->jk", waves[1], waves[2], wave * value[some])
    return out.real / cell.volume()


def density_rows(table: np.ndarray, columns: list[tuple[str, str]], cell: Cell, operators: list[str], slab: int = 0, slabs: int = 1, labels: tuple[str, str] | None = None, sample_rate: float = 3.0) -> Iterator[tuple[int, int, np.ndarray]]:
    """All nodes of one of ``slabs`` parts of ``density`` in double precision: i, the first j, and the values of some rows from there.

    A plane sums the reflections over h and its rows over k, and each row is transformed along l, so that what is held
    grows with the reflections and a plane's distinct k and l, not with the grid.
    """
    size = nu, nv, nw = grid_size(table, cell, sample_rate)
    (h, k, l), value = (x := _distinct(table, columns, operators, labels, size))[0].T, x[1]
    ks, at_k = np.unique(k, return_inverse=True)
    ls, at_l = np.unique(l, return_inverse=True)
    order = np.argsort(at_k * len(ls) + at_l, kind="stable")
    place = (at_k * len(ls) + at_l)[order]
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    step = max(1, VOXELS_A_BATCH // nw)
    for i in range(nu * slab // slabs, nu * (slab + 1) // slabs):
        plane = np.zeros(len(ks) * len(ls), complex)
        if len(value):
            # Whole turns are taken off as integers, so that large indices cost no precision.
            plane[place[starts]] = np.add.reduceat((value * np.exp(-2j * np.pi * (i * h % nu) / nu))[order], starts)
        for j in range(0, nv, step):
            turns = np.outer(np.arange(j, min(j + step, nv)), ks) % nv
            rows = np.zeros((len(turns), nw), complex)
            rows[:, ls] = np.exp(-2j * np.pi * turns / nv) @ plane.reshape(len(ks), len(ls))
            yield i, j, np.fft.fft(rows, axis=1).real / cell.volume()


def read_mtz_maps(spark: SparkSession, path: str | list[str], keys: Mapping[str, Column] | None = None, box: tuple[int, int, int] | None = None) -> DataFrame:
    """Voxels of the maps of MTZ files, with ``keys`` made of ``path``; with ``box`` only nodes below it, in double precision."""

    def values(content: bytes) -> np.ndarray:
        columns, table, cell, operators = parse_mtz(content)
        return density(table, columns, cell, operators) if box is None else density_near_origin(table, columns, cell, operators, box)

    return _voxels(spark, path, keys, values, "float" if box is None else "double")


def read_mtz_nodes(spark: SparkSession, path: str | list[str], keys: Mapping[str, Column] | None = None, told: DataFrame | None = None) -> DataFrame:
    """All voxels of the maps of MTZ files in double precision, with ``keys`` made of ``path`` and the columns that ``told`` has by path.

    Maps that are too large for a task are made by parts, each by a task of its own.
    """
    held = spark.read.format("binaryFile").load(path).select("path", *[c.alias(n) for n, c in (keys or {}).items()], "content")
    held = held if told is None else held.join(told, "path")
    own = [c for c in held.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                columns, table, cell, operators = parse_mtz(batch.column("content")[n].as_py())
                for i, first, rows in density_rows(table, columns, cell, operators, batch.column("slab")[n].as_py(), SLABS):
                    j, k = np.indices(rows.shape, np.int32).reshape(2, -1)
                    at = [pa.array(np.full(rows.size, i, np.int32)), pa.array(j + np.int32(first)), pa.array(k), pa.array(rows.ravel())]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(c)[n], rows.size) for c in own] + at, [*own, "i", "j", "k", "value"])

    slabs = held.select(*own, "content", F.explode(F.sequence(F.lit(0), F.lit(SLABS - 1))).alias("slab"))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*own).schema)
    dealt = slabs.repartition(4 * spark.sparkContext.defaultParallelism, "path", "slab")  # few bytes make many rows
    return dealt.mapInArrow(run, f"{named}, i int, j int, k int, value double")


def read_mtz_ensembles(spark: SparkSession, path: str | list[str], n_maps: int) -> DataFrame:
    """``(stem, i, j, k, vals)``: the voxels of the crystals' maps below ``n_maps``, by position; a missing map is all zero.

    A file's voxels are shuffled many to a row, and meet those of the crystal's other maps as such; all are of one grid.
    """
    held = spark.read.format("binaryFile").load(path).select("path", "content")
    name = r"([^/]*)_([0-9]+)[.]mtz$"
    plain = files.local_path(F.col("path"))
    held = held.select(F.regexp_extract(plain, name, 1).alias("stem"), F.regexp_extract(plain, name, 2).cast("int").alias("map_id"), "content").where(F.col("map_id") < n_maps)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                columns, table, cell, operators = parse_mtz(batch.column("content")[n].as_py())
                values = density(table, columns, cell, operators)
                flat, told = values.ravel(), [batch.column(c)[n] for c in ("stem", "map_id")] + [pa.scalar(x, pa.int32()) for x in values.shape[1:]]
                for first in range(0, flat.size, VOXELS_A_ROW * 64):
                    some = flat[first : first + VOXELS_A_ROW * 64]
                    ends = np.append(np.arange(0, some.size, VOXELS_A_ROW), some.size)
                    parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(some))
                    yield pa.RecordBatch.from_arrays([*[pa.repeat(x, len(parts)) for x in told], pa.array(first + ends[:-1]), parts], ["stem", "map_id", "nv", "nw", "first", "part"])

    rows = held.mapInArrow(cut, "stem string, map_id int, nv int, nw int, first long, part array<float>")
    together = rows.groupBy("stem", "nv", "nw", "first").agg(F.collect_list(F.struct("map_id", "part")).alias("maps"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                held_ = batch.column("maps")[n].values
                numbers, parts = held_.field("map_id").to_pylist(), held_.field("part")
                vals = np.zeros((len(parts[0]), n_maps))
                for m, number in enumerate(numbers):
                    vals[:, number] = parts[m].values.to_numpy()
                nv, nw, first = (batch.column(c)[n].as_py() for c in ("nv", "nw", "first"))
                voxel = first + np.arange(len(vals))
                at = [pa.array(x.astype(np.int32)) for x in (voxel // (nv * nw), voxel // nw % nv, voxel % nw)]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(vals) + 1, dtype=np.int32) * n_maps), pa.array(vals.ravel()))
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("stem")[n], len(vals)), *at, listed], ["stem", "i", "j", "k", "vals"])

    return together.mapInArrow(spread, "stem string, i int, j int, k int, vals array<double>")


def read_mtz_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Of MTZ files ``path``, cell, map grid, finest resolution, space group and operators; ``error`` of those without a map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    columns, table, cell, operators = parse_mtz(content)
                    map_labels(columns)
                    rows.append((file, *lattice(cell, grid_size(table, cell)), [cell.a, cell.b, cell.c, cell.alpha, cell.beta, cell.gamma], resolution_limit(table, cell), spacegroup_number(content), operators, None))
                except (ValueError, ZeroDivisionError, OverflowError) as fault:
                    rows.append((file, *[None] * 8, str(fault)))
            yield pd.DataFrame(rows, columns=["path", *_LATTICE, "cell", "resolution", "spacegroup", "operators", "error"])

    schema = f"path string, {LATTICE}, cell array<double>, resolution double, spacegroup int, operators array<string>, error string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_mtz_columns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(crystal, label, type, resolution)`` of MTZ files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                columns, table, cell, _ = parse_mtz(content)
                yield pd.DataFrame([(file, a, b, resolution_limit(table, cell)) for a, b in columns], columns=["crystal", "label", "type", "resolution"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "crystal string, label string, type string, resolution double")


def write_table_csv(df: DataFrame, path: str, decimals: dict[str, int]) -> None:
    """CSV with a header; the named columns with so many decimals."""
    cells = [F.format_string(f"%.{decimals[c]}f", F.col(c)).alias(c) if c in decimals else F.col(c) for c in df.columns]
    df.select(*cells).write.option("header", True).mode("overwrite").csv(path)
