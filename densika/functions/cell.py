"""Unit cells: fractional and orthogonal coordinates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cell:
    a: float
    b: float
    c: float
    alpha: float = 90.0
    beta: float = 90.0
    gamma: float = 90.0

    def orthogonal(self) -> tuple[tuple[float, ...], ...]:
        """Columns of a, b and c, with a along x and b in the xy plane (upper triangular)."""

        def cosine(degrees: float) -> float:
            return 0.0 if degrees == 90.0 else math.cos(math.radians(degrees))

        ca, cb, cg = cosine(self.alpha), cosine(self.beta), cosine(self.gamma)
        sg = math.sqrt(1 - cg * cg)
        skew = (ca - cb * cg) / sg
        return (
            (self.a, self.b * cg, self.c * cb),
            (0.0, self.b * sg, self.c * skew),
            (0.0, 0.0, self.c * math.sqrt(1 - cb * cb - skew * skew)),
        )

    def fractional(self) -> tuple[tuple[float, ...], ...]:
        (a, d, e), (_, b, f), (_, _, c) = self.orthogonal()
        return ((1 / a, -d / (a * b), (d * f - e * b) / (a * b * c)), (0.0, 1 / b, -f / (b * c)), (0.0, 0.0, 1 / c))

    def volume(self) -> float:
        m = self.orthogonal()
        return m[0][0] * m[1][1] * m[2][2]


@dataclass(frozen=True)
class CellOf:
    """The unit cell of each row, from its columns ``edges`` (three numbers), ``orth`` and ``frac`` (nine, row by row)."""

    def _edge(self, i: int) -> Column:
        return F.get("edges", F.lit(i))

    @property
    def a(self) -> Column:
        return self._edge(0)

    @property
    def b(self) -> Column:
        return self._edge(1)

    @property
    def c(self) -> Column:
        return self._edge(2)

    def orthogonal(self) -> tuple[tuple[Column, ...], ...]:
        return tuple(tuple(F.get("orth", F.lit(3 * r + c)) for c in range(3)) for r in range(3))

    def fractional(self) -> tuple[tuple[Column, ...], ...]:
        return tuple(tuple(F.get("frac", F.lit(3 * r + c)) for c in range(3)) for r in range(3))


LATTICE = "edges array<double>, orth array<double>, frac array<double>, dims array<int>"


def lattice(cell: Cell, dims: tuple[int, ...]) -> tuple[list[float], list[float], list[float], list[int]]:
    """A cell and a grid as the columns of ``LATTICE``."""
    flat = [[float(x) for row in m for x in row] for m in (cell.orthogonal(), cell.fractional())]
    return [float(cell.a), float(cell.b), float(cell.c)], *flat, [int(n) for n in dims]


def apply(matrix: tuple[tuple[float, ...], ...], v: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    """Terms with a zero factor are left out of the expression."""
    out = []
    for row in matrix:
        terms = [x * m for m, x in zip(row, v, strict=True) if isinstance(m, Column) or m]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return tuple(out)
