"""Georeferencing as column expressions: no UDFs, so that Catalyst sees every predicate.

A grid has ``width`` x ``height`` pixels; edge i along an axis lies at ``i * step + origin``
in double precision.  Pixel i begins at edge i, which belongs to it, and ends before edge
i + 1; only the last edge belongs to the last pixel.  Steps may be negative.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


class OutsideGrid(ValueError):
    """A point lies outside the grid."""


@dataclass(frozen=True)
class Axis:
    origin: float
    step: float
    n: int

    def __post_init__(self):
        if not self.step or self.n < 1:
            raise ValueError("an axis needs a step other than 0 and at least one pixel")

    def edges(self) -> list[float]:
        return [i * self.step + self.origin for i in range(self.n + 1)]

    @property
    def low(self) -> float:
        return min(self.origin, self.n * self.step + self.origin)

    @property
    def high(self) -> float:
        return max(self.origin, self.n * self.step + self.origin)


@dataclass(frozen=True)
class GridSpec:
    """Both axes, and the coordinate system as opaque text pairs."""

    x: Axis
    y: Axis
    crs: dict[str, str] = field(default_factory=dict)

    @property
    def pixels(self) -> int:
        return self.x.n * self.y.n

    @property
    def box(self) -> tuple[float, float, float, float]:
        """x low, x high, y low, y high."""
        return self.x.low, self.x.high, self.y.low, self.y.high

    @property
    def affine(self) -> tuple[float, float, float, float, float, float]:
        """(a, b, c, d, e, f) with x = a * column + c and y = e * row + f, as read."""
        return self.x.step, 0.0, self.x.origin, 0.0, self.y.step, self.y.origin

    def strip(self, k: int, n: int) -> GridSpec:
        """The grid of strip k (from 1) of n.  Its edges are bit-identical to the whole grid's
        only through ``first_row``; use ``strip_bounds`` and the whole grid to place pixels."""
        start, stop = strip_bounds(self.y.n, n)[k - 1]
        return replace(self, y=Axis(start * self.y.step + self.y.origin, self.y.step, stop - start))

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> GridSpec:
        return GridSpec(Axis(**d["x"]), Axis(**d["y"]), d.get("crs") or {})


def edge(index: Column, axis: Axis) -> Column:
    """Position of an edge; for a pixel its leading edge (not its centre)."""
    return index.cast("double") * F.lit(float(axis.step)) + F.lit(float(axis.origin))


def pixel_position(index: Column, axis: Axis, outside: str = "error") -> Column:
    """Leading edge of a pixel whose index must lie on the axis."""
    good = (index >= 0) & (index < axis.n)
    return F.when(good, edge(index, axis)).when(index.isNotNull(), _refused(outside, index))


def pixel_index(coordinate: Column, axis: Axis, outside: str = "error") -> Column:
    """The pixel (int) that holds a coordinate: a projection in place of a range join.

    The quotient is corrected by one pixel either way against edges computed as above, which
    makes it agree with a search among the edges.  ``outside`` is ``error`` or ``null``;
    NaN counts as outside, null stays null.
    """
    sign = 1.0 if axis.step > 0 else -1.0
    c = coordinate.cast("double")
    on_axis = (c >= axis.low) & (c <= axis.high) & ~F.isnan(c)
    guess = F.floor((c - F.lit(float(axis.origin))) / F.lit(float(axis.step)))
    fixed = (
        F.when((c - edge(guess, axis)) * sign < 0, guess - 1)
        .when((c - edge(guess + 1, axis)) * sign >= 0, guess + 1)
        .otherwise(guess)
    )
    inside = F.greatest(F.least(fixed, F.lit(axis.n - 1)), F.lit(0)).cast("int")
    return F.when(on_axis, inside).when(c.isNotNull(), _refused(outside, c))


def pixel_index_among(coordinate: Column, edges: Column, outside: str = "error") -> Column:
    """As ``pixel_index`` for any ascending array of edges: a binary search folded over the
    bits of an index, without exploding the edges."""
    last = F.size(edges) - 1
    steps = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= last) & (F.get(edges, at + s) <= coordinate), at + s).otherwise(at))
    inside = (coordinate >= F.get(edges, F.lit(0))) & (coordinate <= F.get(edges, last)) & ~F.isnan(coordinate)
    return F.when(inside, F.least(found, last - 1)).when(coordinate.isNotNull(), _refused(outside, coordinate))


def _refused(outside: str, value: Column) -> Column:
    if outside == "null":
        return F.lit(None).cast("int")
    if outside == "error":
        return F.raise_error(F.concat(F.lit("outside the grid: "), value.cast("string"))).cast("int")
    raise ValueError(f"outside must be 'error' or 'null', not {outside!r}")


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in a closed box (x low, x high, y low, y high)."""
    return x.between(box[0], box[1]) & y.between(box[2], box[3])


def strip_bounds(total: int, n: int) -> list[tuple[int, int]]:
    """Half-open row ranges of n contiguous strips; the first ``total % n`` have one row more."""
    if not 1 <= n <= total:
        raise ValueError(f"{total} rows cannot make {n} strips")
    size, more = divmod(total, n)
    starts = [k * size + min(k, more) for k in range(n + 1)]
    return list(zip(starts[:-1], starts[1:]))


def strip_number(row: Column, total: int, n: int) -> Column:
    """The strip (from 1) of a row in closed form, equal to NTILE(n) over all rows in order."""
    size, more = divmod(total, n)
    head = more * (size + 1)
    early = F.floor(row / F.lit(size + 1))
    late = F.floor((row - head) / F.lit(size)) + more
    return (F.when(row < head, early).otherwise(late) + 1).cast("int")
