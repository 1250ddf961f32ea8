"""Rows for a memory target, for sizes of partitions and of Arrow batches."""

from __future__ import annotations

CONTINUOUS_BYTES, CATEGORICAL_BYTES, COORDINATE_BYTES = 4, 4, 8


def points_for(megabytes: float, continuous: int, categorical: int, halfwidth: int = 0, coordinates: int = 2) -> int:
    """Points, patches included, that fit into a memory target; at least one."""
    side = 2 * halfwidth + 1
    each = (CONTINUOUS_BYTES * continuous + CATEGORICAL_BYTES * categorical + COORDINATE_BYTES * coordinates) * side * side
    return max(1, round(megabytes * 1e6 / each)) if each else 1


def rows_for(megabytes: float, width: int, continuous: int, categorical: int) -> int:
    """Image rows that fit into a memory target; at least one."""
    return max(1, round(points_for(megabytes, continuous, categorical, coordinates=0) / width))
