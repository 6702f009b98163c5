"""Subsets of cubes by index ranges, exact or widened to whole chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import TrimError

Ranges = dict[str, tuple[int, int]]


def hyperslab(cells: DataFrame, ranges: Ranges, rebase: bool = True) -> DataFrame:
    """Cells in inclusive index ranges, indices counted anew from the ranges' starts unless ``rebase`` is off."""
    for name, (low, high) in ranges.items():
        if low > high:
            raise TrimError(f"{name}: {low} is above {high}")
        cells = cells.where(F.col(name).between(low, high))
    return cells.withColumns({name: F.col(name) - low for name, (low, _) in ranges.items()}) if rebase else cells


def widen(ranges: Ranges, chunks: dict[str, int]) -> Ranges:
    """The index ranges of the chunks that hold any of ``ranges``."""
    return {name: (low // chunks.get(name, 1) * chunks.get(name, 1), (high // chunks.get(name, 1) + 1) * chunks.get(name, 1) - 1) for name, (low, high) in ranges.items()}


def whole_chunks(cells: DataFrame, ranges: Ranges, chunks: dict[str, int]) -> DataFrame:
    """Cells of all chunks that hold any of the ranges: predicates on bare columns, which scans can push down."""
    return hyperslab(cells, widen(ranges, chunks), rebase=False)
