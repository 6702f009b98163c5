"""What every format reader gives: variables on (t, y, x), and blocks that can be read one by one."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Protocol

import numpy as np

from gridloom.errors import VariableNotFoundError
from gridloom.functions.projections import CRS


@dataclass
class Variable:
    """A variable's description; axes are native coordinates, times Unix seconds (empty: steps without dates)."""

    name: str
    shape: tuple[int, int, int]
    y: list[float]
    x: list[float]
    times: list[float] = field(default_factory=list)
    units: str = ""
    long_name: str = ""
    dims: tuple[str, ...] = ("time", "lat", "lon")
    crs: dict = field(default_factory=dict)
    attrs: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    supported: bool = True

    def projection(self) -> CRS:
        return CRS(**self.crs)

    def bbox(self) -> tuple[float, float, float, float] | None:
        """Extent of the cell centres in degrees; longitudes above 180 are taken a turn west unless that splits the grid."""
        if not self.y or not self.x:
            return None
        west, south, east, north = min(self.x), min(self.y), max(self.x), max(self.y)
        if self.projection().kind != "geographic":
            return self.projection().bounds_wgs84((west, south, east, north))
        if west > 180:
            west, east = west - 360, east - 360
        elif east > 180:
            west, east = -180.0, 180.0
        return west, south, east, north

    def as_row(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Block:
    """A box of a variable that is stored together: first indices and sizes, and what its reader needs to find it."""

    t: int
    nt: int
    y: int
    ny: int
    x: int
    nx: int
    token: str = ""


class Reader(Protocol):
    """Reads one file. ``read`` gives float32 of shape (nt, ny, nx), NaN where a value is missing."""

    def variables(self) -> list[Variable]: ...
    def blocks(self, variable: Variable) -> list[Block]: ...
    def read(self, variable: Variable, block: Block) -> np.ndarray: ...


def find(variables: list[Variable], name: str) -> Variable:
    for v in variables:
        if v.name == name:
            return v
    raise VariableNotFoundError(f"no variable {name!r}; there are {', '.join(v.name for v in variables)}")
