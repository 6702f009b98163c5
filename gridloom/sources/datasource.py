"""Grid files as a Spark data source: ``spark.read.format("grid").option("variable", ...).load(path)``.

An input partition is neighbouring blocks of ``grids.CELLS_PER_TASK`` cells at most, or one larger block. Predicates on t, iy and ix prune blocks before anything is read, if
``spark.sql.python.filterPushdown.enabled`` is on; without it the variable option still does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloom.sources import grids
from gridloom.sources.model import Block

#: Partitions of a variable at least, if it has as many blocks.
LEAST_PARTS = 64
#: Column to the block fields that bound it.
SPANS = {"t": ("t", "nt"), "iy": ("y", "ny"), "ix": ("x", "nx")}


@dataclass
class BlockPartition(InputPartition):
    path: str
    variable: str
    blocks: list[Block]


class GridDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return grids.CELLS

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)

    def writer(self, schema, overwrite: bool):
        """Chunks of a Zarr store; see ``writers``."""
        from gridloom.sources.writers import ZarrWriter

        return ZarrWriter(self.options)


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.names = [v.strip() for v in options["variable"].split(",")] if "variable" in options else None
        self.bounds: dict[str, tuple[int, int]] = {}
        self.chosen: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds for pruning are noted; Spark still applies every filter to the cells of what is left."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if isinstance(f, EqualTo) and name == "variable":
                self.chosen = f.value
            if name in SPANS and isinstance(getattr(f, "value", None), int):
                low, high = self.bounds.get(name, (0, 1 << 62))
                if isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    high = min(high, f.value - isinstance(f, LessThan))
                self.bounds[name] = (low, high)
            yield f

    def partitions(self) -> list[BlockPartition]:
        _, reader = grids.open_reader(self.path)
        out = []
        for v in reader.variables():
            if not v.supported or (self.names is not None and v.name not in self.names) or (self.chosen is not None and v.name != self.chosen):
                continue
            held, cells = [], 0
            inside = [b for b in reader.blocks(v) if all(getattr(b, SPANS[c][0]) <= high and getattr(b, SPANS[c][0]) + getattr(b, SPANS[c][1]) > low for c, (low, high) in self.bounds.items())]
            most = max(1, min(grids.CELLS_PER_TASK, sum(b.nt * b.ny * b.nx for b in inside) // LEAST_PARTS))
            for b in inside:
                n = b.nt * b.ny * b.nx
                if held and cells + n > most:
                    out.append(BlockPartition(self.path, v.name, held))
                    held, cells = [], 0
                held, cells = [*held, b], cells + n
            if held:
                out.append(BlockPartition(self.path, v.name, held))
        return out

    def read(self, partition: BlockPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was left
            return
        reader, variables = grids.cached(partition.path)
        v = variables[partition.variable]
        for block in partition.blocks:
            yield from grids.cells(partition.path, v.name, block, reader.read(v, block))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridDataSource)
