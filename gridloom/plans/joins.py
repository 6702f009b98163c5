"""Join hints behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_checked(table: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """``table`` marked for broadcast if it has at most ``most_rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(table) if table.limit(most_rows + 1).count() <= most_rows else table
