"""Elementary functions that take Spark columns and plain numbers alike, so that one formula serves both."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float


def _both(column, number):
    return lambda x: column(x) if isinstance(x, Column) else number(x)


sin, cos, tan = _both(F.sin, math.sin), _both(F.cos, math.cos), _both(F.tan, math.tan)
asin, atan = _both(F.asin, math.asin), _both(F.atan, math.atan)
exp, log, sqrt = _both(F.exp, math.exp), _both(F.log, math.log), _both(F.sqrt, math.sqrt)
radians, degrees = _both(F.radians, math.radians), _both(F.degrees, math.degrees)


def power(x: Number, y: Number) -> Number:
    return F.pow(x, y) if isinstance(x, Column) or isinstance(y, Column) else math.pow(x, y)


def atan2(y: Number, x: Number) -> Number:
    return F.atan2(y, x) if isinstance(x, Column) or isinstance(y, Column) else math.atan2(y, x)

