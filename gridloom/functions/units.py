"""Unpacking, missing values and conversion to metric units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the fill value where a file names none.
DEFAULT_FILL = 9.969209968386869e36
#: Fixed value: beyond this size a value counts as missing.
LARGEST = 1e37

#: Names of units, unit they convert to, factor and summand.
CONVERSIONS = (
    (("k",), "°C", 1.0, -273.15),
    (("°c", "degc", "c", "celsius"), "°C", 1.0, 0.0),
    (("°f", "degf", "f", "fahrenheit"), "°C", 5 / 9, -160 / 9),
    (("pa", "pascal", "pascals"), "hPa", 0.01, 0.0),
    (("hpa", "mb", "mbar", "millibar", "millibars"), "hPa", 1.0, 0.0),
    (("kpa",), "hPa", 10.0, 0.0),
    (("m/s", "ms-1", "meters/second", "metres/second"), "m/s", 1.0, 0.0),
    (("knot", "knots", "kt", "kn"), "m/s", 0.514444, 0.0),
    (("km/h", "km/hr", "kmh", "kph"), "m/s", 1 / 3.6, 0.0),
    (("mph", "mi/h"), "m/s", 0.44704, 0.0),
    (("kg/m2", "kgm-2"), "mm", 1.0, 0.0),
    (("mm",), "mm", 1.0, 0.0),
    (("in", "inch", "inches"), "mm", 25.4, 0.0),
    (("kg/m2/day", "kgm-2day-1"), "mm/day", 1.0, 0.0),
    (("mm/day", "mmday-1"), "mm/day", 1.0, 0.0),
    (("kg/m2/s", "kgm-2s-1"), "mm/s", 1.0, 0.0),
    (("m", "meter", "metre", "meters", "metres", "gpm"), "m", 1.0, 0.0),
    (("ft", "feet", "foot"), "m", 0.3048, 0.0),
)


def finite(value: Column) -> Column:
    """The value, or null if it is NaN, infinite or beyond the largest real value."""
    return F.when(~F.isnan(value) & (F.abs(value) <= LARGEST), value)


def unpack(raw: Column, scale: float = 1.0, offset: float = 0.0, fill: float | None = DEFAULT_FILL) -> Column:
    """raw * scale + offset; null where ``raw``, before scaling, is the fill value."""
    value = raw.cast("double") * scale + offset
    return value if fill is None else F.when(raw.cast("double") != fill, value)


def unit_table(spark: SparkSession) -> DataFrame:
    """One row for each name of a unit: alias, unit, mul, add. Its size is fixed."""
    return spark.createDataFrame([(name, to, mul, add) for names, to, mul, add in CONVERSIONS for name in names], "alias string, unit string, mul double, add double")


def unit_key(unit: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), r"[\s^]+", "")


def to_metric(df: DataFrame, value: str = "value", unit: str = "units") -> DataFrame:
    """``df`` with metric_value, metric_unit and known_unit; unknown units pass through."""
    table = unit_table(df.sparkSession).select(F.col("alias").alias("_alias"), F.col("unit").alias("_to"), F.col("mul").alias("_mul"), F.col("add").alias("_add"))
    joined = df.join(F.broadcast(table), unit_key(F.col(unit)) == F.col("_alias"), "left")
    known = F.col("_alias").isNotNull()
    return joined.withColumns({
        "metric_value": F.when(known, F.col(value) * F.col("_mul") + F.col("_add")).otherwise(F.col(value)),
        "metric_unit": F.when(known, F.col("_to")).otherwise(F.col(unit)), "known_unit": known,
    }).drop("_alias", "_to", "_mul", "_add")
