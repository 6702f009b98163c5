"""What a dataset holds: variables, shapes, time spans, extents; sets of names, boxes and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import VariableNotFoundError
from gridloom.plans.joins import broadcast_checked

Box = tuple[float, float, float, float]


def require_variables(available: list[str], wanted: list[str] | None, supported: list[str] | None = None) -> list[str]:
    """The wanted names, or all; missing ones raise, unsupported ones are dropped."""
    supported = available if supported is None else supported
    if wanted is None:
        return [v for v in available if v in supported]
    if missing := [v for v in wanted if v not in available]:
        raise VariableNotFoundError(f"no variable {', '.join(missing)}; there are {', '.join(available)}")
    return [v for v in wanted if v in supported]


def variables(rows: DataFrame, by: str = "variable", time: str = "ts") -> DataFrame:
    """One row for each variable: number of rows, of distinct times, first and last time."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(time).alias("n_times"), F.min(time).alias("start"), F.max(time).alias("end"))


def hoist_times(per_variable: DataFrame, times: str = "times") -> DataFrame:
    """One row: the time list all variables share, or null if they differ."""
    return per_variable.agg(F.when(F.countDistinct(times) == 1, F.first(times)).alias("times"))


def distinct_times(messages: DataFrame, by: str = "variable", time: str = "valid_time", place: str = "start") -> DataFrame:
    """Each variable's distinct times with the place where each was first seen."""
    return messages.groupBy(by, time).agg(F.min(place).alias("first_seen"))


def extent(points: DataFrame, wrap: bool = True) -> DataFrame:
    """min_lon, min_lat, max_lon, max_lat; with ``wrap`` longitudes above 180 are taken a turn west."""
    lon = F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")) if wrap else F.col("lon")
    return points.agg(F.min(lon).alias("min_lon"), F.min("lat").alias("min_lat"), F.max(lon).alias("max_lon"), F.max("lat").alias("max_lat"))


def intersect_boxes(boxes: DataFrame, box: Box) -> DataFrame:
    """``boxes`` (min_lon, min_lat, max_lon, max_lat) cut to ``box``; those that only touch it drop out."""
    cut = boxes.withColumns({
        "min_lon": F.greatest("min_lon", F.lit(box[0])), "min_lat": F.greatest("min_lat", F.lit(box[1])),
        "max_lon": F.least("max_lon", F.lit(box[2])), "max_lat": F.least("max_lat", F.lit(box[3])),
    })
    return cut.where("max_lon > min_lon and max_lat > min_lat")


def clamp_box(box: Box, coverage: Box, slack: float = 1e-9) -> Box:
    """A valid box inside the coverage, or an error."""
    from math import isfinite

    from gridloom.errors import ExtractError

    if len(box) != 4 or not all(isfinite(v) for v in box) or not (box[2] > box[0] and box[3] > box[1]):
        raise ExtractError("a box is (minLon, minLat, maxLon, maxLat), finite, each maximum above its minimum")
    if box[0] < coverage[0] - slack or box[1] < coverage[1] - slack or box[2] > coverage[2] + slack or box[3] > coverage[3] + slack:
        raise ExtractError(f"box {box} isn't inside {coverage}")
    return max(box[0], coverage[0]), max(box[1], coverage[1]), min(box[2], coverage[2]), min(box[3], coverage[3])


def native_size(shape: tuple[int, ...], file_box: Box, box: Box, least: int = 8, most: int = 1024) -> tuple[int, int]:
    """(width, height) that samples a box at the file's own resolution."""
    spans = [abs(b - a) or d for a, b, d in ((file_box[0], file_box[2], 360.0), (file_box[1], file_box[3], 180.0))]
    sizes = (shape[-1] * abs(box[2] - box[0]) / spans[0], shape[-2] * abs(box[3] - box[1]) / spans[1])
    return tuple(min(most, max(least, int(s + 0.5))) for s in sizes)


def missing_names(wanted: DataFrame, available: DataFrame, name: str = "variable") -> DataFrame:
    """Names asked for that aren't there."""
    return wanted.select(name).distinct().join(available.select(name).distinct(), name, "left_anti")


def needed_dimensions(variables_with_dims: DataFrame, kept: list[str], name: str = "variable", dims: str = "dims") -> DataFrame:
    """Distinct dimensions of the kept variables."""
    return variables_with_dims.where(F.col(name).isin(kept)).select(F.explode(dims).alias("dim")).distinct()


def pick_overview(overviews: DataFrame, width: int, height: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The smallest image with at least the size asked for, or else the largest; ``ties`` order equal ones. Top 1 of a few rows."""
    enough = (F.col("width") >= width) & (F.col("height") >= height)
    area = F.col("width") * F.col("height")
    return overviews.orderBy(F.when(enough, 0).otherwise(1), F.when(enough, area).otherwise(-area), *ties).limit(1)


#: The part of the WMO parameter table (discipline, category, number, name, units) that common products use. Whole
#: tables are read by ``read_parameters``.
PARAMETERS = (
    (0, 0, 0, "Temperature", "K"), (0, 0, 1, "Virtual temperature", "K"), (0, 0, 2, "Potential temperature", "K"),
    (0, 0, 3, "Pseudo-adiabatic potential temperature or equivalent potential temperature", "K"), (0, 0, 4, "Maximum temperature", "K"), (0, 0, 5, "Minimum temperature", "K"),
    (0, 0, 6, "Dewpoint temperature", "K"), (0, 0, 7, "Dewpoint depression (or deficit)", "K"), (0, 0, 8, "Lapse rate", "K m-1"), (0, 0, 9, "Temperature anomaly", "K"),
    (0, 0, 10, "Latent heat net flux", "W m-2"), (0, 0, 11, "Sensible heat net flux", "W m-2"), (0, 0, 12, "Heat index", "K"), (0, 0, 13, "Wind chill factor", "K"),
    (0, 0, 14, "Minimum dewpoint depression", "K"), (0, 0, 15, "Virtual potential temperature", "K"), (0, 0, 16, "Snow phase change heat flux", "W m-2"), (0, 0, 17, "Skin temperature", "K"),
    (0, 0, 18, "Snow temperature (top of snow)", "K"), (0, 0, 19, "Turbulent transfer coefficient for heat", "Numeric"), (0, 0, 20, "Turbulent diffusion coefficient for heat", "m2 s-1"),
    (0, 0, 21, "Apparent temperature", "K"),
    (0, 1, 0, "Specific humidity", "kg kg-1"), (0, 1, 1, "Relative humidity", "%"), (0, 1, 2, "Humidity mixing ratio", "kg kg-1"), (0, 1, 3, "Precipitable water", "kg m-2"),
    (0, 1, 4, "Vapour pressure", "Pa"), (0, 1, 5, "Saturation deficit", "Pa"), (0, 1, 6, "Evaporation", "kg m-2"), (0, 1, 7, "Precipitation rate", "kg m-2 s-1"),
    (0, 1, 8, "Total precipitation", "kg m-2"), (0, 1, 9, "Large-scale precipitation (non-convective)", "kg m-2"), (0, 1, 10, "Convective precipitation", "kg m-2"),
    (0, 1, 11, "Snow depth", "m"), (0, 1, 12, "Snowfall rate water equivalent", "kg m-2 s-1"), (0, 1, 13, "Water equivalent of accumulated snow depth", "kg m-2"),
    (0, 1, 14, "Convective snow", "kg m-2"), (0, 1, 15, "Large-scale snow", "kg m-2"), (0, 1, 16, "Snow melt", "kg m-2"), (0, 1, 17, "Snow age", "d"),
    (0, 1, 18, "Absolute humidity", "kg m-3"), (0, 1, 19, "Precipitation type", "Code table 4.201"), (0, 1, 20, "Integrated liquid water", "kg m-2"), (0, 1, 21, "Condensate", "kg kg-1"),
    (0, 1, 22, "Cloud mixing ratio", "kg kg-1"), (0, 1, 23, "Ice water mixing ratio", "kg kg-1"), (0, 1, 24, "Rain mixing ratio", "kg kg-1"), (0, 1, 25, "Snow mixing ratio", "kg kg-1"),
    (0, 1, 26, "Horizontal moisture convergence", "kg kg-1 s-1"), (0, 1, 27, "Maximum relative humidity", "%"), (0, 1, 28, "Maximum absolute humidity", "kg m-3"),
    (0, 1, 29, "Total snowfall", "m"),
    (0, 2, 0, "Wind direction (from which blowing)", "Degree true"), (0, 2, 1, "Wind speed", "m s-1"), (0, 2, 2, "u-component of wind", "m s-1"), (0, 2, 3, "v-component of wind", "m s-1"),
    (0, 2, 4, "Stream function", "m2 s-1"), (0, 2, 5, "Velocity potential", "m2 s-1"), (0, 2, 6, "Montgomery stream function", "m2 s-2"),
    (0, 2, 7, "Sigma coordinate vertical velocity", "s-1"), (0, 2, 8, "Vertical velocity (pressure)", "Pa s-1"), (0, 2, 9, "Vertical velocity (geometric)", "m s-1"),
    (0, 2, 10, "Absolute vorticity", "s-1"), (0, 2, 11, "Absolute divergence", "s-1"), (0, 2, 12, "Relative vorticity", "s-1"), (0, 2, 13, "Relative divergence", "s-1"),
    (0, 2, 14, "Potential vorticity", "K m2 kg-1 s-1"), (0, 2, 15, "Vertical u-component shear", "s-1"), (0, 2, 16, "Vertical v-component shear", "s-1"),
    (0, 2, 17, "Momentum flux, u-component", "N m-2"), (0, 2, 18, "Momentum flux, v-component", "N m-2"), (0, 2, 19, "Wind mixing energy", "J"),
    (0, 2, 20, "Boundary layer dissipation", "W m-2"), (0, 2, 21, "Maximum wind speed", "m s-1"), (0, 2, 22, "Wind speed (gust)", "m s-1"), (0, 2, 23, "u-component of wind (gust)", "m s-1"),
    (0, 2, 24, "v-component of wind (gust)", "m s-1"), (0, 2, 25, "Vertical speed shear", "s-1"), (0, 2, 26, "Horizontal momentum flux", "N m-2"),
    (0, 2, 27, "u-component storm motion", "m s-1"), (0, 2, 28, "v-component storm motion", "m s-1"), (0, 2, 29, "Drag coefficient", "Numeric"),
    (0, 3, 0, "Pressure", "Pa"), (0, 3, 1, "Pressure reduced to MSL", "Pa"), (0, 3, 2, "Pressure tendency", "Pa s-1"), (0, 3, 3, "ICAO Standard Atmosphere Reference Height", "m"),
    (0, 3, 4, "Geopotential", "m2 s-2"), (0, 3, 5, "Geopotential height", "gpm"), (0, 3, 6, "Geometric height", "m"), (0, 3, 7, "Standard deviation of height", "m"),
    (0, 3, 8, "Pressure anomaly", "Pa"), (0, 3, 9, "Geopotential height anomaly", "gpm"), (0, 3, 10, "Density", "kg m-3"), (0, 3, 11, "Altimeter setting", "Pa"),
    (0, 3, 12, "Thickness", "m"), (0, 3, 13, "Pressure altitude", "m"), (0, 3, 14, "Density altitude", "m"), (0, 3, 15, "5-wave geopotential height", "gpm"),
    (0, 3, 16, "Zonal flux of gravity wave stress", "N m-2"), (0, 3, 17, "Meridional flux of gravity wave stress", "N m-2"), (0, 3, 18, "Planetary boundary layer height", "m"),
    (0, 4, 0, "Net short-wave radiation flux (surface)", "W m-2"), (0, 4, 1, "Net short-wave radiation flux (top of atmosphere)", "W m-2"), (0, 4, 2, "Short-wave radiation flux", "W m-2"),
    (0, 4, 3, "Global radiation flux", "W m-2"), (0, 4, 4, "Brightness temperature", "K"), (0, 4, 5, "Radiance (with respect to wave number)", "W m-1 sr-1"),
    (0, 4, 6, "Radiance (with respect to wavelength)", "W m-3 sr-1"), (0, 4, 7, "Downward short-wave radiation flux", "W m-2"), (0, 4, 8, "Upward short-wave radiation flux", "W m-2"),
    (0, 5, 0, "Net long-wave radiation flux (surface)", "W m-2"), (0, 5, 1, "Net long-wave radiation flux (top of atmosphere)", "W m-2"), (0, 5, 2, "Long-wave radiation flux", "W m-2"),
    (0, 5, 3, "Downward long-wave radiation flux", "W m-2"), (0, 5, 4, "Upward long-wave radiation flux", "W m-2"),
    (0, 6, 0, "Cloud ice", "kg m-2"), (0, 6, 1, "Total cloud cover", "%"), (0, 6, 2, "Convective cloud cover", "%"), (0, 6, 3, "Low cloud cover", "%"), (0, 6, 4, "Medium cloud cover", "%"),
    (0, 6, 5, "High cloud cover", "%"), (0, 6, 6, "Cloud water", "kg m-2"), (0, 6, 7, "Cloud amount", "%"), (0, 6, 8, "Cloud type", "Code table 4.203"),
    (0, 6, 9, "Thunderstorm maximum tops", "m"), (0, 6, 10, "Thunderstorm coverage", "Code table 4.204"), (0, 6, 11, "Cloud base", "m"), (0, 6, 12, "Cloud top", "m"),
    (0, 6, 13, "Ceiling", "m"),
    (0, 7, 0, "Parcel lifted index (to 500 hPa)", "K"), (0, 7, 1, "Best lifted index (to 500 hPa)", "K"), (0, 7, 2, "K index", "K"), (0, 7, 3, "KO index", "K"),
    (0, 7, 4, "Total totals index", "K"), (0, 7, 5, "Sweat index", "Numeric"), (0, 7, 6, "Convective available potential energy", "J kg-1"), (0, 7, 7, "Convective inhibition", "J kg-1"),
    (0, 7, 8, "Storm relative helicity", "J kg-1"), (0, 7, 9, "Energy helicity index", "Numeric"), (0, 7, 10, "Surface lifted index", "K"), (0, 7, 11, "Best (4-layer) lifted index", "K"),
    (0, 7, 12, "Richardson number", "Numeric"),
    (0, 14, 0, "Total ozone", "DU"), (0, 14, 1, "Ozone mixing ratio", "kg kg-1"), (0, 14, 2, "Total column integrated ozone", "DU"),
    (0, 19, 0, "Visibility", "m"), (0, 19, 1, "Albedo", "%"), (0, 19, 2, "Thunderstorm probability", "%"), (0, 19, 3, "Mixed layer depth", "m"),
    (0, 19, 4, "Volcanic ash", "Code table 4.206"), (0, 19, 5, "Icing top", "m"), (0, 19, 6, "Icing base", "m"), (0, 19, 7, "Icing", "Code table 4.207"), (0, 19, 8, "Turbulence top", "m"),
    (0, 19, 9, "Turbulence base", "m"), (0, 19, 10, "Turbulence", "Code table 4.208"), (0, 19, 11, "Turbulent kinetic energy", "J kg-1"),
    (2, 0, 0, "Land cover (0 = sea, 1 = land)", "Proportion"), (2, 0, 1, "Surface roughness", "m"), (2, 0, 2, "Soil temperature", "K"), (2, 0, 3, "Soil moisture content", "kg m-2"),
    (2, 0, 4, "Vegetation", "%"), (2, 0, 5, "Water runoff", "kg m-2"), (2, 0, 6, "Evapotranspiration", "kg-2 s-1"), (2, 0, 7, "Model terrain height", "m"),
    (2, 0, 8, "Land use", "Code table 4.212"),
    (10, 0, 0, "Wave spectra (1)", ""), (10, 0, 1, "Wave spectra (2)", ""), (10, 0, 2, "Wave spectra (3)", ""), (10, 0, 3, "Significant height of combined wind waves and swell", "m"),
    (10, 0, 4, "Direction of wind waves", "Degree true"), (10, 0, 5, "Significant height of wind waves", "m"), (10, 0, 6, "Mean period of wind waves", "s"),
    (10, 0, 7, "Direction of swell waves", "Degree true"), (10, 0, 8, "Significant height of swell waves", "m"), (10, 0, 9, "Mean period of swell waves", "s"),
    (10, 0, 10, "Primary wave direction", "Degree true"), (10, 0, 11, "Primary wave mean period", "s"),
    (10, 1, 0, "Current direction", "Degree true"), (10, 1, 1, "Current speed", "m s-1"), (10, 1, 2, "u-component of current", "m s-1"), (10, 1, 3, "v-component of current", "m s-1"),
    (10, 2, 0, "Ice cover", "Proportion"), (10, 2, 1, "Ice thickness", "m"), (10, 2, 2, "Direction of ice drift", "Degree true"), (10, 2, 3, "Speed of ice drift", "m s-1"),
    (10, 2, 4, "u-component of ice drift", "m s-1"), (10, 2, 5, "v-component of ice drift", "m s-1"), (10, 2, 6, "Ice growth rate", "m s-1"), (10, 2, 7, "Ice divergence", "s-1"),
    (10, 3, 0, "Water temperature", "K"), (10, 3, 1, "Deviation of sea level from mean", "m"),
    (10, 4, 0, "Main thermocline depth", "m"), (10, 4, 1, "Main thermocline anomaly", "m"), (10, 4, 2, "Transient thermocline depth", "m"), (10, 4, 3, "Salinity", "kg kg-1"),
)
KEY = ("discipline", "category", "number")


def parameter_table(spark: SparkSession, rows: tuple = PARAMETERS) -> DataFrame:
    return spark.createDataFrame(list(rows), "discipline int, category int, number int, name string, units string")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """A whole parameter table, from the CSV files in which the WMO publishes code table 4.2: the subtitle names discipline
    and category, the code flag is the number (ranges and reserved numbers are left out)."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    title, unit = F.col("SubTitle_en"), next((c for c in rows.columns if c.startswith("UnitComments")), None)
    number = lambda word: F.regexp_extract(title, rf"(?i){word}\s+(\d+)", 1)
    found = rows.where(F.col("CodeFlag").rlike(r"^\d+$") & title.rlike(r"(?i)discipline\s+\d+.*category\s+\d+"))
    return found.select(
        number("discipline").cast("int").alias("discipline"), number("category").cast("int").alias("category"), F.col("CodeFlag").cast("int").alias("number"),
        F.trim("MeaningParameterDescription_en").alias("name"), (F.coalesce(F.trim(unit), F.lit("")) if unit else F.lit("")).alias("units"),
    )


def name_parameters(messages: DataFrame, table: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """``messages`` with name and units: a centre's own entry first, then the common table, else an honest label.

    Both tables are broadcast if they are as small as dimension tables should be.
    """
    table = broadcast_checked(table)
    out = messages.join(table.select(*KEY, F.col("name").alias("_name"), F.col("units").alias("_units")), list(KEY), "left")
    if local is not None:
        out = out.join(broadcast_checked(local).select("centre", *KEY, F.col("name").alias("_own"), F.col("units").alias("_own_units")), ["centre", *KEY], "left")
    else:
        out = out.withColumns({"_own": F.lit(None).cast("string"), "_own_units": F.lit(None).cast("string")})
    label = F.format_string("Unknown (discipline=%d, category=%d, number=%d)", *KEY)
    return out.withColumn("name", F.coalesce("_own", "_name", label)).withColumn("units", F.coalesce("_own_units", "_units", F.lit(""))).drop("_name", "_units", "_own", "_own_units")
