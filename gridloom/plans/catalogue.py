"""Named queries over the driver's tables, each with the SQL that must give the same rows.

Two inputs are derived from ``events`` by integer arithmetic, so that engines agree on them bit for bit: ``points``
(event_id, ts, event_type, lat, lon, value) and ``cells`` (t, iy, ix, value), a cube of 12 x 24 cells a day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import color, geo, projections, text, times, units
from gridloom.operators import axes, catalog, cubes, nearest, points, sequences, statistics, subset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NY, NX = 12, 24
LATS = [82.5 - 15.0 * k for k in range(NY)]
LONS = [-172.5 + 15.0 * k for k in range(NX)]

POINTS = """points AS (SELECT event_id, ts, event_type, user_id, value, CAST((user_id * 37 + event_id * 11) % 180 AS DOUBLE) - 89.5 AS lat,
  CAST((user_id * 53 + event_id * 7) % 360 AS DOUBLE) - 179.5 AS lon FROM events)"""
CELLS = f"""cells AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, CAST(user_id % {NY} AS INTEGER) AS iy, CAST(event_id % {NX} AS INTEGER) AS ix,
  arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3)"""


def query(sql: str):
    """Register a query with its SQL; ``{points}`` and ``{cells}`` stand for the derived tables."""

    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql.replace("{points}", POINTS).replace("{cells}", CELLS)
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lat = ((F.col("user_id") * 37 + F.col("event_id") * 11) % 180).cast("double") - 89.5
    lon = ((F.col("user_id") * 53 + F.col("event_id") * 7) % 360).cast("double") - 179.5
    return e.select("event_id", "ts", "event_type", "user_id", "value", lat.alias("lat"), lon.alias("lon"))


def read_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = e.select(day.alias("t"), (F.col("user_id") % NY).cast("int").alias("iy"), (F.col("event_id") % NX).cast("int").alias("ix"), "value", "event_id")
    return points.pivot_mesh(rows)


def read_cube(spark: SparkSession, sf_dir: str) -> cubes.Cube:
    return cubes.Cube(read_cells(spark, sf_dir), axes.Axis(LATS), axes.Axis(LONS), [1704067200 + 86400 * k for k in range(31)])


WORLD = (-180.0, -90.0, 180.0, 90.0)


# -- rasters of points


@query("""WITH {points} SELECT CAST(least(greatest(floor((90 - lat) / 180 * 18), 0), 17) AS INTEGER) AS r, CAST(least(greatest(floor((lon + 180) / 360 * 36), 0), 35) AS INTEGER) AS c,
  round(avg(value), 6) AS value, count(*) AS n FROM points GROUP BY 1, 2""")
def mean_bin_raster(spark, sf_dir):
    return points.rasterize_mean(read_points(spark, sf_dir), WORLD, 36, 18).withColumn("value", F.round("value", 6))


@query("""WITH {points}, b AS (SELECT CAST(floor((40 - lat) / 80 * 16) AS INTEGER) AS r0, CAST(floor((lon + 90) / 180 * 18) AS INTEGER) AS c0, value FROM points WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -40 AND 40),
  g AS (SELECT least(greatest(r0, 0), 15) AS r, least(greatest(c0, 0), 17) AS c, round(avg(value), 6) AS value, count(*) AS n FROM b GROUP BY 1, 2)
  SELECT CAST(y.r AS INTEGER) AS r, CAST(x.c AS INTEGER) AS c, value, n FROM generate_series(0, 15) y(r) CROSS JOIN generate_series(0, 17) x(c) LEFT JOIN g ON g.r = y.r AND g.c = x.c""")
def mean_bin_raster_dense(spark, sf_dir):
    box = (-90.0, -40.0, 90.0, 40.0)
    return points.densify(points.rasterize_mean(read_points(spark, sf_dir), box, 18, 16).withColumn("value", F.round("value", 6)), 18, 16)


@query("""WITH {points}, d AS (SELECT event_type, 10.0 * floor(value / 10.0) AS low FROM points), f AS (SELECT event_type, low, count(*) AS n FROM d GROUP BY 1, 2) SELECT event_type, low, n FROM f""")
def value_histogram(spark, sf_dir):
    p = read_points(spark, sf_dir)
    return p.groupBy("event_type", (F.floor(F.col("value") / 10.0) * 10.0).alias("low")).agg(F.count(F.lit(1)).alias("n"))


# -- nearest points

TARGETS = [(31.4, -93.2), (-45.0, 10.0), (0.0, 179.9)]
_TARGETS_SQL = "t(query, at_lat, at_lon) AS (VALUES (0, 31.4::DOUBLE, -93.2::DOUBLE), (1, -45.0, 10.0), (2, 0.0, 179.9))"


@query(f"""WITH {{points}}, {_TARGETS_SQL}, d AS (SELECT query, event_id, lat, lon, value, row_number() OVER (PARTITION BY query ORDER BY (lat - at_lat) * (lat - at_lat) + (lon - at_lon) * (lon - at_lon), event_id) AS k FROM points, t)
  SELECT CAST(query AS INTEGER) AS query, event_id, lat, lon, value FROM d WHERE k = 1""")
def nearest_point(spark, sf_dir):
    return points.nearest(read_points(spark, sf_dir).select("event_id", "lat", "lon", "value"), TARGETS).select("query", "event_id", "lat", "lon", "value")


#: Targets that grow with the customers: poles, the 180th meridian and all between.
_MANY_SQL = """q AS (SELECT c_custkey, CAST((c_custkey * 37) % 1801 AS DOUBLE) / 10 - 90 AS t_lat, CAST((c_custkey * 101) % 3601 AS DOUBLE) / 10 - 180 AS t_lon FROM customer),
  v AS (SELECT c_custkey, t_lat, t_lon, cos(radians(t_lat)) * cos(radians(t_lon)) AS tx, cos(radians(t_lat)) * sin(radians(t_lon)) AS ty, sin(radians(t_lat)) AS tz FROM q),
  w AS (SELECT event_id, user_id, lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM points),
  d AS (SELECT c_custkey, event_id, user_id, lat, lon, round((tx - x) * (tx - x) + (ty - y) * (ty - y) + (tz - z) * (tz - z), 12) AS chord, round((t_lon - lon) * (t_lon - lon) / 129600 + (t_lat - lat) * (t_lat - lat) / 129600, 12) AS flat FROM v, w)"""


def many_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = ((F.col("c_custkey") * k % n).cast("double") / 10 - m for k, n, m in ((37, 1801, 90), (101, 3601, 180)))
    return read(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))


@query(f"WITH {{points}}, {_MANY_SQL} SELECT c_custkey, arg_min(event_id, (chord, event_id)) AS event_id, round(2 * 6371000.0 * asin(least(sqrt(min(chord)) / 2, 1)), 0) AS metres FROM d GROUP BY c_custkey")
def nearest_many(spark, sf_dir):
    found = nearest.nearest_many(read_points(spark, sf_dir).select("event_id", "lat", "lon"), many_targets(spark, sf_dir), target_id="c_custkey")
    return found.select("c_custkey", "point.event_id", F.round("distance", 0).alias("metres"))


@query(f"WITH {{points}}, {_MANY_SQL} SELECT c_custkey, arg_min(event_id, (flat, event_id)) AS event_id, round(sqrt(min(flat)) * 360, 3) AS degrees FROM d GROUP BY c_custkey")
def nearest_many_degrees(spark, sf_dir):
    found = nearest.nearest_many(read_points(spark, sf_dir).select("event_id", "lat", "lon"), many_targets(spark, sf_dir), target_id="c_custkey", metric="degrees")
    return found.select("c_custkey", "point.event_id", F.round("distance", 3).alias("degrees"))


@query(f"WITH {{points}}, {_MANY_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY chord, user_id, event_id) AS k FROM d) SELECT c_custkey, user_id AS iy, event_id AS ix, lat AS near_lat, lon AS near_lon FROM k WHERE k = 1")
def curvilinear_nearest_many(spark, sf_dir):
    cells = read_points(spark, sf_dir).select(F.col("user_id").alias("iy"), F.col("event_id").alias("ix"), "lat", "lon")
    return cubes.nearest_curvilinear_many(cells, many_targets(spark, sf_dir), "c_custkey").drop("metres")


_HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1, pow(sin((radians(lat) - radians({0})) / 2), 2) + cos(radians(lat)) * cos(radians({0})) * pow(sin((radians(lon) - radians({1})) / 2), 2))))"


@query(f"""WITH {{points}}, {_TARGETS_SQL}, d AS (SELECT query, event_id, lat, lon, value, row_number() OVER (PARTITION BY query ORDER BY {_HAVERSINE.format("at_lat", "at_lon")}, event_id) AS k FROM points, t)
  SELECT CAST(query AS INTEGER) AS query, event_id, lat, lon, value FROM d WHERE k = 1""")
def nearest_point_haversine(spark, sf_dir):
    return points.nearest(read_points(spark, sf_dir).select("event_id", "lat", "lon", "value"), TARGETS, points.by_haversine).select("query", "event_id", "lat", "lon", "value")


@query(f"""WITH {{points}} SELECT event_id, round({_HAVERSINE.format("48.85", "2.35")}, 3) AS metres FROM points""")
def haversine_distance(spark, sf_dir):
    return read_points(spark, sf_dir).select("event_id", F.round(geo.haversine(F.col("lat"), F.col("lon"), 48.85, 2.35), 3).alias("metres"))


@query("""WITH {points}, b AS (SELECT lat, lon FROM points ORDER BY (lat - 20.2) * (lat - 20.2) + (lon + 30.4) * (lon + 30.4), event_id LIMIT 1)
  SELECT p.lat, p.lon, strftime(p.ts, '%Y-%m-%dT%H:%M:%SZ') AS time, arg_max(p.value, p.event_id) AS value FROM points p, b WHERE abs(p.lat - b.lat) <= 1e-9 AND abs(p.lon - b.lon) <= 1e-9 GROUP BY p.lat, p.lon, p.ts""")
def station_series(spark, sf_dir):
    return points.station_series(read_points(spark, sf_dir), (20.2, -30.4)).select("lat", "lon", times.iso(F.col("ts")).alias("time"), "value")


@query("""WITH {points} SELECT event_id, lat, lon FROM points WHERE lon BETWEEN -30 AND 45 AND lat BETWEEN -10 AND 60""")
def bbox_points(spark, sf_dir):
    p = read_points(spark, sf_dir)
    return p.where(points.in_box(F.col("lat"), F.col("lon"), (-30.0, -10.0, 45.0, 60.0))).select("event_id", "lat", "lon")


@query("""WITH {points} SELECT event_id, lat, lon FROM points WHERE (lon >= 150 OR lon <= -150) AND lat BETWEEN -10 AND 60""")
def bbox_points_antimeridian(spark, sf_dir):
    p = read_points(spark, sf_dir)
    return p.where(points.in_box(F.col("lat"), F.col("lon"), (150.0, -10.0, -150.0, 60.0))).select("event_id", "lat", "lon")


@query("""WITH {points} SELECT event_id, CASE WHEN value IS NOT NULL AND NOT isnan(value) AND abs(value) <= 1e37 THEN value END AS value FROM points WHERE value IS NOT NULL AND NOT isnan(value)""")
def finite_values(spark, sf_dir):
    return read_points(spark, sf_dir).select("event_id", units.finite(F.col("value")).alias("value")).where("value is not null")


# -- time


@query("""SELECT event_id, CAST(dense_rank() OVER (ORDER BY ts) - 1 AS INTEGER) AS frame FROM events""")
def time_frames(spark, sf_dir):
    return points.frames(read_points(spark, sf_dir)).select("event_id", "frame")


_DAYS = "days AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, min(ts) AS ts FROM events GROUP BY 1)"


def _days(spark, sf_dir):
    e = read_points(spark, sf_dir)
    return e.groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t")).agg(F.min("ts").alias("ts"))


@query(f"""WITH {_DAYS} SELECT t, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time FROM days ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')), t LIMIT 1""")
def nearest_timestep(spark, sf_dir):
    at = int(times.parse_instant("2024-01-10T12:00:00Z").timestamp() * 1e6)
    d = _days(spark, sf_dir).select("t", times.iso(F.col("ts")).alias("time"), F.unix_micros("ts").alias("us"))
    return d.agg(F.min_by(F.struct("t", "time"), F.struct(F.abs(F.col("us") - at), "t")).alias("a")).select("a.*")


@query(f"""WITH {_DAYS} SELECT t, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time FROM days WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 23:59:59.999'""")
def date_range_select(spark, sf_dir):
    chosen = axes.select_dates(_days(spark, sf_dir), *times.date_bounds("2024-01-09", "2024-01-05"))
    return chosen.select("t", times.iso(F.col("ts")).alias("time"))


@query(f"""WITH {_DAYS} SELECT t, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time FROM days ORDER BY abs(epoch_us(ts) - (epoch_us(TIMESTAMP '2023-11-01') + epoch_us(TIMESTAMP '2023-11-02 23:59:59.999')) / 2), t LIMIT 1""")
def date_range_fallback(spark, sf_dir):
    chosen = axes.select_dates(_days(spark, sf_dir), *times.date_bounds("2023-11-01", "2023-11-02"))
    return chosen.select("t", times.iso(F.col("ts")).alias("time"))


@query("""WITH {cells} SELECT t, iy, ix, value FROM cells WHERE t BETWEEN 25 AND 30 AND iy = 3""")
def time_index_range(spark, sf_dir):
    return read_cube(spark, sf_dir).series(lat=LATS[3], t1=25, t2=400)


@query("""SELECT event_id, strftime(to_timestamp(946684800 + event_id * 21600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS time FROM events""")
def cf_decode_standard(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", times.decode_iso(F.col("event_id") * 6, "hours since 2000-01-01 00:00:00").alias("time"))


@query("""WITH d AS (SELECT event_id, event_id * 2 + 58 AS day FROM events), y AS (SELECT event_id, 2000 + day // 365 AS year, day % 365 AS doy FROM d),
  m(month, first) AS (VALUES (1, 0), (2, 31), (3, 59), (4, 90), (5, 120), (6, 151), (7, 181), (8, 212), (9, 243), (10, 273), (11, 304), (12, 334))
  SELECT event_id, printf('%d-%02d-%02dT00:00:00Z', year, max(month), doy - max(first) + 1) AS time FROM y JOIN m ON first <= doy GROUP BY event_id, year, doy""")
def cf_decode_noleap(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", times.decode_iso(F.col("event_id") * 2, "days since 2000-02-28", "noleap").alias("time"))


@query("""WITH s AS (SELECT event_id, event_id * 36000 AS sec FROM events) SELECT event_id, printf('%d-%02d-%02dT%02d:%02d:%02dZ', 1999 + sec // 31104000, sec // 2592000 % 12 + 1, sec // 86400 % 30 + 1, sec // 3600 % 24, sec // 60 % 60, sec % 60) AS time FROM s""")
def cf_decode_360(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", times.decode_iso(F.col("event_id") * 600, "minutes since 1999-01-01", "360_day").alias("time"))


@query("""WITH v AS (SELECT event_id, epoch_us(ts) AS us, event_id % 4 AS k FROM events)
  SELECT event_id, CAST(CASE k WHEN 0 THEN us * 1000 WHEN 1 THEN us WHEN 2 THEN us // 1000 ELSE us // 1000000 END AS DOUBLE) AS raw, CAST(floor(CASE k WHEN 0 THEN CAST(us * 1000 AS DOUBLE) / 1e9 WHEN 1 THEN CAST(us AS DOUBLE) / 1e6 WHEN 2 THEN CAST(us // 1000 AS DOUBLE) / 1e3 ELSE CAST(us // 1000000 AS DOUBLE) END + 0.5) AS BIGINT) AS seconds FROM v""")
def epoch_unit_guess(spark, sf_dir):
    us, k = F.unix_micros("ts"), F.col("event_id") % 4
    raw = F.when(k == 0, us * 1000).when(k == 1, us).when(k == 2, F.floor(us / 1000)).otherwise(F.floor(us / 1000000)).cast("double")
    return read_points(spark, sf_dir).select("event_id", raw.alias("raw")).withColumn("seconds", times.guess_seconds(F.col("raw")))


@query("""SELECT event_id, CAST(epoch(ts) AS BIGINT) - CAST(epoch(ts) AS BIGINT) % 3600 + CAST(CASE event_id % 4 WHEN 0 THEN 60 WHEN 2 THEN 86400 WHEN 3 THEN 3600 ELSE 3600 END * (event_id % 7) AS BIGINT) AS valid FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def grib_valid_time(spark, sf_dir):
    p = read_points(spark, sf_dir).withColumn("ref", F.date_trunc("hour", "ts"))
    unit = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(5)), (F.col("event_id") % 4 + 1).cast("int"))
    return p.select("event_id", F.unix_timestamp(times.grib_valid_time(F.col("ref"), unit, (F.col("event_id") % 7).cast("int"))).alias("valid"))


# -- meshes and cubes


@query("""WITH c AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, user_id % 12 AS lat, event_id % 24 AS lon, count(*) AS n FROM events GROUP BY 1, 2, 3),
  s AS (SELECT count(DISTINCT lon) AS nx, count(DISTINCT lat) AS ny, count(DISTINCT (lat, lon)) AS pairs, max(n) > 1 AS has_duplicates FROM c)
  SELECT nx, ny, pairs, has_duplicates, pairs / CAST(nx * ny AS DOUBLE) AS occupancy, CASE WHEN NOT has_duplicates AND pairs / CAST(nx * ny AS DOUBLE) >= 0.5 THEN 'mesh' ELSE 'point' END AS grid_type FROM s""")
def grid_classify(spark, sf_dir):
    p = read_points(spark, sf_dir).select(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("frame"), (F.col("user_id") % NY).alias("lat"), (F.col("event_id") % NX).alias("lon"))
    return points.classify(p)


@query("""WITH {cells} SELECT t, iy, ix, value FROM cells""")
def mesh_pivot_last_wins(spark, sf_dir):
    return read_cells(spark, sf_dir)


@query("""WITH {cells} SELECT t, iy, ix, value FROM cells WHERE iy = 3 AND ix = 5""")
def point_series(spark, sf_dir):
    """Nearest cell to (36.1, 262.9): the longitude comes on 0..360."""
    return read_cube(spark, sf_dir).series(lat=36.1, lon=262.9)


@query("""WITH {cells} SELECT t, iy, ix, value FROM cells WHERE ix = 9""")
def partial_slice(spark, sf_dir):
    return read_cube(spark, sf_dir).series(lon=-40.0)


@query("""SELECT event_type AS variable, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('click', 'view') AND user_id % 12 = 4 GROUP BY 1, 2""")
def multi_variable_series(spark, sf_dir):
    p = read_points(spark, sf_dir).withColumnRenamed("event_type", "variable").where(F.col("user_id") % NY == 4)
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return points.pivot_mesh(p.where(F.col("variable").isin("click", "view")).withColumn("t", day), ("variable", "t"))


_RASTER = """y(r, iy) AS (SELECT CAST(k AS INTEGER), CAST(ceil((90 - (60 - (k + 0.5) * 80.0 / 20)) / 15) - 1 AS INTEGER) FROM generate_series(0, 19) s(k)),
  x(c, ix) AS (SELECT CAST(k AS INTEGER), CAST(ceil((-60 + (k + 0.5) * 90.0 / 25 + 180) / 15) - 1 AS INTEGER) FROM generate_series(0, 24) s(k))"""
BOX = (-60.0, -20.0, 30.0, 60.0)


@query(f"""WITH {{cells}}, {_RASTER} SELECT r, c, value FROM cells JOIN y USING (iy) JOIN x USING (ix) WHERE t = 10""")
def resample_nearest(spark, sf_dir):
    return read_cube(spark, sf_dir).raster(BOX, 25, 20, t=10)


@query("""WITH {cells}, y(r, iy) AS (SELECT CAST(k AS INTEGER), CAST(least(11, greatest(0, ceil((90 - (95 - (k + 0.5) * 10)) / 15) - 1)) AS INTEGER) FROM generate_series(0, 18) s(k)),
  x(c, ix) AS (SELECT CAST(k AS INTEGER), CAST(ceil((-175 + (k + 0.5) * 10 + 180) / 15) - 1 AS INTEGER) FROM generate_series(0, 9) s(k)) SELECT r, c, value FROM cells JOIN y USING (iy) JOIN x USING (ix) WHERE t = 4""")
def resample_nearest_clamped(spark, sf_dir):
    """A raster that reaches beyond the grid, edge cells repeated there."""
    return read_cube(spark, sf_dir).raster((-175.0, -95.0, -75.0, 95.0), 10, 19, t=4, clamp=True)


@query(f"""WITH {{cells}}, {_RASTER}, m AS (SELECT ln(tan(pi() / 4 + radians(60) / 2)) AS top, ln(tan(pi() / 4 + radians(-20) / 2)) AS bottom),
  w AS (SELECT CAST(k AS INTEGER) AS row, CAST(least(19, greatest(0, floor((60 - degrees(2 * atan(exp(top + (k + 0.5) / 20 * (bottom - top))) - pi() / 2)) / 80 * 20))) AS INTEGER) AS r FROM generate_series(0, 19) s(k), m)
  SELECT w.row AS r, c, value FROM w JOIN y USING (r) JOIN cells USING (iy) JOIN x USING (ix) WHERE t = 10""")
def resample_mercator(spark, sf_dir):
    return read_cube(spark, sf_dir).mercator_raster(BOX, 25, 20, t=10)


@query("""WITH {cells}, p AS (SELECT CAST(k // 30 AS INTEGER) AS r, CAST(k % 30 AS INTEGER) AS c, 60 - (k // 30 + 0.5) * 4.0 AS lat, -60 + (k % 30 + 0.5) * 4.0 AS lon FROM generate_series(0, 599) s(k)),
  q AS (SELECT r, c, CAST(floor((6371007.181 * radians(lon) * cos(radians(lat)) + 11000000) / 1000000 + 0.5) AS INTEGER) AS ix, CAST(floor((6371007.181 * radians(lat) - 5500000) / -1000000 + 0.5) AS INTEGER) AS iy FROM p)
  SELECT r, c, value FROM q JOIN cells USING (iy, ix) WHERE t = 7""")
def resample_projected(spark, sf_dir):
    """The cube's axes taken as metres of a sinusoidal grid."""
    cube = cubes.Cube(read_cells(spark, sf_dir), axes.Axis([5.5e6 - 1e6 * k for k in range(NY)]), axes.Axis([-1.1e7 + 1e6 * k for k in range(NX)]), list(range(31)), projections.CRS("sinusoidal", a=6371007.181, e2=0.0))
    return cube.raster((-60.0, -20.0, 60.0, 60.0), 30, 20, t=7)


@query(f"""WITH {{cells}}, {_RASTER}, g AS (SELECT r, c, value FROM cells JOIN y USING (iy) JOIN x USING (ix) WHERE t = 10) SELECT round(-60 + c / 24.0 * 90, 9) AS x, value FROM g WHERE r = CAST(floor((60 - 20.3) / 80 * 19 + 0.5) AS INTEGER)""")
def transect_lon(spark, sf_dir):
    return cubes.transect(read_cube(spark, sf_dir).raster(BOX, 25, 20, t=10), BOX, 25, 20, 20.3).withColumn("x", F.round("x", 9))


@query(f"""WITH {{cells}}, {_RASTER}, g AS (SELECT r, c, value FROM cells JOIN y USING (iy) JOIN x USING (ix) WHERE t = 10) SELECT round(60 - r / 19.0 * 80, 9) AS x, value FROM g WHERE c = CAST(floor((-12.2 + 60) / 90 * 24 + 0.5) AS INTEGER)""")
def transect_lat(spark, sf_dir):
    return cubes.transect(read_cube(spark, sf_dir).raster(BOX, 25, 20, t=10), BOX, 25, 20, -12.2, axis="lat").withColumn("x", F.round("x", 9))


@query("""WITH {points} SELECT lat AS near_lat, lon AS near_lon, CAST(user_id AS BIGINT) AS iy, event_id AS ix FROM points
  ORDER BY round(sin(radians(lat)) * sin(radians(10.2)) + cos(radians(lat)) * cos(radians(10.2)) * cos(radians(33.3) - radians(lon)), 12) DESC, user_id, event_id LIMIT 1""")
def curvilinear_nearest(spark, sf_dir):
    p = read_points(spark, sf_dir).select(F.col("user_id").alias("iy"), F.col("event_id").alias("ix"), "lat", "lon")
    return cubes.nearest_curvilinear(p, 10.2, 33.3).select(F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"), "iy", "ix")


@query("""WITH {points} SELECT event_id, CAST(trunc((lon + 180) / 15) AS INTEGER) AS ix, CASE WHEN trunc((lat - 80) / -12) BETWEEN 0 AND 11 THEN CAST(trunc((lat - 80) / -12) AS INTEGER) END AS iy FROM points""")
def truncated_cell(spark, sf_dir):
    """Cells of a regular grid, the index cut towards zero."""
    return read_points(spark, sf_dir).select("event_id", geo.cell_index(F.col("lon"), -180.0, 15.0, 24).alias("ix"), geo.cell_index(F.col("lat"), 80.0, -12.0, 12).alias("iy"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal BETWEEN -180 AND 180 THEN c_acctbal ELSE ((c_acctbal + 180) - 360 * floor((c_acctbal + 180) / 360)) - 180 END AS lon, least(90, greatest(-90, c_acctbal / 50)) AS lat FROM customer""")
def normalize_coordinates(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    wrapped = F.round(geo.normalize_lon(F.col("c_acctbal")), 6)
    return c.select("c_custkey", wrapped.alias("lon"), geo.clamp_lat(F.col("c_acctbal") / 50).alias("lat"))


SQL["normalize_coordinates"] = """SELECT c_custkey, round(CASE WHEN c_acctbal BETWEEN -180 AND 180 THEN c_acctbal ELSE ((c_acctbal + 180) - 360 * floor((c_acctbal + 180) / 360)) - 180 END, 6) AS lon, least(90, greatest(-90, c_acctbal / 50)) AS lat FROM customer"""


@query("""WITH a(iy, lat) AS (SELECT CAST(k AS INTEGER), 82.5 - 15.0 * k FROM generate_series(0, 11) s(k)), q AS (SELECT c_custkey, least(90, greatest(-90, c_acctbal / 100)) AS target FROM customer)
  SELECT c_custkey, CAST(iy AS INTEGER) AS iy FROM (SELECT c_custkey, iy, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(lat - target), iy) AS k FROM q, a) WHERE k = 1""")
def batch_nearest_axis(spark, sf_dir):
    """Nearest index for every row: the axis is an array of its fixed length, searched inside the row."""
    q = read(spark, sf_dir, "customer").select("c_custkey", geo.clamp_lat(F.col("c_acctbal") / 100).alias("at"))
    axis = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(k).alias("i")) for k, v in enumerate(LATS)))
    near = F.array_min(F.transform(axis, lambda a: F.struct(F.abs(a["v"] - F.col("at")).alias("d"), a["i"].alias("i"))))
    return q.select("c_custkey", near["i"].alias("iy"))


# -- statistics


@query("""WITH {cells} SELECT t, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM cells GROUP BY t""")
def grid_stats(spark, sf_dir):
    return statistics.summarize(read_cells(spark, sf_dir), by=("t",)).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("""SELECT event_type, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS vmin, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS vmax FROM events WHERE user_id < 40 OR event_id = 7 GROUP BY event_type""")
def auto_range(spark, sf_dir):
    p = read_points(spark, sf_dir).where((F.col("user_id") < 40) | (F.col("event_id") == 7))
    return statistics.auto_range(p, by=("event_type",))


@query("""SELECT event_type, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS vmin, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS vmax FROM events GROUP BY event_type""")
def auto_range_all(spark, sf_dir):
    """As auto_range, over every row."""
    return statistics.auto_range(read_points(spark, sf_dir), by=("event_type",))


@query("""WITH {cells} SELECT min(value) AS vmin, max(value) AS vmax FROM cells WHERE t IN (0, 10, 19, 29)""")
def frame_global_range(spark, sf_dir):
    return statistics.auto_range(read_cells(spark, sf_dir).where(F.col("t").isin(sequences.evenly_chosen(30, 4))))


_PAIRS = "p AS (SELECT a.iy AS r, a.ix AS c, a.value AS a, b.value AS b FROM cells a JOIN cells b ON a.iy = b.iy AND a.ix = b.ix WHERE a.t = 3 AND b.t = 4)"


def _pairs(spark, sf_dir):
    cells = read_cells(spark, sf_dir).select("t", F.col("iy").alias("r"), F.col("ix").alias("c"), "value")
    return statistics.pair(cells.where("t = 3"), cells.where("t = 4"))


@query(f"""WITH {{cells}}, {_PAIRS} SELECT count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(a) * stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS pearson FROM p""")
def raster_pair_pearson(spark, sf_dir):
    return statistics.correlation(_pairs(spark, sf_dir)).withColumn("pearson", F.round("pearson", 6))


@query(f"""WITH {{cells}}, {_PAIRS} SELECT round(avg(b - a), 6) AS bias FROM p""")
def raster_pair_bias(spark, sf_dir):
    return statistics.bias(_pairs(spark, sf_dir)).withColumn("bias", F.round("bias", 6))


@query(f"""WITH {{cells}}, {_PAIRS}, k AS (SELECT r, c, a, b, row_number() OVER (ORDER BY r, c) - 1 AS k, count(*) OVER () AS n FROM p) SELECT r, c, a, b FROM k WHERE k % greatest(1, CAST(ceil(n / 40.0) AS BIGINT)) = 0""")
def raster_pair_stride(spark, sf_dir):
    return statistics.thin(_pairs(spark, sf_dir), 40)


@query("""SELECT n_name AS city, round(sum(value), 4) AS total, count(*) AS n FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def totals_by_city(spark, sf_dir):
    e, c, n = (read(spark, sf_dir, t) for t in ("events", "customer", "nation"))
    joined = e.join(c, F.col("user_id") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("city")).agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


# -- values, units, colours


@query("""SELECT event_id, CASE WHEN event_id % 97 <> 13 THEN (event_id % 97) * 0.1::DOUBLE + 250.0::DOUBLE END AS value FROM events""")
def cf_unpack(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", units.unpack(F.col("event_id") % 97, 0.1, 250.0, 13.0).alias("value"))


_NAMES = ("K", "degF", " hPa", "kg m^-2", "Knots", "furlong", "kPa", "mm/day")


@query("""WITH u(k, units, metric_unit, mul, add, known_unit) AS (VALUES (0, 'K', '°C', 1.0, -273.15, true), (1, 'degF', '°C', 5.0 / 9, -160.0 / 9, true), (2, ' hPa', 'hPa', 1.0, 0.0, true), (3, 'kg m^-2', 'mm', 1.0, 0.0, true),
  (4, 'Knots', 'm/s', 0.514444, 0.0, true), (5, 'furlong', 'furlong', 1.0, 0.0, false), (6, 'kPa', 'hPa', 10.0, 0.0, true), (7, 'mm/day', 'mm/day', 1.0, 0.0, true))
  SELECT event_id, units, round(value * mul + add, 6) AS metric_value, metric_unit, known_unit FROM events JOIN u ON event_id % 8 = k""")
def unit_convert(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("units", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 8 + 1).cast("int")))
    return units.to_metric(e).select("event_id", "units", F.round("metric_value", 6).alias("metric_value"), "metric_unit", "known_unit")


def _ramp_sql(name: str, t: str) -> str:
    stops = color.resolve_ramp(name)
    values = ", ".join(f"({k}, {t0!r}::DOUBLE, {t1!r}::DOUBLE, {c0[0]}, {c0[1]}, {c0[2]}, {c1[0]}, {c1[1]}, {c1[2]})" for k, ((t0, c0), (t1, c1)) in enumerate(zip(stops, stops[1:], strict=False)))
    channel = ", ".join(f"CAST(CASE WHEN {t} >= 1 THEN {x}1 ELSE floor((({t} - t0) / (t1 - t0)) * ({x}1 - {x}0) + ({x}0 + 0.5)) END AS INTEGER) AS {x}" for x in "rgb")
    return f"s(k, t0, t1, r0, g0, b0, r1, g1, b1) AS (VALUES {values}) SELECT event_id, {channel} FROM n JOIN s ON k = least({len(stops) - 2}, CAST(floor({t} * {len(stops) - 1}) AS INTEGER))"


@query(f"""WITH n AS (SELECT event_id, least(1, greatest(0, (value - 10) / (200.0 - 10))) AS t FROM events), {_ramp_sql("viridis", "t")}""")
def color_ramp_rgba(spark, sf_dir):
    t = color.normalize(F.col("value"), 10.0, 200.0)
    return read(spark, sf_dir, "events").select("event_id", color.sample_ramp("viridis", t).alias("s")).select("event_id", "s.*")


@query(f"""WITH n AS (SELECT event_id, least(1, greatest(0, (value - 0) / (300.0 - 0))) AS t FROM events), {_ramp_sql("RdBu", "t")}""")
def color_ramp_diverging(spark, sf_dir):
    t = color.normalize(F.col("value"), 0.0, 300.0)
    return read(spark, sf_dir, "events").select("event_id", color.sample_ramp("RdBu", t).alias("s")).select("event_id", "s.*")


# -- projections

_E2, _A = projections.WGS84_E2, projections.WGS84_A


def _project(crs, lat_scale=1.0):
    def run(spark, sf_dir):
        p = read_points(spark, sf_dir)
        x, y = crs.forward(F.col("lat") * lat_scale, F.col("lon") * lat_scale)
        return p.select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))

    return run


def _register_projection(name: str, crs, sql: str, scale: float = 1.0) -> None:
    QUERIES[name] = _project(crs, scale)
    SQL[name] = f"WITH {POINTS}, g AS (SELECT event_id, radians(lat * {scale}) AS phi, radians(lon * {scale}) - radians({crs.lon0}) AS lam FROM points), " + sql


_T = "tan(pi() / 4 - ({p}) / 2) / pow((1 - {e} * sin({p})) / (1 + {e} * sin({p})), {e} / 2)"
_e = repr(_E2**0.5)
_t = lambda p: _T.replace("{p}", p).replace("{e}", _e)
_m = lambda p: f"cos({p}) / sqrt(1 - {_E2} * sin({p}) * sin({p}))"
_q = lambda p: f"(1 - {_E2}) * (sin({p}) / (1 - {_E2} * sin({p}) * sin({p})) - 1 / (2 * {_e}) * ln((1 - {_e} * sin({p})) / (1 + {_e} * sin({p}))))"

_register_projection("project_sinusoidal", projections.CRS("sinusoidal", lon0=10.0, a=6371007.181, e2=0.0), "z AS (SELECT 1) SELECT event_id, round(6371007.181 * lam * cos(phi), 3) AS x, round(6371007.181 * phi, 3) AS y FROM g")
_register_projection("project_mercator", projections.CRS("mercator", e2=0.0), f"z AS (SELECT 1) SELECT event_id, round({_A} * lam, 3) AS x, round({_A} * ln(tan(pi() / 4 + phi / 2)), 3) AS y FROM g", 0.9)
_register_projection(
    "project_lcc", projections.CRS("lcc", lat0=39.0, lon0=-96.0, sp1=33.0, sp2=45.0),
    f"k AS (SELECT ln(({_m('radians(33)')}) / ({_m('radians(45)')})) / ln(({_t('radians(33)')}) / ({_t('radians(45)')})) AS n), f AS (SELECT n, {_A} * ({_m('radians(33)')}) / (n * pow({_t('radians(33)')}, n)) AS f FROM k) "
    f"SELECT event_id, round(f * pow({_t('phi')}, n) * sin(n * lam), 3) AS x, round(f * pow({_t('radians(39)')}, n) - f * pow({_t('phi')}, n) * cos(n * lam), 3) AS y FROM g, f", 0.9,
)
_register_projection(
    "project_polar", projections.CRS("polar-stereo", lon0=-45.0, true_scale_lat=70.0),
    f"k AS (SELECT {_A} * ({_m('radians(70)')}) / ({_t('radians(70)')}) AS k) SELECT event_id, round(k * ({_t('phi')}) * sin(lam), 3) AS x, round(-k * ({_t('phi')}) * cos(lam), 3) AS y FROM g, k", 0.9,
)
_register_projection(
    "project_albers", projections.CRS("albers", lat0=23.0, lon0=-96.0, sp1=29.5, sp2=45.5),
    f"k AS (SELECT (pow({_m('radians(29.5)')}, 2) - pow({_m('radians(45.5)')}, 2)) / (({_q('radians(45.5)')}) - ({_q('radians(29.5)')})) AS n), f AS (SELECT n, pow({_m('radians(29.5)')}, 2) + n * ({_q('radians(29.5)')}) AS w FROM k) "
    f"SELECT event_id, round({_A} * sqrt(w - n * ({_q('phi')})) / n * sin(n * lam), 3) AS x, round({_A} * sqrt(w - n * ({_q('radians(23)')})) / n - {_A} * sqrt(w - n * ({_q('phi')})) / n * cos(n * lam), 3) AS y FROM g, f", 0.5,
)
_EP = _E2 / (1 - _E2)
_register_projection(
    "project_utm", projections.utm(31),
    f"a AS (SELECT event_id, phi, lam * cos(phi) AS u, pow(tan(phi), 2) AS tt, {_EP} * pow(cos(phi), 2) AS c, {_A} / sqrt(1 - {_E2} * pow(sin(phi), 2)) AS n FROM g), "
    f"b AS (SELECT *, {_A} * ((1 - {_E2} / 4 - 3 * pow({_E2}, 2) / 64 - 5 * pow({_E2}, 3) / 256) * phi - (3 * {_E2} / 8 + 3 * pow({_E2}, 2) / 32 + 45 * pow({_E2}, 3) / 1024) * sin(2 * phi) + (15 * pow({_E2}, 2) / 256 + 45 * pow({_E2}, 3) / 1024) * sin(4 * phi) - 35 * pow({_E2}, 3) / 3072 * sin(6 * phi)) AS arc FROM a) "
    f"SELECT event_id, round(500000 + 0.9996 * n * (u + (1 - tt + c) * pow(u, 3) / 6 + (5 - 18 * tt + tt * tt + 72 * c - 58 * {_EP}) * pow(u, 5) / 120), 3) AS x, "
    f"round(0.9996 * (arc + n * tan(phi) * (u * u / 2 + (5 - tt + 9 * c + 4 * c * c) * pow(u, 4) / 24 + (61 - 58 * tt + tt * tt + 600 * c - 330 * {_EP}) * pow(u, 6) / 720)), 3) AS y FROM b", 0.05,
)


def _register_inverse(name: str, crs, scale: float) -> None:
    """There and back again: the SQL is the coordinates themselves."""

    def run(spark, sf_dir):
        p = read_points(spark, sf_dir).select("event_id", (F.col("lat") * scale).alias("lat"), (F.col("lon") * scale).alias("lon"))
        x, y = crs.forward(F.col("lat"), F.col("lon"))
        lat, lon = crs.inverse(F.col("x"), F.col("y"))
        return p.select("event_id", x.alias("x"), y.alias("y")).select("event_id", (F.round(lat, 6) + 0.0).alias("lat"), (F.round(lon, 6) + 0.0).alias("lon"))

    QUERIES[name] = run
    SQL[name] = f"WITH {POINTS} SELECT event_id, round(lat * {scale}, 6) AS lat, round(lon * {scale}, 6) AS lon FROM points"


_register_inverse("unproject_utm", projections.utm(31), 0.015)
_register_inverse("unproject_lcc", projections.CRS("lcc", lat0=39.0, lon0=0.0, sp1=33.0, sp2=45.0), 0.5)
_register_inverse("unproject_polar", projections.CRS("polar-stereo", lon0=0.0, true_scale_lat=70.0), 0.5)
_register_inverse("unproject_albers", projections.CRS("albers", lat0=23.0, lon0=0.0, sp1=29.5, sp2=45.5), 0.5)
_register_inverse("unproject_sinusoidal", projections.CRS("sinusoidal", a=6371007.181, e2=0.0), 0.5)


# -- messages, chunks, subsets


_MESSAGES = "m AS (SELECT event_type AS variable, event_id * 1000 AS start, ts AS valid_time, user_id % 3 + 1 AS npts, value FROM events)"


def _messages(spark, sf_dir):
    return read_points(spark, sf_dir).select(F.col("event_type").alias("variable"), (F.col("event_id") * 1000).alias("start"), F.col("ts").alias("valid_time"), (F.col("user_id") % 3 + 1).alias("npts"), "value")


@query(f"""WITH {_MESSAGES}, k AS (SELECT variable, start, row_number() OVER (PARTITION BY variable ORDER BY valid_time, start) - 1 AS time_index FROM m WHERE variable IN ('click', 'error')) SELECT variable, start, CAST(time_index AS INTEGER) AS time_index FROM k WHERE time_index BETWEEN 10 AND 40""")
def message_trim(spark, sf_dir):
    m = _messages(spark, sf_dir).where(F.col("variable").isin("click", "error"))
    return sequences.ranked_subset(m, 10, 40).orderBy("start").select("variable", "start", "time_index")


@query(f"""WITH {_MESSAGES} SELECT m.variable, start, m.npts FROM m JOIN (SELECT variable, arg_min(npts, start) AS n FROM m GROUP BY 1) f ON m.variable = f.variable AND m.npts = f.n""")
def shape_filter(spark, sf_dir):
    return sequences.same_shape(_messages(spark, sf_dir)).select("variable", "start", "npts")


@query(f"""WITH {_MESSAGES} SELECT variable, strftime(date_trunc('hour', valid_time), '%Y-%m-%dT%H:%M:%SZ') AS time, min(start) AS first_seen FROM m GROUP BY 1, 2""")
def distinct_times_first_seen(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("valid_time", F.date_trunc("hour", "valid_time"))
    return catalog.distinct_times(m).select("variable", times.iso(F.col("valid_time")).alias("time"), "first_seen")


@query("""SELECT event_type AS variable, count(*) AS n, count(DISTINCT ts) AS n_times, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS "end" FROM events GROUP BY 1""")
def variable_catalog(spark, sf_dir):
    p = read_points(spark, sf_dir).withColumnRenamed("event_type", "variable")
    return catalog.variables(p).withColumn("start", times.iso(F.col("start"))).withColumn("end", times.iso(F.col("end")))


@query("""SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS "end", count(DISTINCT ts) AS steps FROM events""")
def time_span(spark, sf_dir):
    return read_points(spark, sf_dir).agg(times.iso(F.min("ts")).alias("start"), times.iso(F.max("ts")).alias("end"), F.countDistinct("ts").alias("steps"))


@query("""WITH t AS (SELECT event_type, list(d ORDER BY d) AS days FROM (SELECT DISTINCT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events) GROUP BY 1) SELECT CASE WHEN count(DISTINCT days) = 1 THEN array_to_string(min(days), ',') END AS times FROM t""")
def hoisted_times(spark, sf_dir):
    p = read_points(spark, sf_dir).select("event_type", F.to_date("ts").cast("string").alias("d")).distinct()
    per = p.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_set("d")), ",").alias("times"))
    return catalog.hoist_times(per)


@query("""WITH {points}, w AS (SELECT lat, CASE WHEN lon + 180 > 180 THEN lon + 180 - 360 ELSE lon + 180 END AS lon FROM points) SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM w""")
def bbox_extent(spark, sf_dir):
    """Longitudes on 0..360 are taken to -180..180."""
    return catalog.extent(read_points(spark, sf_dir).withColumn("lon", F.col("lon") + 180))


@query("""WITH {points}, b AS (SELECT user_id, min(lon) AS a, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM points WHERE event_id % 50 < 2 GROUP BY 1), c AS (SELECT user_id, greatest(a, -20) AS min_lon, greatest(s, -30) AS min_lat, least(e, 60) AS max_lon, least(n, 20) AS max_lat FROM b) SELECT * FROM c WHERE max_lon > min_lon AND max_lat > min_lat""")
def bbox_intersection(spark, sf_dir):
    p = read_points(spark, sf_dir).where(F.col("event_id") % 50 < 2)
    boxes = p.groupBy("user_id").agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    return catalog.intersect_boxes(boxes, (-20.0, -30.0, 60.0, 20.0))


@query("""WITH {points}, b AS (SELECT user_id, min(lon) AS a, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM points GROUP BY 1), c AS (SELECT user_id, greatest(a, -20) AS min_lon, greatest(s, -30) AS min_lat, least(e, 60) AS max_lon, least(n, 20) AS max_lat FROM b) SELECT * FROM c WHERE max_lon > min_lon AND max_lat > min_lat""")
def bbox_intersection_all(spark, sf_dir):
    """As bbox_intersection, over every row."""
    boxes = read_points(spark, sf_dir).groupBy("user_id").agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    return catalog.intersect_boxes(boxes, (-20.0, -30.0, 60.0, 20.0))


@query("""SELECT DISTINCT event_type AS variable FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 380)""")
def missing_variables(spark, sf_dir):
    p = read_points(spark, sf_dir).withColumnRenamed("event_type", "variable")
    return catalog.missing_names(p, p.where("value > 380"))


@query("""SELECT 'a' AS source_id, event_id, value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'b', event_id, value FROM events WHERE event_id % 3 = 1""")
def concatenated_sources(spark, sf_dir):
    p = read_points(spark, sf_dir).select("event_id", "value")
    a, b = (p.where(F.col("event_id") % 3 == k).select(F.lit(s).alias("source_id"), "event_id", "value") for k, s in enumerate("ab"))
    return a.unionByName(b)


@query("""SELECT CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source_id, event_id, value FROM events""")
def concatenated_sources_all(spark, sf_dir):
    """As concatenated_sources, with a third part for the rows that the other two leave."""
    p, part = read_points(spark, sf_dir).select("event_id", "value"), F.coalesce(F.col("event_id") % 3, F.lit(2))
    a, b = (p.where(part == k).select(F.lit(s).alias("source_id"), "event_id", "value") for k, s in enumerate("ab"))
    rest = p.where(~part.isin(0, 1)).select(F.lit("c").alias("source_id"), "event_id", "value")
    return a.unionByName(b).unionByName(rest)


@query("""SELECT DISTINCT unnest(CASE event_type WHEN 'click' THEN ['t', 'lat', 'lon'] WHEN 'view' THEN ['lat', 'lon', 'level'] ELSE ['station'] END) AS dim FROM events WHERE event_type IN ('click', 'view')""")
def needed_dimensions(spark, sf_dir):
    dims = F.when(F.col("event_type") == "click", F.array(*map(F.lit, ("t", "lat", "lon")))).when(F.col("event_type") == "view", F.array(*map(F.lit, ("lat", "lon", "level")))).otherwise(F.array(F.lit("station")))
    v = read(spark, sf_dir, "events").select(F.col("event_type").alias("variable"), dims.alias("dims")).distinct()
    return catalog.needed_dimensions(v, ["click", "view"])


@query("""WITH {cells} SELECT t, iy, ix, value FROM cells WHERE t // 5 BETWEEN 7 // 5 AND 12 // 5 AND iy // 4 BETWEEN 2 // 4 AND 5 // 4 AND ix // 8 BETWEEN 3 // 8 AND 9 // 8""")
def chunk_prune(spark, sf_dir):
    """A subset widened to whole chunks."""
    return subset.whole_chunks(read_cells(spark, sf_dir), {"t": (7, 12), "iy": (2, 5), "ix": (3, 9)}, {"t": 5, "iy": 4, "ix": 8})


@query("""WITH {cells} SELECT t - 5 AS t, iy - 2 AS iy, ix - 3 AS ix, value FROM cells WHERE t BETWEEN 5 AND 9 AND iy BETWEEN 2 AND 5 AND ix BETWEEN 3 AND 9""")
def hyperslab(spark, sf_dir):
    return subset.hyperslab(read_cells(spark, sf_dir), {"t": (5, 9), "iy": (2, 5), "ix": (3, 9)})


@query("""WITH {cells} SELECT min(iy) AS low, max(iy) AS high FROM cells WHERE 82.5 - 15.0 * iy BETWEEN -20 AND 41""")
def coordinate_window(spark, sf_dir):
    low, high = axes.Axis(LATS).window(-20.0, 41.0)
    return read_cells(spark, sf_dir).where(F.col("iy").between(low, high)).agg(F.min("iy").alias("low"), F.max("iy").alias("high"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 40 + 1 AS width, o_orderkey % 30 + 1 AS height FROM orders WHERE o_orderkey % 100 = 0) SELECT k, width, height FROM o ORDER BY CASE WHEN width >= 20 AND height >= 11 THEN 0 ELSE 1 END, CASE WHEN width >= 20 AND height >= 11 THEN width * height ELSE -width * height END, k LIMIT 1""")
def overview_pick(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where(F.col("o_orderkey") % 100 == 0).select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 40 + 1).alias("width"), (F.col("o_orderkey") % 30 + 1).alias("height"))
    best = catalog.pick_overview(o.groupBy("width", "height").agg(F.min("k").alias("k")), 20, 11)
    return best.select("k", "width", "height")


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 40 + 1 AS width, o_orderkey % 30 + 1 AS height FROM orders) SELECT k, width, height FROM o ORDER BY CASE WHEN width >= 20 AND height >= 11 THEN 0 ELSE 1 END, CASE WHEN width >= 20 AND height >= 11 THEN width * height ELSE -width * height END, k LIMIT 1""")
def overview_pick_all(spark, sf_dir):
    """As overview_pick, over every row."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 40 + 1).alias("width"), (F.col("o_orderkey") % 30 + 1).alias("height"))
    best = catalog.pick_overview(o.groupBy("width", "height").agg(F.min("k").alias("k")), 20, 11, ties=("k",))
    return best.select("k", "width", "height")


_PARAM_VALUES = ", ".join(f"({d}, {c}, {n}, '{name}', '{unit}')" for d, c, n, name, unit in catalog.PARAMETERS)


@query(f"""WITH p(discipline, category, number, name, units) AS (VALUES {_PARAM_VALUES}), l(centre, category, number, name, units) AS (VALUES (7, 1, 8, 'Local precipitation', 'mm'), (7, 3, 192, 'Local pressure', 'Pa')),
  m AS (SELECT event_id, CAST(event_id % 2 * 7 AS INTEGER) AS centre, CAST(event_id % 4 AS INTEGER) AS category, CAST(CASE WHEN event_id % 11 = 0 THEN 192 ELSE event_id % 9 END AS INTEGER) AS number FROM events)
  SELECT event_id, coalesce(l.name, p.name, printf('Unknown (discipline=%d, category=%d, number=%d)', 0, m.category, m.number)) AS name, coalesce(l.units, p.units, '') AS units
  FROM m LEFT JOIN p ON p.discipline = 0 AND p.category = m.category AND p.number = m.number LEFT JOIN l ON l.centre = m.centre AND l.category = m.category AND l.number = m.number""")
def param_lookup(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    m = e.select("event_id", (F.col("event_id") % 2 * 7).cast("int").alias("centre"), F.lit(0).alias("discipline"), (F.col("event_id") % 4).cast("int").alias("category"), F.when(F.col("event_id") % 11 == 0, 192).otherwise(F.col("event_id") % 9).cast("int").alias("number"))
    local = spark.createDataFrame([(7, 0, 1, 8, "Local precipitation", "mm"), (7, 0, 3, 192, "Local pressure", "Pa")], "centre int, discipline int, category int, number int, name string, units string")
    return catalog.name_parameters(m, catalog.parameter_table(spark), local).select("event_id", "name", "units")


# -- sequences


@query("""SELECT user_id, event_id AS i, sum(CAST(event_id % 7 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM events""")
def differencing_undo_1(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("i"), (F.col("event_id") % 7).alias("value"))
    return sequences.undo_differences(e, 1, ("user_id",))


@query("""WITH o AS (SELECT user_id, event_id AS i, event_id % 7 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, first_value(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS v1, lag(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
  d AS (SELECT user_id, i, v1, sum(CASE k WHEN 1 THEN 0 WHEN 2 THEN v - before ELSE v END) OVER (PARTITION BY user_id ORDER BY i) AS d FROM o) SELECT user_id, i, CAST(v1 + sum(d) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS value FROM d""")
def differencing_undo_2(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("i"), (F.col("event_id") % 7).alias("value"))
    return sequences.undo_differences(e, 2, ("user_id",)).withColumn("value", F.col("value").cast("long"))


@query("""SELECT event_id AS i, CAST(sum(event_id % 7 - 3) OVER (ORDER BY event_id) AS BIGINT) AS value FROM events""")
def differencing_one_message(spark, sf_dir):
    """All rows as one sequence, undone in pieces of 512."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("i"), (F.col("event_id") % 7 - 3).alias("value"))
    return sequences.undo_differences(e, 1, (), piece=512)


@query("""WITH a AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS i, min(ts) AS c FROM events GROUP BY 1), d AS (SELECT c - lag(c) OVER (ORDER BY i) AS d FROM a)
  SELECT coalesce(bool_and(d > INTERVAL 0 SECOND), true) AS ascending, coalesce(bool_and(d < INTERVAL 0 SECOND), true) AS descending FROM d""")
def axis_monotonic(spark, sf_dir):
    return axes.monotonic(_days(spark, sf_dir).select("t", F.unix_micros("ts").alias("c")), "t", "c")


@query("""WITH RECURSIVE v AS (SELECT DISTINCT CAST(value AS DOUBLE) AS c FROM events), k(i, value) AS (SELECT 0, (SELECT min(c) FROM v) UNION ALL SELECT i + 1, (SELECT min(c) FROM v WHERE c - value > 2.5) FROM k WHERE EXISTS (SELECT 1 FROM v WHERE c - value > 2.5)) SELECT CAST(i AS INTEGER) AS i, value FROM k""")
def unique_sorted_tolerance(spark, sf_dir):
    return axes.unique_coordinates(read(spark, sf_dir, "events"), "value", 2.5)


@query("""WITH f AS (SELECT CAST(floor(k * (30 - 1) / 6.0 + 0.5) AS INTEGER) AS t FROM generate_series(0, 6) s(k)), {cells} SELECT t, count(*) AS n FROM cells JOIN f USING (t) GROUP BY t""")
def frame_choice(spark, sf_dir):
    chosen = sequences.evenly_chosen(30, min(7, sequences.frame_budget(1024, 1024)))
    return read_cells(spark, sf_dir).where(F.col("t").isin(chosen)).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


# -- text and codes


@query("""SELECT p_partkey, CASE WHEN p_name || ', "' || p_brand || '"' IS NULL THEN '' ELSE '"' || replace(p_name || ', "' || p_brand || '"', '"', '""') || '"' END AS cell, CAST(p_size AS VARCHAR) AS plain FROM part""")
def csv_cells(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    cell = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    return p.select("p_partkey", text.csv_cell(cell).alias("cell"), text.csv_cell(F.col("p_size")).alias("plain"))


@query("""WITH {cells} SELECT t, iy, ix, (t // 5) || '.' || (iy // 4) || '.' || (ix // 8) AS key, CAST(((t // 5) * 3 + iy // 4) * 3 + ix // 8 AS BIGINT) AS chunk FROM cells""")
def chunk_keys(spark, sf_dir):
    index = F.array(F.floor(F.col("t") / 5), F.floor(F.col("iy") / 4), F.floor(F.col("ix") / 8))
    shape = F.array(*(F.lit(n).cast("long") for n in (7, 3, 3)))
    return read_cells(spark, sf_dir).select("t", "iy", "ix", text.chunk_key(index).alias("key"), text.linear_index(index, shape).alias("chunk"))


@query("""SELECT p_partkey, p_size AS nt, p_partkey % 90 + 1 AS ny, p_size || 'x' || (p_partkey % 90 + 1) AS shape FROM part""")
def shape_round_trip(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" , ", "p_size", F.col("p_partkey") % 90 + 1).alias("raw"))
    shape = text.parse_shape(F.col("raw"))
    return p.select("p_partkey", shape[0].cast("int").alias("nt"), shape[1].alias("ny"), text.format_shape(shape).alias("shape"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE CAST(32600 + c_custkey % 60 AS INTEGER) END AS epsg FROM customer""")
def epsg_codes(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    code, k = (F.col("c_custkey") % 60 + 32600).cast("string"), F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("urn:ogc:def:crs:EPSG::"), code)).when(k == 1, F.concat(F.lit('{"type":"ProjectedCRS","id":{"authority":"EPSG","code":'), code, F.lit("}}"))).otherwise("local grid")
    return c.select("c_custkey", text.epsg_code(raw).alias("epsg"))


@query("""SELECT event_id, base64(encode(props)) AS packed, json_extract_string(props, '$.k') AS k FROM events""")
def encoded_properties(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    packed = F.base64(F.encode("props", "UTF-8"))
    return e.select("event_id", packed.alias("packed"), F.get_json_object(F.decode(F.unbase64(packed), "UTF-8"), "$.k").alias("k"))


# -- rows of the text sinks


@query("""WITH {cells} SELECT 'value' AS variable, CAST(82.5 - 15.0 * iy AS DOUBLE) AS lat, CAST(-172.5 + 15.0 * ix AS DOUBLE) AS lon, value FROM cells WHERE t = 2""")
def grid_rows(spark, sf_dir):
    from gridloom.sources.sinks import grid_rows as rows

    return rows(read_cells(spark, sf_dir).where("t = 2").select(F.col("iy").alias("r"), F.col("ix").alias("c"), "value"), "value", WORLD, NX, NY)


@query("""WITH {cells} SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(-172.5 + 15.0 * ix AS DOUBLE) || ',' || CAST(82.5 - 15.0 * iy AS DOUBLE) || ']},"properties":{"t":' || t || '}}' AS feature FROM cells WHERE t = 2""")
def geojson_features(spark, sf_dir):
    from gridloom.sources.sinks import feature

    cells = read_cells(spark, sf_dir).where("t = 2").select((F.lit(-172.5) + F.col("ix") * 15.0).alias("lon"), (F.lit(82.5) - F.col("iy") * 15.0).alias("lat"), "t")
    return cells.select(feature(F.col("lon"), F.col("lat"), F.struct("t")).alias("feature"))
