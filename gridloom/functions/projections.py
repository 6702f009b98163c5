"""Map projections as column expressions, after Snyder's working manual (USGS PP 1395).

Every inverse is a closed series in the auxiliary latitude, sharpened by Newton steps where the series is short, so a
projection is one flat expression inside generated code: no loop, no Python. All functions take columns or numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from gridloom.errors import UnsupportedCRSError
from gridloom.functions.maths import Number, asin, atan, atan2, cos, degrees, exp, log, power, radians, sin, sqrt, tan

#: WGS84 and UTM.
WGS84_A, WGS84_E2, UTM_K0 = 6378137.0, 0.00669437999014, 0.9996
#: Fixed value: the latitude at which a Mercator map is square.
MERCATOR_MAX_LAT = 85.05112878
EARTH_RADIUS = 6_371_000.0


@dataclass(frozen=True)
class CRS:
    """A projection with its parameters; angles in degrees. ``a`` and ``e2`` describe the ellipsoid."""

    kind: str = "geographic"
    lat0: float = 0.0
    lon0: float = 0.0
    sp1: float = 0.0
    sp2: float | None = None
    scale: float = 1.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    north: bool = True
    true_scale_lat: float = 70.0
    a: float = WGS84_A
    e2: float = WGS84_E2

    def forward(self, lat: Number, lon: Number) -> tuple[Number, Number]:
        """Degrees to (x, y)."""
        if self.kind == "geographic":
            return lon, lat
        x, y = self._pair()[0](self, radians(lat), radians(lon) - math.radians(self.lon0))
        return x + self.false_easting, y + self.false_northing

    def inverse(self, x: Number, y: Number) -> tuple[Number, Number]:
        """(x, y) to (lat, lon) in degrees."""
        if self.kind == "geographic":
            return y, x
        phi, turn = self._pair()[1](self, x - self.false_easting, y - self.false_northing)
        return degrees(phi), degrees(turn) + self.lon0

    def _pair(self):
        if self.kind not in PROJECTIONS:
            raise UnsupportedCRSError(f"no projection {self.kind!r}", name=self.kind)
        return PROJECTIONS[self.kind]

    def bounds_wgs84(self, box: tuple[float, float, float, float], steps: int = 64) -> tuple[float, float, float, float]:
        """The smallest (minLon, minLat, maxLon, maxLat) around the outline of a native box."""
        x0, y0, x1, y1 = box
        outline = [(x0 + (x1 - x0) * k / steps, y) for k in range(steps + 1) for y in (y0, y1)] + [(x, y0 + (y1 - y0) * k / steps) for k in range(steps + 1) for x in (x0, x1)]
        lats, lons = zip(*(self.inverse(x, y) for x, y in outline), strict=True)
        return min(lons), min(lats), max(lons), max(lats)

    def extent(self, box: tuple[float, float, float, float], steps: int = 64) -> tuple[float, float]:
        """Width and height, in native units, of the outline of a geographic box (minLon, minLat, maxLon, maxLat)."""
        west, south, east, north = box
        outline = [(lat, west + (east - west) * k / steps) for k in range(steps + 1) for lat in (south, north)] + [(south + (north - south) * k / steps, lon) for k in range(steps + 1) for lon in (west, east)]
        xs, ys = zip(*(self.forward(lat, lon) for lat, lon in outline), strict=True)
        return max(xs) - min(xs), max(ys) - min(ys)


def utm(zone: int, north: bool = True) -> CRS:
    return CRS("tmerc", lon0=zone * 6 - 183.0, scale=UTM_K0, false_easting=500_000.0, false_northing=0.0 if north else 10_000_000.0)


def from_epsg(code: int) -> CRS:
    """The supported EPSG codes: 4326, UTM zones, the two polar stereographic grids of NSIDC."""
    if code == 4326:
        return CRS()
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return utm(code % 100, code < 32700)
    if code == 3413:
        return CRS("polar-stereo", lon0=-45.0, true_scale_lat=70.0)
    if code == 3031:
        return CRS("polar-stereo", lon0=0.0, true_scale_lat=-71.0, north=False)
    raise UnsupportedCRSError(f"EPSG:{code} isn't supported", epsg=code)


# -- auxiliary latitudes


def _isometric(phi: Number, e: float) -> Number:
    """Snyder's t: the exponential of the negative isometric latitude."""
    s = sin(phi) * e
    return tan(math.pi / 4 - phi / 2) * power((1 + s) / (1 - s), e / 2)


def _from_isometric(t: Number, e2: float) -> Number:
    """Latitude from t by the series in the conformal latitude (Snyder 3-5)."""
    chi = math.pi / 2 - 2 * atan(t)
    e4, e6, e8 = e2**2, e2**3, e2**4
    terms = (
        e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360,
        7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520,
        7 * e6 / 120 + 81 * e8 / 1120,
        4279 * e8 / 161280,
    )
    return sum((c * sin(2 * k * chi) for k, c in enumerate(terms, 1)), chi)


def _authalic(phi: Number, e2: float) -> Number:
    """Snyder's q, proportional to the sine of the authalic latitude."""
    if not e2:
        return 2 * sin(phi)
    e, s = math.sqrt(e2), sin(phi)
    return (1 - e2) * (s / (1 - s * s * e2) + log((1 + s * e) / (1 - s * e)) / (2 * e))


def _from_authalic(q: Number, e2: float) -> Number:
    """Latitude from q: the series (Snyder 3-18), then two Newton steps on q."""
    beta = asin(q / _authalic(math.pi / 2, e2))
    e4, e6 = e2**2, e2**3
    phi = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * sin(4 * beta) + 761 * e6 / 45360 * sin(6 * beta)
    for _ in range(2):
        s = sin(phi)
        w = 1 - s * s * e2
        phi = phi - (_authalic(phi, e2) - q) * w * w / (2 * (1 - e2) * cos(phi))
    return phi


def _radius_ratio(phi: float, e2: float) -> float:
    """Snyder's m: the parallel's radius over the semi-major axis."""
    return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)


def _meridian(phi: Number, e2: float) -> Number:
    """Distance along the meridian from the equator, in semi-major axes (Snyder 3-21)."""
    return (
        polynomial_of(e2, 1, -1 / 4, -3 / 64, -5 / 256) * phi - polynomial_of(e2, 0, 3 / 8, 3 / 32, 45 / 1024) * sin(2 * phi)
        + polynomial_of(e2, 0, 0, 15 / 256, 45 / 1024) * sin(4 * phi) - polynomial_of(e2, 0, 0, 0, 35 / 3072) * sin(6 * phi)
    )


def polynomial_of(e2: float, *coefficients: float) -> float:
    return sum(c * e2**k for k, c in enumerate(coefficients))


# -- projections: (forward, inverse), both relative to lon0 and the false origin


def _tmerc_forward(c: CRS, phi: Number, turn: Number):
    second = c.e2 / (1 - c.e2)
    s, k = sin(phi), cos(phi)
    t2, n2, u = tan(phi) * tan(phi), k * k * second, turn * k
    u2 = u * u
    normal = c.a * c.scale / sqrt(1 - s * s * c.e2)
    x = normal * u * (1 + u2 / 6 * ((1 - t2 + n2) + u2 / 20 * (5 - 18 * t2 + t2 * t2 + 72 * n2 - 58 * second)))
    arc = c.a * c.scale * (_meridian(phi, c.e2) - _meridian(math.radians(c.lat0), c.e2))
    y = arc + normal * tan(phi) * u2 / 2 * (1 + u2 / 12 * ((5 - t2 + 9 * n2 + 4 * n2 * n2) + u2 / 30 * (61 - 58 * t2 + t2 * t2 + 600 * n2 - 330 * second)))
    return x, y


def _tmerc_inverse(c: CRS, x: Number, y: Number):
    second, root = c.e2 / (1 - c.e2), math.sqrt(1 - c.e2)
    n = (1 - root) / (1 + root)
    mu = (_meridian(math.radians(c.lat0), c.e2) + y / (c.a * c.scale)) / polynomial_of(c.e2, 1, -1 / 4, -3 / 64, -5 / 256)
    terms = (polynomial_of(n, 0, 3 / 2, 0, -27 / 32), polynomial_of(n, 0, 0, 21 / 16, 0, -55 / 32), polynomial_of(n, 0, 0, 0, 151 / 96))
    foot = sum((b * sin(2 * k * mu) for k, b in enumerate(terms, 1)), mu)
    s, k = sin(foot), cos(foot)
    w = 1 - s * s * c.e2
    t2, n2 = tan(foot) * tan(foot), k * k * second
    d = x * sqrt(w) / (c.a * c.scale)
    d2 = d * d
    phi = foot - tan(foot) * w / (1 - c.e2) * d2 / 2 * (1 - d2 / 12 * ((5 + 3 * t2 + 10 * n2 - 4 * n2 * n2 - 9 * second) - d2 / 30 * (61 + 90 * t2 + 298 * n2 + 45 * t2 * t2 - 252 * second - 3 * n2 * n2)))
    turn = d / k * (1 - d2 / 6 * ((1 + 2 * t2 + n2) - d2 / 20 * (5 - 2 * n2 + 28 * t2 - 3 * n2 * n2 + 8 * second + 24 * t2 * t2)))
    return phi, turn


def _lambert_cone(c: CRS):
    """Cone constant, scale of radii and the origin's radius."""
    e, first = math.sqrt(c.e2), math.radians(c.sp1)
    second = math.radians(c.sp1 if c.sp2 is None else c.sp2)
    if abs(first - second) < 1e-12:
        n = math.sin(first)
    else:
        n = math.log(_radius_ratio(first, c.e2) / _radius_ratio(second, c.e2)) / math.log(_isometric(first, e) / _isometric(second, e))
    size = c.a * _radius_ratio(first, c.e2) / (n * _isometric(first, e) ** n)
    return e, n, size, size * _isometric(math.radians(c.lat0), e) ** n


def _lcc_forward(c: CRS, phi: Number, turn: Number):
    e, n, size, origin = _lambert_cone(c)
    rho = size * power(_isometric(phi, e), n)
    return rho * sin(turn * n), origin - rho * cos(turn * n)


def _lcc_inverse(c: CRS, x: Number, y: Number):
    _, n, size, origin = _lambert_cone(c)
    side = math.copysign(1.0, n)
    down = origin - y
    t = power(sqrt(x * x + down * down) / abs(size), 1 / n)
    return _from_isometric(t, c.e2), atan2(x * side, down * side) / n


def _polar_scale(c: CRS) -> float:
    lat = math.radians(abs(c.true_scale_lat))
    return c.a * _radius_ratio(lat, c.e2) / _isometric(lat, math.sqrt(c.e2))


def _polar_forward(c: CRS, phi: Number, turn: Number):
    side = 1.0 if c.north else -1.0
    rho = _polar_scale(c) * _isometric(phi * side, math.sqrt(c.e2))
    return rho * sin(turn), rho * cos(turn) * -side


def _polar_inverse(c: CRS, x: Number, y: Number):
    side = 1.0 if c.north else -1.0
    return _from_isometric(sqrt(x * x + y * y) / _polar_scale(c), c.e2) * side, atan2(x, y * -side)


def _albers_cone(c: CRS):
    first, second = math.radians(c.sp1), math.radians(c.sp1 if c.sp2 is None else c.sp2)
    m = _radius_ratio(first, c.e2) ** 2
    n = math.sin(first) if abs(first - second) < 1e-12 else (m - _radius_ratio(second, c.e2) ** 2) / (_authalic(second, c.e2) - _authalic(first, c.e2))
    whole = m + n * _authalic(first, c.e2)
    return n, whole, c.a * math.sqrt(whole - n * _authalic(math.radians(c.lat0), c.e2)) / n


def _albers_forward(c: CRS, phi: Number, turn: Number):
    n, whole, origin = _albers_cone(c)
    rho = sqrt(whole - _authalic(phi, c.e2) * n) * (c.a / n)
    return rho * sin(turn * n), origin - rho * cos(turn * n)


def _albers_inverse(c: CRS, x: Number, y: Number):
    n, whole, origin = _albers_cone(c)
    down, side = origin - y, math.copysign(1.0, n)
    q = (whole - (x * x + down * down) * (n / c.a) ** 2) / n
    return _from_authalic(q, c.e2), atan2(x * side, down * side) / n


def _sinusoidal_forward(c: CRS, phi: Number, turn: Number):
    return turn * cos(phi) * c.a, phi * c.a


def _sinusoidal_inverse(c: CRS, x: Number, y: Number):
    return y / c.a, x / (cos(y / c.a) * c.a)


def _mercator_forward(c: CRS, phi: Number, turn: Number):
    return turn * c.a, log(tan(math.pi / 4 + phi / 2)) * c.a


def _mercator_inverse(c: CRS, x: Number, y: Number):
    return 2 * atan(exp(y / c.a)) - math.pi / 2, x / c.a


PROJECTIONS = {
    "tmerc": (_tmerc_forward, _tmerc_inverse), "lcc": (_lcc_forward, _lcc_inverse), "polar-stereo": (_polar_forward, _polar_inverse),
    "albers": (_albers_forward, _albers_inverse), "sinusoidal": (_sinusoidal_forward, _sinusoidal_inverse), "mercator": (_mercator_forward, _mercator_inverse),
}


def mercator_y(lat: Number) -> Number:
    return log(tan(math.pi / 4 + radians(lat) / 2))


def inverse_mercator_y(y: Number) -> Number:
    return degrees(2 * atan(exp(y)) - math.pi / 2)


def display_box(box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """A box as a web map takes it: within -180..180 and the latitudes that Mercator shows.

    A grid on 0..360 that spans over half the globe is moved half a turn as a whole; other boxes are turned edge by
    edge, and one that then crosses the antimeridian is cut at it.
    """
    west, south, east, north = box
    if 0 <= west and east > 180 and east - west > 180:
        west, east = west - 180, east - 180
    elif west < -180 or east > 180:
        west, east = ((v + 180) % 360 - 180 for v in (west, east))
        if east <= west:
            west = -180.0
    west, east = max(-180.0, west), min(180.0, east)
    if east <= west:
        west, east = -180.0, 180.0
    return west, max(south, -MERCATOR_MAX_LAT), east, min(north, MERCATOR_MAX_LAT)
