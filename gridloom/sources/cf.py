"""Grid mappings of the CF conventions, and signs that axes are no longitudes and latitudes."""

from __future__ import annotations

from gridloom.errors import UnsupportedCRSError
from gridloom.functions.projections import WGS84_A, WGS84_E2

#: Mapping names and the projections here.
MAPPINGS = {"latitude_longitude": "geographic", "polar_stereographic": "polar-stereo", "lambert_conformal_conic": "lcc", "albers_conical_equal_area": "albers", "sinusoidal": "sinusoidal", "transverse_mercator": "tmerc"}
#: Units of lengths and their metres.
LENGTHS = {"m": 1.0, "meter": 1.0, "metre": 1.0, "meters": 1.0, "metres": 1.0, "km": 1e3, "kilometer": 1e3, "kilometre": 1e3, "kilometers": 1e3, "kilometres": 1e3}


def _numbers(attrs: dict, *names: str) -> list[float]:
    for name in names:
        value = attrs.get(name)
        if value is None:
            continue
        if isinstance(value, str):
            try:
                return [float(v) for v in value.strip("[]() ").replace(",", " ").split()]
            except ValueError:
                continue
        return [float(v) for v in (value if isinstance(value, list | tuple) else [value])]
    return []


def crs_from_mapping(attrs: dict) -> dict:
    """The parameters of ``CRS`` for a grid mapping variable's attributes."""
    name = str(attrs.get("grid_mapping_name", "")).strip().lower()
    if name not in MAPPINGS:
        raise UnsupportedCRSError(f"grid mapping {name!r} isn't supported", name=name)
    kind = MAPPINGS[name]
    if kind == "geographic":
        return {}

    def one(default: float, *names: str) -> float:
        found = _numbers(attrs, *names)
        return found[0] if found else default

    a = one(WGS84_A, "semi_major_axis", "earth_radius")
    if inverse := one(0.0, "inverse_flattening"):
        e2 = (2 - 1 / inverse) / inverse
    elif _numbers(attrs, "semi_minor_axis"):
        e2 = 1 - (one(a, "semi_minor_axis") / a) ** 2
    else:
        e2 = 0.0 if _numbers(attrs, "earth_radius") else WGS84_E2
    out = {"kind": kind, "false_easting": one(0.0, "false_easting"), "false_northing": one(0.0, "false_northing"), "a": a, "e2": e2}
    parallels = _numbers(attrs, "standard_parallel")
    origin = one(90.0 if kind == "polar-stereo" else 0.0, "latitude_of_projection_origin")
    meridian = one(0.0, "longitude_of_central_meridian", "longitude_of_projection_origin")
    if kind == "polar-stereo":
        true_scale = parallels or _numbers(attrs, "latitude_of_standard_parallel")
        if not true_scale:
            raise UnsupportedCRSError("a polar grid mapping without a standard parallel", name=name)
        return out | {"lon0": one(meridian, "straight_vertical_longitude_from_pole"), "true_scale_lat": true_scale[0], "north": origin >= 0}
    if kind in ("lcc", "albers"):
        first = parallels[0] if parallels else origin
        return out | {"lat0": origin, "lon0": meridian, "sp1": first, "sp2": parallels[1] if len(parallels) > 1 else first}
    if kind == "tmerc":
        return out | {"lat0": origin, "lon0": meridian, "scale": one(1.0, "scale_factor_at_central_meridian", "scale_factor_at_projection_origin")}
    return out | {"lon0": one(meridian, "longitude_of_projection_origin"), "a": one(6371007.181, "earth_radius", "semi_major_axis"), "e2": 0.0}


def projected_because(y_attrs: dict, x_attrs: dict, y: list[float], x: list[float]) -> str:
    """Why the axes can't be latitudes and longitudes, or nothing."""
    standard = {str(a.get("standard_name", "")).lower() for a in (y_attrs, x_attrs)}
    if standard & {"projection_y_coordinate", "projection_x_coordinate"}:
        return "their standard names say projection coordinates"
    if standard & {"grid_latitude", "grid_longitude"}:
        return "they are degrees about a rotated pole"
    if {str(a.get("units", "")).strip().lower() for a in (y_attrs, x_attrs)} & set(LENGTHS):
        return "their units are lengths"
    if (y and max(map(abs, y)) > 90.0001) or (x and max(map(abs, x)) > 360.0001):
        return "their values are beyond degrees"
    return ""


def describe_axes(mapping: dict | None, y_attrs: dict, x_attrs: dict, y: list[float], x: list[float]) -> tuple[dict, list[float], list[float], list[str], bool]:
    """(crs, y, x in metres where projected, warnings, supported) of a variable."""
    why = projected_because(y_attrs, x_attrs, y, x)
    if not why:
        return {}, y, x, [], True
    if mapping is None:
        return {}, y, x, [f"axes are projected ({why}), without a grid mapping"], False
    try:
        crs = crs_from_mapping(mapping)
    except UnsupportedCRSError as e:
        return {}, y, x, [str(e)], False
    scale = [LENGTHS.get(str(a.get("units", "m")).strip().lower(), 1.0) for a in (y_attrs, x_attrs)]
    return crs, [v * scale[0] for v in y], [v * scale[1] for v in x], [], True
