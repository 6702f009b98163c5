"""Values to colours: normalisation and linear colour ramps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import GridloomError

#: The built-in ramps, evenly spaced stops from 0 to 1 as (r, g, b).
RAMPS = {
    "viridis": ((68, 1, 84), (72, 40, 120), (62, 73, 137), (49, 104, 142), (38, 130, 142), (31, 158, 137), (53, 183, 121), (110, 206, 88), (253, 231, 37)),
    "plasma": ((13, 8, 135), (75, 3, 161), (125, 3, 168), (168, 34, 150), (203, 70, 121), (229, 107, 93), (248, 148, 65), (253, 195, 40), (240, 249, 33)),
    "grayscale": ((0, 0, 0), (255, 255, 255)),
    "RdBu": ((103, 0, 31), (178, 24, 43), (214, 96, 77), (244, 165, 130), (247, 247, 247), (146, 197, 222), (67, 147, 195), (33, 102, 172), (5, 48, 97)),
}

Stops = list[tuple[float, tuple[int, int, int]]]


def resolve_ramp(ramp: str | Stops) -> Stops:
    """Stops of a built-in ramp, or of the caller's own list of (t, (r, g, b))."""
    if isinstance(ramp, str):
        if ramp not in RAMPS:
            raise GridloomError(f"no ramp {ramp!r}; there are {', '.join(RAMPS)}")
        colours = RAMPS[ramp]
        return [(k / (len(colours) - 1), c) for k, c in enumerate(colours)]
    if len(ramp) < 2:
        raise GridloomError("a ramp needs two stops or more")
    return [(float(t), tuple(c)) for t, c in ramp]


def normalize(value: Column, low: Column | float, high: Column | float) -> Column:
    """Position of the value between the ends, clamped to [0, 1]; 0 where the ends meet."""
    span = high - low
    at = F.try_divide(value - low, span if isinstance(span, Column) else F.lit(float(span)))
    return F.when(value.isNull(), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(at, F.lit(0.0)))))


def sample_ramp(ramp: str | Stops, t: Column) -> Column:
    """struct(r, g, b) of ints at ``t``; halves round up; black where there is no number."""
    stops = resolve_ramp(ramp)

    def channel(k: int) -> Column:
        out = None
        for (t0, c0), (t1, c1) in zip(stops, stops[1:], strict=False):
            inside = F.floor((t - t0) / (t1 - t0) * (c1[k] - c0[k]) + (c0[k] + 0.5))
            out = F.when(t < t1, inside) if out is None else out.when(t < t1, inside)
        return F.when(t.isNull() | F.isnan(t), 0).when(t <= stops[0][0], stops[0][1][k]).otherwise(out.otherwise(stops[-1][1][k])).cast("int")

    return F.struct(*(channel(k).alias(name) for k, name in enumerate("rgb")))


def auto_range(low: Column, high: Column) -> tuple[Column, Column]:
    """Ends of a colour scale from the least and largest value: equal ends are moved apart by a half each."""
    same = low == high
    return F.when(same, low - 0.5).otherwise(low), F.when(same, high + 0.5).otherwise(high)
