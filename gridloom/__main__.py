"""Command line: ``python -m gridloom detect|scan|point|grid|trim FILE ...``."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("detect", "scan", "point", "grid", "trim"):
        p = verbs.add_parser(verb)
        p.add_argument("file")
        if verb in ("point", "grid", "trim"):
            p.add_argument("--variable", action="append")
            p.add_argument("--t1", type=int)
            p.add_argument("--t2", type=int)
            p.add_argument("--out")
        if verb == "point":
            p.add_argument("--lat", type=float, required=True)
            p.add_argument("--lon", type=float, required=True)
            p.add_argument("--dates", nargs=2)
        if verb in ("point", "grid"):
            p.add_argument("--date")
            p.add_argument("--format", default="csv")
        if verb in ("grid", "trim"):
            p.add_argument("--box", type=float, nargs=4, metavar=("WEST", "SOUTH", "EAST", "NORTH"))
        if verb == "grid":
            p.add_argument("--size", type=int, nargs=2, default=(256, 256), metavar=("WIDTH", "HEIGHT"))
    a = parser.parse_args(argv)
    from gridloom.plans import engine

    box = tuple(a.box) if getattr(a, "box", None) else None
    if a.verb == "detect":
        print(engine.detect(a.file))
        return 0
    if a.verb == "trim":
        data = engine.trim(a.file, a.variable, a.t1, a.t2, box).data
    else:
        from pyspark.sql import SparkSession

        source = engine.Dataset(SparkSession.builder.appName("gridloom").config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.file)
        if a.verb == "scan":
            for row in source.scan().drop("times", "attrs").collect():
                print(row.asDict())
            return 0
        name = a.variable[0] if a.variable else None
        if a.verb == "point":
            data = engine.encode_series(source.extract(name or source.names()[0], a.lat, a.lon, a.t1, a.t2, a.date, tuple(a.dates) if a.dates else None), a.format)
        else:
            data = engine.encode_grid(source.extract_grid(name, box, *a.size, t=a.t1, date=a.date), a.format)
    if a.out:
        with open(a.out, "wb") as f:
            f.write(data)
    else:
        sys.stdout.buffer.write(data)
    return 0


if __name__ == "__main__":
    sys.exit(main())
