"""Functions and table functions for spark.sql: register(spark) makes them known to a session.

The scalar ones are SQL expressions, which Catalyst puts in place of the call; nothing of them runs in Python. sample_path is a
table function over a partitioned table argument: it streams through one path at a time and holds its last point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .geo import EARTH_RADIUS_M, ORIGIN_LAT, ORIGIN_LON

RING = "ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_COS = math.cos(math.radians(ORIGIN_LAT))
_A, _B = "ring[(i + size(ring) - 1) % size(ring)]", "ring[i]"
_TURN = "abs(radians(heading_deg) - atan2(px - x, py - y)) % (2 * pi())"
#: name -> parameters, type, body
FUNCTIONS = {
    "enu_x": ("lon DOUBLE", "DOUBLE", f"{EARTH_RADIUS_M}D * radians(lon - ({ORIGIN_LON}D)) * {_COS!r}D"),
    "enu_y": ("lat DOUBLE", "DOUBLE", f"{EARTH_RADIUS_M}D * radians(lat - {ORIGIN_LAT}D)"),
    "enu_lon": ("x DOUBLE", "DOUBLE", f"{ORIGIN_LON}D + degrees(x / ({EARTH_RADIUS_M * _COS!r}D))"),
    "enu_lat": ("y DOUBLE", "DOUBLE", f"{ORIGIN_LAT}D + degrees(y / {EARTH_RADIUS_M}D)"),
    "point_in_ring": (
        f"px DOUBLE, py DOUBLE, {RING}",
        "BOOLEAN",
        f"""size(ring) >= 3 AND aggregate(sequence(0, greatest(size(ring) - 1, 0)), 0, (n, i) ->
          n + CASE WHEN ({_A}.y > py) <> ({_B}.y > py) AND px < ({_B}.x - {_A}.x) * (py - {_A}.y) / ({_B}.y - {_A}.y) + {_A}.x THEN 1 ELSE 0 END) % 2 = 1""",
    ),
    "captures": (
        "px DOUBLE, py DOUBLE, x DOUBLE, y DOUBLE, heading_deg DOUBLE, full_fov_deg DOUBLE, range_m DOUBLE",
        "BOOLEAN",
        f"sqrt(pow(px - x, 2) + pow(py - y, 2)) <= range_m AND (heading_deg IS NULL OR (px = x AND py = y) OR least({_TURN}, 2 * pi() - {_TURN}) <= radians(full_fov_deg) / 2)",
    ),
}


@udtf(returnType="path bigint, k bigint, x double, y double")
class SamplePath:
    """sample_path(TABLE(points) PARTITION BY (path) ORDER BY (seq), step): points each `step` along every path, from its start.
    The table's columns are path, seq, x, y."""

    def __init__(self) -> None:
        self.last: tuple[float, float] | None = None
        self.arc, self.k = 0.0, 0

    def eval(self, row: Row, step: float) -> Iterator[tuple[int, int, float, float]]:
        x, y = row["x"], row["y"]
        if self.last is None:
            yield row["path"], 0, x, y
            self.k = 1
        else:
            length = math.dist(self.last, (x, y))
            while length and self.k * step <= self.arc + length:
                t = (self.k * step - self.arc) / length
                yield row["path"], self.k, self.last[0] + (x - self.last[0]) * t, self.last[1] + (y - self.last[1]) * t
                self.k += 1
            self.arc += length
        self.last = x, y


def register(spark: SparkSession) -> SparkSession:
    """Makes the functions known to the session under their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("sample_path", SamplePath)
    return spark
