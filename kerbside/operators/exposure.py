"""Exposure rates at points, and their integrals along a walk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import scalar
from kerbside.operators import sequence, spatial

#: Walking speed, recall of the detector, reach of a bus corridor.
WALK_MPS, RECALL, ACE_REACH_M = 1.34, 0.63, 20.0
#: Bus directions and headway scale; per minute, share and capture of the other classes.
ACE_DIRECTIONS, ACE_SCALE = 2.0, 1.0
DASH_PENETRATION, DASH_PER_MIN, DASH_CAPTURE = 0.40, 12.0, 0.40
GLASS_PER_1000, GLASS_RECORDING, GLASS_PER_MIN, GLASS_CAPTURE = 10.0, 0.05, 60.0, 0.4
ROBOT_PER_MIN, ROBOT_CAPTURE, TESLA_PER_MIN, TESLA_CAPTURE = 2.0, 0.5, 4.0, 0.3
ROBOT_NO_FIELD, ROBOT_OUTSIDE, TESLA_OUTSIDE = 0.3, 0.1, 0.1


def rates(hour, corridor: Column, zone: Column, robot_score: Column, tesla_density: Column, headway: Column | None = None, traffic: Column | None = None) -> dict[str, Column]:
    """Mobile captures per minute of presence, by class. headway (minutes) and traffic (of the day's peak) are those of a real
    day, else the synthetic curves of the hour."""
    headway = scalar.headway_step(hour) if headway is None else headway
    ace = F.when(corridor, 60 * ACE_DIRECTIONS / F.greatest(60 * headway * ACE_SCALE, F.lit(1.0))).otherwise(0.0)
    return {
        "ace": ace,
        "dashcam": DASH_PER_MIN * (scalar.traffic(hour) if traffic is None else traffic) * zone * (DASH_PENETRATION * DASH_CAPTURE),
        "glasses": GLASS_PER_MIN * scalar.pedestrians(hour) * (GLASS_PER_1000 / 1000 * GLASS_RECORDING * GLASS_CAPTURE),
        "robots": ROBOT_PER_MIN * scalar.robots(hour) * robot_score * ROBOT_CAPTURE,
        "tesla": TESLA_PER_MIN * tesla_density * TESLA_CAPTURE,
    }


def fixed_rate(points: DataFrame, sensors: DataFrame, key: str, reach: float, factor: float = 1 / RECALL) -> DataFrame:
    """(key, fixed) of points(key, px, py): distinct groups with a capturing member, one for a confirmed group, the factor
    for another. sensors carry grp and confirmed."""
    groups = spatial.captures(points, sensors, reach).groupBy(key, "grp").agg(F.bool_or("confirmed").alias("ok"))
    return groups.groupBy(key).agg(F.sum(F.when(F.col("ok"), 1.0).otherwise(factor)).alias("fixed"))


def heatmap(points: DataFrame, key: str, sensors: DataFrame, corridor: DataFrame, zones: DataFrame, hour: float, reach: float, zone_size: float, ace_reach: float = ACE_REACH_M) -> DataFrame:
    """(key, fixed, ace, dashcam, glasses, robots, tesla): captures per minute at points(key, px, py) at an hour.

    corridor(sx, sy) are points along bus corridors; zones(ring, box, intensity) is the dashcam field, 1 outside."""
    fixed = fixed_rate(points, sensors, key, reach)
    near = spatial.within(points, corridor, ace_reach, ("px", "py"), how="left_semi").select(key, F.lit(True).alias("near"))
    field = spatial.in_polygons(points, zones, zone_size, ("px", "py")).select(key, "zone_id", "intensity")
    # the facets are laid one under another and meet in one aggregate by key, not in a join for each
    facets = points.select(key)
    for facet in (fixed, near, field):
        facets = facets.unionByName(facet, allowMissingColumns=True)
    all_ = facets.groupBy(key).agg(F.max("fixed").alias("fixed"), F.bool_or("near").alias("near"), F.min_by("intensity", "zone_id").alias("zone"))
    rate = rates(F.lit(float(hour)), F.coalesce("near", F.lit(False)), F.coalesce("zone", F.lit(1.0)), F.lit(ROBOT_NO_FIELD), F.lit(1.0))
    return all_.select(key, F.coalesce("fixed", F.lit(0.0)).alias("fixed"), *(c.alias(n) for n, c in rate.items()))


def walk_ticks(route: DataFrame, key: str, speed: float = WALK_MPS) -> DataFrame:
    """(key, tick, t, weight, px, py) each second of walking each route's points, and its end."""
    m = sequence.measured(route, key)
    dur = m.groupBy(key).agg((F.max("cum_m") / speed).alias("dur"))
    t = sequence.ticks(dur, "dur").withColumn("arc", F.col("t") * speed)
    return sequence.at_arc(t, route, key).select(key, "tick", "t", "weight", F.col("x").alias("px"), F.col("y").alias("py"))


@dataclass(frozen=True)
class Fields:
    """What varies over the city and the day; what is None takes the default of its class.

    zones(zone_id, ring, box, dashcam, tesla): intensities by polygon, the first that holds a point; outside, dashcams count
    as 1 and Teslas as TESLA_OUTSIDE. robots(cx, cy, score): cells of `cell` metres; elsewhere ROBOT_OUTSIDE.
    day(minute, headway, traffic): each minute of a real day."""

    zones: DataFrame | None = None
    zone_size: float = 200.0
    robots: DataFrame | None = None
    cell: float = 100.0
    day: DataFrame | None = None


def with_fields(points: DataFrame, keys: list[str], corridor: DataFrame, fields: Fields) -> DataFrame:
    """points(keys, px, py, ...) with near, zone, tesla and score: every lookup is a facet, laid under the points' own rows, and
    all meet in one aggregate by key."""
    own = [c for c in points.columns if c not in keys]
    facets = points.select(*keys, F.struct(*own).alias("own"))
    found = [spatial.within(points, corridor, ACE_REACH_M, ("px", "py"), how="left_semi").select(*keys, F.lit(True).alias("near"))]
    if fields.zones is not None:
        found.append(spatial.in_polygons(points, fields.zones, fields.zone_size, ("px", "py")).select(*keys, F.struct("zone_id", "dashcam", "tesla").alias("zone")))
    if fields.robots is not None:
        at = points.select(*keys, spatial.cell("px", fields.cell).alias("cx"), spatial.cell("py", fields.cell).alias("cy"))
        found.append(at.join(fields.robots.select("cx", "cy", "score"), ["cx", "cy"]).select(*keys, "score"))
    for facet in found:
        facets = facets.unionByName(facet, allowMissingColumns=True)
    one = lambda name, agg, default: agg(name).alias(name) if name in facets.columns else default.alias(name)
    zone = F.lit(None).cast("struct<zone_id:long,dashcam:double,tesla:double>")
    out = facets.groupBy(*keys).agg(F.first("own", ignorenulls=True).alias("own"), F.coalesce(F.bool_or("near"), F.lit(False)).alias("near"), one("zone", F.min, F.min(zone)), one("score", F.max, F.max(F.lit(None).cast("double"))))
    no_zone, no_score = (1.0, 1.0) if fields.zones is None else (1.0, TESLA_OUTSIDE), ROBOT_NO_FIELD if fields.robots is None else ROBOT_OUTSIDE
    return out.select(*keys, "own.*", "near", F.coalesce("zone.dashcam", F.lit(no_zone[0])).alias("zone"), F.coalesce("zone.tesla", F.lit(no_zone[1])).alias("tesla"), F.coalesce("score", F.lit(no_score)).alias("score"))


def mobile_integral(ticks: DataFrame, key: str, departure: float, corridor: DataFrame, fields: Fields = Fields()) -> DataFrame:  # noqa: B008
    """(key, ace, ..., tesla): the rates summed over ticks(key, tick, t, weight, px, py); `weight` is a tick's seconds, hours
    follow the walk. A tick's fields are looked up in one pass; a real day is joined by minute (at most 1440 rows)."""
    hour = F.lit(departure) + F.col("t") / 3600
    looked_up = with_fields(ticks, [key, "tick"], corridor, fields)
    real: dict[str, Column] = {}
    if fields.day is not None:
        minute = F.floor((hour - 24 * F.floor(hour / 24)) * 60)
        looked_up = looked_up.withColumn("minute", minute).join(F.broadcast(fields.day.where("minute BETWEEN 0 AND 1439").select("minute", "headway", "traffic")), "minute", "left")
        real = {"headway": F.coalesce("headway", scalar.headway_step(hour)), "traffic": F.coalesce("traffic", scalar.traffic(hour))}
    rate = rates(hour, F.col("near"), F.col("zone"), F.col("score"), F.col("tesla"), **real)
    return looked_up.groupBy(key).agg(*(F.sum(c / 60 * F.col("weight")).alias(n) for n, c in rate.items()))


def tally(seen: DataFrame, keys: list[str], factor: float = 1 / RECALL) -> DataFrame:
    """(keys, devices, frames, covered_s, grouped) of captures(keys, tick, weight, sensor_id, kind, grp, confirmed, frame_rate).
    With a column `copies` a sensor stands for as many of its group."""
    copies = F.col("copies") if "copies" in seen.columns else F.lit(1).cast("long")
    # each capture counts for its device, its tick and its group, so that captures are computed once
    facet = lambda i, key, value: F.struct(F.lit(i).alias("facet"), F.col(key).cast("long").alias("id"), value.alias("value"), copies.alias("copies"))
    facets = F.array(facet(0, "sensor_id", F.col("frame_rate") * F.col("weight") * copies), facet(1, "tick", F.col("weight")), facet(2, "grp", F.lit(0.0)))
    rows = seen.select(*keys, "confirmed", F.explode(facets).alias("f")).groupBy(*keys, "f.facet", "f.id")
    one = rows.agg(F.sum("f.value").alias("total"), F.max("f.value").alias("weight"), F.max("f.copies").alias("copies"), F.bool_or("confirmed").alias("ok"))
    of = lambda i, value: F.when(F.col("facet") == i, value)
    return one.groupBy(*keys).agg(
        F.coalesce(F.sum(of(0, F.col("copies"))), F.lit(0)).alias("devices"),
        F.sum(of(0, F.col("total"))).alias("frames"),
        F.sum(of(1, F.col("weight"))).alias("covered_s"),
        F.sum(of(2, F.when(F.col("ok"), 1.0).otherwise(factor))).alias("grouped"),
    )


def grouped(sensors: DataFrame, labels: DataFrame) -> DataFrame:
    """sensors with grp (from labels(node_id, component)) and confirmed: a group with any member that was surveyed."""
    g = sensors.join(labels.select(F.col("node_id").alias("sensor_id"), F.col("component").alias("grp")), "sensor_id")
    ok = g.groupBy("grp").agg(F.bool_or(F.col("kind") != "FixedCctv").alias("confirmed"))
    return g.join(ok, "grp")


