"""A service day of a timetable feed: which services run, which trips are enforced, and where their stops lie along the shapes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo, scalar
from kerbside.operators import sequence

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def active_services(calendar: DataFrame, exceptions: DataFrame, day: str) -> DataFrame:
    """(service_id) that run on a day (YYYYMMDD): those whose week and dates say so, and those added for it, but none that is
    removed for it. A service needs no row in the calendar to be added."""
    weekday = WEEKDAYS[dt.datetime.strptime(day, "%Y%m%d").weekday()]
    number = lambda c: F.coalesce(F.trim(c).try_cast("long"), F.lit(0))
    usual = calendar.where((F.trim(weekday) == "1") & F.lit(int(day)).between(number("start_date"), number("end_date"))).select("service_id", F.lit(0).alias("kind"))
    today = exceptions.where(number("date") == int(day)).select("service_id", number("exception_type").alias("kind"))
    both = usual.unionByName(today.where("kind IN (1, 2)"))
    return both.groupBy("service_id").agg(F.max("kind").alias("kind")).where("kind < 2").select("service_id")


def enforced_routes(routes: DataFrame, listed: DataFrame, only_m: bool = False) -> DataFrame:
    """(route_id, name) of routes whose base name is that of a listed(route, program) route under enforcement."""
    bases = listed.where(F.upper("program") == "ACE").select(scalar.route_base("route", only_m).alias("base")).where("base IS NOT NULL").distinct()
    named = routes.select("route_id", F.col("route_short_name").alias("name"), scalar.route_base("route_short_name", only_m).alias("base"))
    return named.join(bases, "base", "left_semi").select("route_id", "name")


def placed(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    """rows with x, y in metres, to the micrometre; a bad coordinate counts as 0, as feeds pad and break them. Degrees as doubles
    are off by some nanometres, which would decide between stretches that are equally near to a stop."""
    degrees = lambda c: F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))
    return rows.withColumns({"x": F.round(geo.enu_x(degrees(lon)), 6), "y": F.round(geo.enu_y(degrees(lat)), 6)})


def shape_points(shapes: DataFrame) -> DataFrame:
    """(shape_id, seq, x, y)."""
    return placed(shapes, "shape_pt_lat", "shape_pt_lon").select("shape_id", F.coalesce(F.trim("shape_pt_sequence").try_cast("long"), F.lit(0)).alias("seq"), "x", "y")


def stop_arcs(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs(shape_id, stop_id, px, py) with `arc`, the length along the shape of its point nearest to the stop, the first on
    ties: an equi-join on the shape, then an aggregate over its stretches."""
    s = sequence.spans(sequence.measured(points, "shape_id"), "shape_id", "cum_m", "x", "y")
    t = geo.along("px", "py", "x0", "y0", "x1", "y1")
    d2 = geo.distance2("px", "py", geo.lerp("x0", "x1", t), geo.lerp("y0", "y1", t))
    near = pairs.join(s, "shape_id").select("shape_id", "stop_id", "seq", F.round(d2, 6).alias("d2"), geo.lerp("a0", "a1", t).alias("arc"))
    return near.groupBy("shape_id", "stop_id").agg(F.min_by("arc", F.struct("d2", "seq")).alias("arc"))


def keyframes(feed: dict[str, DataFrame], routes: DataFrame, day: str) -> DataFrame:
    """(trip_id, route_id, name, seq, minute, arc) of the trips of routes(route_id, name) that run on a day, at their stops in
    order. Linear referencing is forward only: a stop never lies before an earlier one of its trip. Stops without a time or a
    place are left out, and so are trips with fewer than two or whose shape has fewer than two points. Distinct pairs of shape
    and stop are projected once, however many trips serve them."""
    trips = feed["trips"].join(active_services(feed["calendar"], feed["calendar_dates"], day), "service_id", "left_semi").join(routes, "route_id").select("trip_id", "route_id", "name", "shape_id")
    times = feed["stop_times"].select("trip_id", "stop_id", F.coalesce(F.trim("stop_sequence").try_cast("long"), F.lit(0)).alias("seq"), scalar.gtfs_minutes("departure_time").alias("minute")).where("minute IS NOT NULL")
    served = times.join(trips, "trip_id")
    stops = placed(feed["stops"], "stop_lat", "stop_lon").select("stop_id", F.col("x").alias("px"), F.col("y").alias("py"))
    arcs = stop_arcs(served.select("shape_id", "stop_id").distinct().join(stops, "stop_id"), shape_points(feed["shapes"]))
    at = served.join(arcs, ["shape_id", "stop_id"])
    forward = F.max("arc").over(sequence.running("trip_id", "seq", "stop_id"))
    n = F.count("*").over(sequence.Window.partitionBy("trip_id"))
    return at.withColumns({"arc": forward, "n": n}).where("n > 1").select("trip_id", "route_id", "name", "seq", "minute", "arc")


def corridors(feed: dict[str, DataFrame], routes: DataFrame) -> DataFrame:
    """(shape_id, seq, x0, y0, x1, y1): the segments of every shape that a trip of routes(route_id) follows, on any day."""
    used = feed["trips"].join(routes, "route_id", "left_semi").where("shape_id <> ''").select("shape_id").distinct()
    return sequence.segments(shape_points(feed["shapes"]).join(used, "shape_id", "left_semi"), "shape_id")
