"""Readers with explicit schemas: bad cells become null or a default and are then filtered, as each source's rules say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import scalar

from . import jsonsplit

POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
MULTI = "struct<type:string,coordinates:array<array<array<array<double>>>>>"
LINE = "struct<type:string,coordinates:array<array<double>>>"
FEATURE = "struct<properties:string,geometry:string>"
ELEMENT = "struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,nodes:array<bigint>,tags:map<string,string>>"
#: The seven files of a timetable feed and the columns that are read.
GTFS = {
    "routes": "route_id string, route_short_name string, route_long_name string",
    "trips": "route_id string, service_id string, trip_id string, direction_id string, shape_id string",
    "stops": "stop_id string, stop_name string, stop_lat string, stop_lon string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string",
    "shapes": "shape_id string, shape_pt_lat string, shape_pt_lon string, shape_pt_sequence string",
    "calendar": "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type string",
}


def require_non_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def csv_named(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """Columns by header name, in any order, rows of any length; a missing column fails. wanted: name -> type; cells are
    trimmed, bad ones null."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in wanted if c not in header]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in header)).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*(F.trim(F.col(f"`{c}`")).try_cast(kind).alias(c) for c, kind in wanted.items()))


def csv_positional(spark: SparkSession, path: str, columns: list[tuple[str, str, object]], header: bool = True) -> DataFrame:
    """(name, type, default) by position; missing or bad cells take the default."""
    raw = spark.read.schema(", ".join(f"`{n}` string" for n, _, _ in columns)).option("header", header).option("enforceSchema", True).csv(path)
    return raw.select(*((F.coalesce(c, F.lit(d).cast(k)) if d is not None else c).alias(n) for n, k, d in columns for c in [F.trim(F.col(n)).try_cast(k)]))


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cell of the wrong type fails the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def json_rows(spark: SparkSession, path: str, schema: str, size: int = jsonsplit.RANGE) -> DataFrame:
    """An array of objects over several lines."""
    return jsonsplit.json_records(spark, path, jsonsplit.ARRAY, size).select(F.from_json("value", schema).alias("v")).select("v.*")


def json_map(spark: SparkSession, path: str, value: str, key: str = "geoid", size: int = jsonsplit.RANGE) -> DataFrame:
    """{key: {..}} as rows."""
    records = jsonsplit.json_records(spark, path, jsonsplit.ENTRIES, size)
    return records.select(F.col("key").alias(key), F.from_json("value", f"struct<{value}>").alias("v")).select(key, "v.*")


def overpass(spark: SparkSession, path: str, size: int = jsonsplit.RANGE) -> DataFrame:
    """Elements (type, id, lat, lon, nodes, tags); a way's centre stands in for its place."""
    e = jsonsplit.json_records(spark, path, "elements", size).select(F.from_json("value", ELEMENT).alias("e")).select("e.*")
    return e.select("type", "id", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), "nodes", "tags")


def geojson(spark: SparkSession, path: str, size: int = jsonsplit.RANGE) -> DataFrame:
    """(feature, properties, geometry), the last two as JSON text; feature is the byte at which it begins in its file."""
    records = jsonsplit.json_records(spark, path, "features", size).select("place", F.from_json("value", FEATURE).alias("f"))
    return records.select(F.col("place").alias("feature"), "f.properties", "f.geometry")


def _points(coords: Column) -> Column:
    return F.transform(coords, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def geojson_rings(features: DataFrame, least: int = 3) -> DataFrame:
    """One row for each polygon part: its exterior ring of at least `least` points. Other geometries have none."""
    kind = F.get_json_object("geometry", "$.type")
    rings = F.when(kind == "Polygon", F.array(F.from_json("geometry", POLYGON).getField("coordinates")[0])).when(
        kind == "MultiPolygon", F.transform(F.from_json("geometry", MULTI).getField("coordinates"), lambda p: p[0])
    )
    parts = features.select("feature", "properties", F.posexplode(rings).alias("part", "ring")).select("feature", "properties", F.col("part").cast("long").alias("part"), _points(F.col("ring")).alias("ring"))
    return parts.where(F.size("ring") >= least)


def geojson_lines(features: DataFrame) -> DataFrame:
    """One row for each line of LineString and MultiLineString."""
    kind = F.get_json_object("geometry", "$.type")
    many = F.from_json("geometry", POLYGON).getField("coordinates")
    lines = F.when(kind == "LineString", F.array(F.from_json("geometry", LINE).getField("coordinates"))).when(kind == "MultiLineString", many)
    return features.select("feature", "properties", F.posexplode(lines).alias("part", "line")).select("feature", "properties", F.col("part").cast("long").alias("part"), _points(F.col("line")).alias("line"))


def prop(*names: str, kind: str = "string") -> Column:
    """The first of a feature's properties that is there, as `kind`."""
    return F.coalesce(*(F.get_json_object("properties", f"$.{n}") for n in names)).try_cast(kind)


def gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The feed's tables by name."""
    return {n: csv_named(spark, f"{folder}/{n}.txt", {c.split()[0]: "string" for c in ddl.split(", ")}) for n, ddl in GTFS.items()}


def trips_parquet(df: DataFrame, zones: list[int], day: str, at: str = "pickup", to: str = "dropoff") -> DataFrame:
    """Trips of a day between zones: the filters reach the scan; minute of day and a duration of at least one minute."""
    picked = df.where((F.to_date(at) == F.lit(day).cast("date")) & F.col("pu_zone").isin(zones))
    return picked.select("pu_zone", "do_zone", (F.hour(at) * 60 + F.minute(at)).cast("long").alias("pu_min"), F.greatest(F.lit(1), F.timestamp_diff("MINUTE", F.col(at), F.col(to))).cast("long").alias("dur_min"))


def citygml_buildings(spark: SparkSession, path: str, schema: str, tag: str = "Building") -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def concat_feeds(feeds: list[DataFrame], key: str) -> DataFrame:
    """Feeds one after another; of rows with the same key the first feed's stays."""
    from kerbside.operators.spatial import first_per

    out = None
    for i, f in enumerate(feeds):
        f = f.withColumn("__feed", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return first_per(out, [key], "__feed").drop("__feed")


def grid_graph(spark: SparkSession, rows: int, cols: int, spacing: float) -> tuple[DataFrame, DataFrame]:
    """A lattice centred on the origin: nodes, and edges to the east and the north, numbered in order."""
    at = spark.range(rows * cols).select(F.col("id").alias("node_id"), (F.col("id") % cols).alias("c"), F.floor(F.col("id") / cols).alias("r"))
    nodes = at.select("node_id", ((F.col("c") - (cols - 1) / 2) * spacing).alias("x"), ((F.col("r") - (rows - 1) / 2) * spacing).alias("y"), "c", "r")
    east = nodes.where(F.col("c") < cols - 1).select((F.col("r") * (cols - 1) + F.col("c")).alias("edge_id"), F.col("node_id").alias("from_id"), (F.col("node_id") + 1).alias("to_id"))
    north = nodes.where(F.col("r") < rows - 1).select((F.col("node_id") + rows * (cols - 1)).alias("edge_id"), F.col("node_id").alias("from_id"), (F.col("node_id") + cols).alias("to_id"))
    return nodes.drop("c", "r"), east.union(north).withColumn("length_m", F.lit(float(spacing)))


def online_kiosks(rows: DataFrame) -> DataFrame:
    """Kiosks with a place; live where their status says so."""
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    return rows.select(lat.alias("lat"), lon.alias("lon"), (F.lower(F.trim("status")) == "live").alias("wifi_live")).where("lat IS NOT NULL AND lon IS NOT NULL")


def facilities(rows: DataFrame, borough: str | None = None) -> DataFrame:
    out = rows if borough is None else rows.where(F.upper(F.trim("boro")) == borough.upper())
    kind = scalar.facility_kind("facgroup")
    return out.select(F.col("facname").alias("name"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), kind.alias("kind")).where("kind IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def soda_url(base: str, where: str = "", select: tuple[str, ...] = (), group: tuple[str, ...] = (), limit: int | None = None) -> str:
    """The address of an open-data query; its answer is landed as JSON and read by json_rows."""
    from urllib.parse import quote, urlencode

    parts = {"$where": where, "$select": ",".join(select), "$group": ",".join(group), "$limit": limit}
    return f"{base}?{urlencode({k: v for k, v in parts.items() if v}, quote_via=quote)}"
