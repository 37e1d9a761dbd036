"""Scans and sinks over text made from the test tables: what a reader parses must equal what was written into the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo, scalar
from kerbside.operators import geometry, spatial
from kerbside.operators.graph import shared_dir
from kerbside.sources import readers, sinks

from .registry import query
from .scalars import r
from .views import Tables


def place(t: Tables, name: str) -> str:
    """A fresh path in the shared folder."""
    import uuid

    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of a range in which the JSON scans read, so that also these small documents are read in parts.
SPLIT = 4096


def documents(rows: DataFrame, key: str, made) -> DataFrame:
    """One JSON document for each fifty keys: no task gathers a whole table."""
    return rows.groupBy(F.floor(F.col(key) / 50).alias("document")).agg(made.alias("value")).select("value")


@query("scan_csv_named", "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS bal FROM supplier")
def scan_csv_named(t: Tables) -> DataFrame:
    bal = F.when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit("  "), F.col("s_acctbal").cast("string")))
    t.supplier.select(F.col("s_name").alias("name"), F.lit("x").alias("extra"), bal.alias("bal"), F.col("s_suppkey").alias("id")).write.option("header", True).csv(path := place(t, "named"))
    return readers.csv_named(t.spark, path, {"id": "long", "name": "string", "bal": "double"})


@query("scan_csv_positional", "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 4 = 0 THEN 0.0e0 ELSE s_acctbal END AS bal FROM supplier WHERE s_suppkey % 7 <> 0")
def scan_csv_positional(t: Tables) -> DataFrame:
    bad = F.when(F.col("s_suppkey") % 7 == 0, "?").otherwise(F.col("s_suppkey").cast("string"))
    t.supplier.select(bad.alias("a"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("b")).write.option("header", True).csv(path := place(t, "positional"))
    return readers.csv_positional(t.spark, path, [("id", "long", -1), ("bal", "double", 0.0)]).where("id >= 0")


@query("scan_csv_typed", "SELECT s_suppkey AS id, s_acctbal AS bal FROM supplier")
def scan_csv_typed(t: Tables) -> DataFrame:
    t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")).write.option("header", True).csv(path := place(t, "typed"))
    return readers.csv_typed(t.spark, path, "id long, bal double")


@query("scan_json_rows", "SELECT CAST(s_suppkey AS BIGINT) AS id, s_acctbal AS bal FROM supplier")
def scan_json_rows(t: Tables) -> DataFrame:
    row = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").cast("string").alias("bal"))
    documents(t.supplier, "s_suppkey", F.to_json(F.collect_list(row))).write.text(path := place(t, "rows"))
    rows = readers.json_rows(t.spark, path, "id string, bal string", SPLIT)
    return rows.select(F.col("id").try_cast("long").alias("id"), F.col("bal").try_cast("double").alias("bal"))


@query("scan_json_map", "SELECT CAST(n_nationkey AS VARCHAR) AS geoid, CAST(n_nationkey * 100 AS BIGINT) AS total, CAST(n_nationkey * 7 AS BIGINT) AS white FROM nation")
def scan_json_map(t: Tables) -> DataFrame:
    entry = F.struct(F.col("n_nationkey").cast("string").alias("key"), F.struct((F.col("n_nationkey") * 100).alias("total"), (F.col("n_nationkey") * 7).alias("white")).alias("value"))
    documents(t.nation, "n_nationkey", F.to_json(F.map_from_entries(F.collect_list(entry)))).write.text(path := place(t, "map"))
    return readers.json_map(t.spark, path, "total:bigint,white:bigint", size=SPLIT)


@query("scan_overpass", "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'node' ELSE 'way' END AS type, 40.0e0 + s_suppkey / 1000.0e0 AS lat, s_name AS maker FROM supplier")
def scan_overpass(t: Tables) -> DataFrame:
    node = F.col("s_suppkey") % 2 == 0
    lat = F.expr("40.0e0 + s_suppkey / 1000.0e0")
    e = F.struct(F.when(node, "node").otherwise("way").alias("type"), F.col("s_suppkey").alias("id"), F.when(node, lat).alias("lat"), F.when(node, F.lit(-74.0)).alias("lon"), F.when(~node, F.struct(lat.alias("lat"), F.lit(-74.0).alias("lon"))).alias("center"), F.create_map(F.lit("manufacturer"), F.col("s_name")).alias("tags"))
    documents(t.supplier, "s_suppkey", F.to_json(F.struct(F.collect_list(e).alias("elements")))).write.text(path := place(t, "overpass"))
    return readers.overpass(t.spark, path, SPLIT).select("id", "type", "lat", F.col("tags")["manufacturer"].alias("maker"))


def _features(t: Tables, geometry_: str, props) -> DataFrame:
    """The zones' rings as FeatureCollections on disk, read again."""
    ring = "array_join(transform(ring, p -> concat('[', p.x, ',', p.y, ']')), ',')"
    g = F.expr(geometry_.replace("RING", ring))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), g, F.lit("}"))
    documents(t.zone_rings, "zone_id", F.concat(F.lit('{"features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}"))).write.text(path := place(t, "geojson"))
    return readers.geojson(t.spark, path, SPLIT)


POLY = "CASE WHEN zone_id % 2 = 0 THEN concat('{\"type\":\"Polygon\",\"coordinates\":[[', RING, ']]}') ELSE concat('{\"type\":\"MultiPolygon\",\"coordinates\":[[[', RING, ']],[[', RING, ']]]}') END"


@query("scan_geojson_rings", "SELECT zone_id, part, CAST(6 AS BIGINT) AS corners FROM v_zones CROSS JOIN (SELECT CAST(0 AS BIGINT) AS part UNION ALL SELECT 1) p WHERE part = 0 OR zone_id % 2 = 1")
def scan_geojson_rings(t: Tables) -> DataFrame:
    f = _features(t, POLY, F.expr("concat('{\"zone\":', zone_id, '}')"))
    return readers.geojson_rings(f).select(readers.prop("zone", kind="long").alias("zone_id"), "part", F.size("ring").cast("long").alias("corners"))


@query("scan_geojson_lines", "SELECT zone_id, CAST(6 AS BIGINT) AS points FROM v_zones")
def scan_geojson_lines(t: Tables) -> DataFrame:
    line = "CASE WHEN zone_id % 2 = 0 THEN concat('{\"type\":\"LineString\",\"coordinates\":[', RING, ']}') ELSE concat('{\"type\":\"MultiLineString\",\"coordinates\":[[', RING, ']]}') END"
    f = _features(t, line, F.expr("concat('{\"zone\":', zone_id, '}')"))
    return readers.geojson_lines(f).select(readers.prop("zone", kind="long").alias("zone_id"), F.size("line").cast("long").alias("points"))


@query("scan_geojson_props_coalesce", "SELECT CAST(zone_id AS VARCHAR) AS geoid FROM v_zones")
def scan_geojson_props_coalesce(t: Tables) -> DataFrame:
    props = F.expr("CASE zone_id % 3 WHEN 0 THEN concat('{\"GEOID\":\"', zone_id, '\"}') WHEN 1 THEN concat('{\"GEOID20\":', zone_id, '}') ELSE concat('{\"geoid\":', zone_id, '}') END")
    return _features(t, POLY, props).select(readers.prop("GEOID", "GEOID20", "geoid").alias("geoid"))


@query("scan_gtfs", "SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, COUNT(*) AS stops FROM lineitem GROUP BY 1")
def scan_gtfs(t: Tables) -> DataFrame:
    path = place(t, "gtfs")
    s = lambda c: F.col(c).cast("string")
    made = {
        "routes": t.supplier.select(s("s_suppkey").alias("route_id"), F.col("s_name").alias("route_short_name"), F.lit("").alias("route_long_name")),
        "trips": t.orders.select(F.lit("1").alias("route_id"), F.lit("W").alias("service_id"), s("o_orderkey").alias("trip_id"), F.lit("0").alias("direction_id"), F.lit("1").alias("shape_id")),
        "stops": t.part.select(s("p_partkey").alias("stop_id"), F.col("p_name").alias("stop_name"), F.lit(" 40.7").alias("stop_lat"), F.lit("-74").alias("stop_lon")),
        "stop_times": t.lineitem.select(s("l_orderkey").alias("trip_id"), F.lit("25:10:00").alias("arrival_time"), F.lit("25:10:00").alias("departure_time"), s("l_partkey").alias("stop_id"), s("l_linenumber").alias("stop_sequence")),
    }
    for name, df in made.items():
        df.write.option("header", True).csv(f"{path}/{name}.txt")
    feed = {n: readers.csv_named(t.spark, f"{path}/{n}.txt", {c.split()[0]: "string" for c in readers.GTFS[n].split(", ")}) for n in made}
    times = feed["stop_times"].withColumn("minute", scalar.gtfs_minutes("arrival_time")).where("minute IS NOT NULL")
    return times.join(feed["trips"], "trip_id").join(feed["stops"], "stop_id").groupBy("trip_id").agg(F.count("*").alias("stops"))


@query("scan_layer", "SELECT sensor_id, kind FROM v_sensors")
def scan_layer(t: Tables) -> DataFrame:
    sinks.write_layer(t.sensors, path := place(t, "layer"), {"source": "test", "license": "none", "as_of": "2024-01-01"})
    return sinks.read_layer(t.spark, path)[0].select("sensor_id", "kind")


@query("scan_remote_parquet", "SELECT CAST(event_id AS BIGINT) AS id, CAST(EXTRACT(HOUR FROM ts) * 60 + EXTRACT(MINUTE FROM ts) AS BIGINT) AS pu_min FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' AND user_id % 5 < 3")
def scan_remote_parquet(t: Tables) -> DataFrame:
    day = t.events.where("ts >= TIMESTAMP_NTZ'2024-01-05' AND ts < TIMESTAMP_NTZ'2024-01-06' AND user_id % 5 < 3")
    return day.select(F.col("event_id").cast("long").alias("id"), (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("pu_min"))


@query("gen_grid_graph", "SELECT CAST(k % 21 - 10 AS DOUBLE) * 80.0e0 AS x, CAST(FLOOR(k / 21.0e0) - 10 AS DOUBLE) * 80.0e0 AS y FROM (SELECT UNNEST(RANGE(0, 441)) AS k) q")
def gen_grid_graph(t: Tables) -> DataFrame:
    return readers.grid_graph(t.spark, 21, 21, 80.0)[0].select("x", "y")


@query("concat_feeds", "SELECT id, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS feed FROM (SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier) q")
def concat_feeds(t: Tables) -> DataFrame:
    ids = t.supplier.select(F.col("s_suppkey").cast("long").alias("id"))
    return readers.concat_feeds([ids.where("id % 2 = 0").withColumn("feed", F.lit("a")), ids.withColumn("feed", F.lit("b"))], "id")


@query("sink_layer", "SELECT 'test' AS source, COUNT(*) AS n FROM v_sensors")
def sink_layer(t: Tables) -> DataFrame:
    sinks.write_layer(t.sensors, path := place(t, "layer"), {"source": "test", "license": "none"}, ["kind"])
    df, about = sinks.read_layer(t.spark, path)
    return df.agg(F.lit(about["source"]).alias("source"), F.count("*").alias("n"))


@query("sink_csv", "SELECT PRINTF('%.6f', x / 1000.0e0) AS lon, PRINTF('%.6f', y / 1000.0e0) AS lat, kind AS subtype FROM v_sensors")
def sink_csv(t: Tables) -> DataFrame:
    sinks.write_points(t.sensors.select((F.col("x") / 1000).alias("lon"), (F.col("y") / 1000).alias("lat"), F.col("kind").alias("subtype")), path := place(t, "points"))
    return t.spark.read.schema("lon string, lat string, subtype string").option("header", True).csv(path)


@query("sink_quant_polyline", "SELECT route_id, seq, ROUND(x - FIRST_VALUE(x) OVER w) + FIRST_VALUE(x) OVER w AS x FROM v_route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def sink_quant_polyline(t: Tables) -> DataFrame:
    origin, dx, dy = geometry.quantized(F.col("ring"))
    q = geometry.rings(t.route_points, "route_id", "seq").select("route_id", origin.alias("origin"), dx.alias("dx"), dy.alias("dy"))
    back = q.select("route_id", F.posexplode(geometry.dequantized(F.col("origin"), F.col("dx"), F.col("dy"))).alias("seq", "p"))
    return back.select("route_id", F.col("seq").cast("long").alias("seq"), r("p.x").alias("x"))


@query("scan_citygml", "SELECT zone_id, COUNT(*) AS corners FROM v_ring_points GROUP BY zone_id")
def scan_citygml(t: Tables) -> DataFrame:
    """Buildings of an XML file with the places that their ground rings contain; every ring contains its own centre."""
    ring = F.expr("array_join(transform(ring, p -> concat(p.x, ' ', p.y)), ' ')")
    cx, cy = geo.vertex_mean("ring")
    made = t.zone_rings.select(F.concat(F.lit("<Building><id>"), "zone_id", F.lit("</id><ground>"), ring, F.lit("</ground></Building>")).alias("value"))
    made.agg(F.concat(F.lit("<City>"), F.array_join(F.collect_list("value"), ""), F.lit("</City>")).alias("value")).write.text(path := place(t, "citygml"))
    rows = readers.citygml_buildings(t.spark, path, "id long, ground string")
    n = F.split("ground", " ")
    at = lambda k: F.transform(F.filter(n, lambda _, i: i % 2 == k), lambda v: v.cast("double"))
    rings = rows.select("id", F.transform(F.arrays_zip(at(0).alias("x"), at(1).alias("y")), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("ring"))
    rings = rings.withColumns(dict(zip(("minx", "miny", "maxx", "maxy"), geo.ring_bbox("ring"), strict=True)))
    marks = t.zone_rings.select("zone_id", cx.alias("px"), cy.alias("py"))
    found = spatial.in_polygons(marks, rings, 200.0, ("px", "py")).where("id = zone_id")
    return found.select("zone_id", F.size("ring").cast("long").alias("corners"))


@query("scan_http_api", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey = 1")
def scan_http_api(t: Tables) -> DataFrame:
    """An answer of an open-data query, as it lands: an array of objects with every value as text."""
    row = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    documents(t.nation.where("n_regionkey = 1"), "n_nationkey", F.to_json(F.collect_list(row))).write.text(path := place(t, "answer"))
    return readers.json_rows(t.spark, path, "id string, name string", SPLIT).select(F.col("id").try_cast("long").alias("id"), "name")
