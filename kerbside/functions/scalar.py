"""Scalar rules: time of day, classes, names, and the dimension of sensing sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geo import col

#: Kind, confidence tier, label, is_fixed, recall_corrected, label of a fixed source in attestations.
SOURCES = (
    ("FixedCctv", "B", "Fixed CCTV", True, True, "CCTV census"),
    ("DotLiveView", "A", "DOT live-view", True, False, "NYC DOT camera"),
    ("AceBus", "A", "ACE buses", False, False, None),
    ("Dashcam", "C", "Rideshare cams", False, False, None),
    ("SmartGlasses", "D", "Smart glasses", False, False, None),
    ("Alpr", "A", "ALPR readers", True, False, "DeFlock ALPR"),
    ("DeliveryRobot", "D", "Delivery robots", False, False, None),
    ("TeslaCamera", "C", "Tesla cameras", False, False, None),
    ("EnforcementCamera", "A", "Enforcement cams", True, False, "DOT enforcement"),
)
SOURCES_DDL = "kind string, tier string, label string, is_fixed boolean, recall_corrected boolean, attestation string"
#: Camera makers, by the first rule one of whose parts occurs in the lower-case name; else Other.
MAKERS = (
    (("flock",), "Flock"),
    (("leonardo", "elsag"), "Leonardo"),
    (("redspeed",), "Redspeed"),
    (("ekin",), "Ekin"),
    (("mav",), "Mav"),
    (("genetec", "autovu"), "Genetec"),
    (("motorola", "vigilant", "neology"), "Motorola"),
)
MPH = 0.44704
CLASS_MPH = {2: 40, 9: 30, 3: 30, 4: 35}
DEFAULT_MPH, CAP_MPH = 25, 60
BOROUGHS = {"manhattan": 1, "bronx": 2, "brooklyn": 3, "queens": 4, "statenisland": 5}
#: name -> (lat0, lat1, lon0, lon1)
EXTENTS = {"borough": (40.698, 40.882, -74.022, -73.906), "city": (40.477, 40.925, -74.270, -73.680)}


def source_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, SOURCES_DDL)


def p_at_least_one(mean) -> Column:
    return 1 - F.exp(-col(mean))


def hour24(h) -> Column:
    return F.pmod(col(h), F.lit(24.0))


def headway_step(hour) -> Column:
    """Minutes between buses: 5 in the rush, 10 by day, 25 at night."""
    h = hour24(hour)
    rush = ((h >= 7) & (h < 9)) | ((h >= 16) & (h < 19))
    return F.when(rush, 5.0).when((h >= 6) & (h < 22), 10.0).otherwise(25.0)


def diurnal(hour, floor: float, am: float, pm: float) -> Column:
    """floor plus the rest times the highest of a morning, an evening and a flat midday bell."""
    h = hour24(hour)
    bell = lambda mid, width: F.exp(-((h - mid) / width) * ((h - mid) / width))
    return floor + (1 - floor) * F.greatest(bell(am, 2.6), bell(pm, 2.8), 0.55 * bell(13.0, 4.0))


def traffic(hour) -> Column:
    return diurnal(hour, 0.12, 8.5, 17.5)


def pedestrians(hour) -> Column:
    return diurnal(hour, 0.10, 9.0, 18.0)


def robots(hour) -> Column:
    return diurnal(hour, 0.05, 12.0, 18.5)


def unpack_class(packed) -> tuple[Column, Column]:
    """Road class and posted mph of class * 100 + mph; 0 to 14 are classes alone; other small or negative codes are (0, 0)."""
    c = col(packed).cast("long")
    legacy, full = c.between(0, 14), c >= 100
    return (
        F.when(legacy, c).when(full, F.floor(c / 100).cast("long")).otherwise(F.lit(0).cast("long")),
        F.when(full, F.pmod(c, F.lit(100))).otherwise(F.lit(0).cast("long")),
    )


def class_speed(road_class, posted_mph) -> Column:
    """Metres a second."""
    default = F.lit(float(DEFAULT_MPH))
    for k, mph in CLASS_MPH.items():
        default = F.when(col(road_class) == k, float(mph)).otherwise(default)
    mph = F.when(col(posted_mph) > 0, col(posted_mph).cast("double")).otherwise(default)
    return F.least(mph, F.lit(float(CAP_MPH))) * MPH


def gtfs_minutes(text) -> Column:
    """Minutes of H:M or H:M:S, H up to any number; null if H or M is no number."""
    parts = F.split(F.trim(col(text)), ":")
    h, m = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    return h * 60 + m + F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0)) / 60


def weekday_from_sunday(date) -> Column:
    return (F.dayofweek(col(date)) - 1).cast("long")


def route_base(name, only_m: bool = False) -> Column:
    """Upper-case leading letters and the digits after them; null without digits, or (only_m) unless the letters are M."""
    text = F.trim(col(name))
    base = F.upper(F.regexp_extract(text, "^([A-Za-z]+[0-9]+)", 1))
    keep = base != ""
    if only_m:
        keep &= base.rlike("^M[0-9]")
    return F.when(keep, base)


def in_extent(lat, lon, extent: str = "city") -> Column:
    a, b, c, d = EXTENTS[extent]
    return col(lat).between(a, b) & col(lon).between(c, d)


def borough_code(name) -> Column:
    key = F.lower(F.regexp_replace(col(name), "[ _-]", ""))
    out = F.lit(None).cast("long")
    for k, v in BOROUGHS.items():
        out = F.when(key == k, F.lit(v).cast("long")).otherwise(out)
    return out


def normalize_name(name) -> Column:
    return F.lower(F.regexp_replace(col(name), "[^A-Za-z0-9]", ""))


def maker(name) -> Column:
    low = F.lower(F.coalesce(col(name), F.lit("")))
    out = F.lit("Other")
    for parts, label in reversed(MAKERS):
        out = F.when(low.rlike("|".join(parts)), label).otherwise(out)
    return out


def facility_kind(group) -> Column:
    g = F.upper(F.trim(col(group)))
    return F.when(g == "SCHOOLS (K-12)", "School").when(g == "LIBRARIES", "Library")


def sign_subtype(text) -> Column:
    t = F.upper(col(text))
    return F.when(t.contains("RED LIGHT"), "redlight").when(t.contains("BUS"), "bus").otherwise("speed")


def first_number(text) -> Column:
    """The first parseable number of a list with semicolons."""
    return F.get(F.filter(F.transform(F.split(col(text), ";"), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull()), F.lit(0))


def nonempty(*texts) -> Column:
    """The first text that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(col(t)), F.lit("")) for t in texts))


def thousands(n) -> Column:
    return F.format_number(col(n).cast("long"), 0)


def usd(amount) -> Column:
    a = col(amount)
    return F.when(a >= 1e9, F.format_string("$%.1fB", a / 1e9)).when(a >= 1e6, F.format_string("$%.1fM", a / 1e6)).when(a >= 1e3, F.format_string("$%.0fK", a / 1e3)).otherwise(F.format_string("$%.0f", a))


def coverage_norm(count) -> Column:
    """log(1 + c) against log(1 + 75), within 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p(col(count)) / F.log1p(F.lit(75.0))))


def ellipsize(text, most: int) -> Column:
    return F.when(F.length(col(text)) > most, F.concat(F.left(col(text), F.lit(most - 1)), F.lit("…"))).otherwise(col(text))


def percent_encode(text) -> Column:
    """RFC 3986 unreserved characters stay."""
    out = F.url_encode(col(text))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def round_half_away(v) -> Column:
    return F.round(col(v))
