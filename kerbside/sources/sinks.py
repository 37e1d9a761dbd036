"""Writers: a layer as Parquet with its provenance beside it, and point lists as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_layer(df: DataFrame, path: str, provenance: dict[str, str], partition_by: list[str] | None = None) -> None:
    """Parquet at path, and one JSON row of provenance at path + .provenance, both by Spark's committed writers."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    spark = df.sparkSession
    one = spark.createDataFrame([tuple(provenance.values())], ", ".join(f"{k} string" for k in provenance))
    one.coalesce(1).write.mode("overwrite").json(f"{path}.provenance")


def read_layer(spark, path: str) -> tuple[DataFrame, dict[str, str]]:
    return spark.read.parquet(path), spark.read.json(f"{path}.provenance").first().asDict()


def write_points(df: DataFrame, path: str) -> None:
    """lon, lat, subtype with six decimals."""
    df.select(F.format_string("%.6f", "lon").alias("lon"), F.format_string("%.6f", "lat").alias("lat"), "subtype").write.mode("overwrite").option("header", True).csv(path)
