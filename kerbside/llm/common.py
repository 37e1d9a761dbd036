"""What every operator here shares: the session's shared folder, scratch tables and Arrow batch limits."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: what a Python worker holds of its input at a time.
BATCH_ROWS = 4000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches and lets local Python workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine (local master) that
    leaves it unset gets a temporary folder; on a cluster that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='kerbside-')}"
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes the folders that stored() wrote for dfs, once what was made of them is stored itself. The collector of the
    driver's JVM is asked to run, as Spark deletes a finished query's shuffle files only when the query is collected."""
    for df in dfs:
        context = df.sparkSession.sparkContext
        if path := getattr(df, "_stored_at", None):
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
            context._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, in any case: what an operator adds takes their place."""
    return df.select(*(df[f"`{c}`"] for c in df.columns if c.lower() not in names))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text; empty where it is null."""
    return F.coalesce(df[column], F.lit(""))


def batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 2000, weigh=None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows; weigh gives a row's bytes, of which a batch holds about `most`."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= size or weight >= most:
            yield record_batch(schema, held)
            held, weight = [], 0
    if held:
        yield record_batch(schema, held)


def record_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def give_back() -> None:
    """Returns what this worker has freed to the system, at the end of a task: the worker is used again by other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
