"""The folder that driver and executors share, written tables, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a broadcast may hold; more are joined by a shuffle. A row counts ROW_COST bytes, VALUE_COST for each plain value (as hashed relations were measured) and those of its strings and arrays.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
ROW_COST, VALUE_COST = 32, 24
_PLAIN = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
_made: list[str] = []


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only on one machine is a new local folder set where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            found = kept.get()
        elif spark.sparkContext.master.partition("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="tidelock-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Delete the tables written so far but for those that `keep` reads. For callers that have written their result elsewhere."""
    held = [f.rsplit("/", 1)[0].rstrip("/").rpartition(":")[2].lstrip("/") for f in keep.inputFiles()] if keep is not None else []
    for path in list(_made):
        if path.rpartition(":")[2].lstrip("/") not in held:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _made.remove(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, limit: int = BROADCAST_BYTES) -> bool:
    """Counted by partial sums in each task; only these meet."""
    plain = [c for c, kind in df.dtypes if kind in _PLAIN]
    sizes = [F.sum(F.octet_length(F.col(c).cast("string"))) for c in df.columns if c not in plain]
    n, *wide = df.agg(F.count(F.lit(1)), *sizes).first()
    return n <= rows and n * (ROW_COST + VALUE_COST * len(plain)) + 2 * sum(x or 0 for x in wide) <= limit


def small(df: DataFrame, rows: int = BROADCAST_ROWS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most so many rows and bytes."""
    return F.broadcast(df) if is_small(df, rows, limit) else df
