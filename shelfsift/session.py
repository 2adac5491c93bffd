"""Session settings and the few helpers that look at sizes or cut lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side table may be copied to every executor up to these sizes. Above them, joins shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A scan below this size is dealt out, because a small file may be a single split. Larger ones are never shuffled.
SPREAD_BYTES = 64 * 1024 * 1024


def build_session(app: str = "shelfsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; any setting can be overridden by ``conf``."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # texts are long: keep the batches that go to Python small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{name.replace("__", "."): value for name, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal out a scan of less than ``SPREAD_BYTES`` by a key.

    The choice depends on the size of the files alone, not on the cluster: a scan of that size or more comes back
    unchanged on every cluster, and the shuffle of a smaller one is bounded. Call it on plain scans.
    """
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism, key) if size < SPREAD_BYTES else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that ``spark.checkpoint.dir`` names.

    Only a single-process local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="shelfsift-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there: columns of it, in a fraction of the disk that
    ``cut_lineage`` needs for texts and token lists. Rows come back in any order and other partitions."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(rows: int, size: int | None, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a table of so many rows and text bytes may be copied to every executor."""
    return rows <= limit and (size or 0) <= BROADCAST_BYTES


def table_size(*columns: str) -> list[Column]:
    """Aggregates that measure a table of text columns: its rows and its bytes."""
    size = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in columns), F.lit(0))
    return [F.count("*").alias("rows"), F.sum(size.cast("bigint")).alias("size")]


def sided(df: DataFrame, *columns: str, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """A stored table marked to be copied to the tasks of a join, if its text ``columns`` may be; else None."""
    measured = df.agg(*table_size(*columns)).first()
    return F.broadcast(df) if fits_broadcast(measured["rows"], measured["size"], limit) else None


def small_table(df: DataFrame, limit: int = BROADCAST_ROWS) -> pa.Table | None:
    """The rows of a table of text columns if they may be copied to every executor, else None.

    The table is measured first, so nothing larger ever reaches the driver. It is read
    twice: give a stored one (``cut_lineage``) where computing it is costly.
    """
    measured = df.agg(*table_size(*df.columns)).first()
    return df.toArrow() if fits_broadcast(measured["rows"], measured["size"], limit) else None
