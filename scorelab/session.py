"""Session defaults and reliable materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", name: str = "scorelab", memory: str = "16g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; make a scratch one only for local masters."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master == "local" or context.master.startswith("local["):  # one machine, not local-cluster
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scorelab-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def materialised(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``materialised`` for wide tables of many rows: columns take a fraction of the disk that checkpointed rows do."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened_store(uri: str):
    """An Arrow file system and the path in it, for a URI as Spark writes it."""
    from pyarrow.fs import FileSystem

    scheme, colon, rest = uri.partition("://")
    if colon and scheme in ("s3a", "s3n"):  # Hadoop's names of the same store
        uri = f"s3://{rest}"
    elif uri.startswith("file:") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return FileSystem.from_uri(uri) if ":" in uri else FileSystem.from_uri(f"file://{uri}")


#: Tables of parameters (one narrow row per key) are broadcast up to so many rows.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = 32_000_000) -> DataFrame:
    """Write a table of parameters (one narrow row per key) and broadcast it if it is small.

    Above ``max_rows`` rows or ``max_bytes`` the plain table comes back, and the
    join shuffles (with adaptive skew handling) instead.
    """
    written = materialised(df)
    texts = [F.sum(F.octet_length(n)) for n, t in written.dtypes if t in ("string", "binary")]
    rows, *lengths = written.agg(F.count(F.lit(1)), *texts).first()
    size = rows * 16 * len(written.columns) + sum(x or 0 for x in lengths)
    return F.broadcast(written) if rows <= max_rows and size <= max_bytes else written
