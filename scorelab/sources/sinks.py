"""Writing result tables so that readers only see complete runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run_table(df: DataFrame, root: str, name: str) -> None:
    """Replace only the partitions of the runs present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(f"{root}/{name}")
    )


def retract_runs(spark: SparkSession, root: str, run_ids: list[str]) -> None:
    """Mark runs as incomplete and drop their partitions before their tables are rewritten.

    Dynamic overwrite replaces only partitions that get rows, so rows of an earlier
    attempt would stay where the new table has none.
    """
    _manifest(spark, root, [(r, False, None) for r in run_ids])
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(hadoop)
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for table in store.listStatus(top):
        if table.isDirectory() and table.getPath().getName() != "run_manifest":
            for r in run_ids:
                store.delete(jvm.org.apache.hadoop.fs.Path(table.getPath(), "run_id=" + escape(r)), True)


def complete_runs(spark: SparkSession, root: str, settings: Mapping[str, str]) -> None:
    """The completion rows, written after every table of the run."""
    _manifest(spark, root, [(r, True, s) for r, s in settings.items()])


def _manifest(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    schema = "run_id string, complete boolean, settings string"
    write_run_table(spark.createDataFrame(rows, schema), root, "run_manifest")


def completed_runs(spark: SparkSession, root: str) -> set[str]:
    """The runs whose completion row is there; none where nothing was written yet. One name per run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/run_manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return set()
    return {r["run_id"] for r in spark.read.parquet(f"{root}/run_manifest").where("complete").select("run_id").collect()}


def read_complete(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of completed runs only (semi join with the manifest)."""
    done = spark.read.parquet(f"{root}/run_manifest").where("complete").select("run_id")
    return spark.read.parquet(f"{root}/{name}").join(done, "run_id", "left_semi")


def write_summary(df: DataFrame, root: str, name: str) -> None:
    """Summary tables span all runs, so the stale version goes."""
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Never overwrites: an existing destination is an error."""
    writer = df.write.mode("errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def export_csv(df: DataFrame, path: str) -> None:
    write_new(df, path, "csv")


def run_record(spark: SparkSession, options: Mapping[str, str], inputs: DataFrame) -> DataFrame:
    """One row: options, engine version and the input fingerprint."""
    opts = F.create_map(*[F.lit(x) for pair in sorted(options.items()) for x in pair])
    return inputs.select(opts.alias("options"), F.lit(spark.version).alias("spark_version"), "*")
