"""Reading delimited, whitespace-separated and saved result files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.session import materialised, opened_store

DIGESTS = pa.schema([("path", pa.string()), ("file", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])

# Column names of the whitespace-separated credit file, by position
SOUTH_GERMAN_COLUMNS = [
    "status", "duration", "credit_history", "purpose", "amount", "savings",
    "employment_duration", "installment_rate", "personal_status_sex",
    "other_debtors", "present_residence", "property", "age",
    "other_installment_plans", "housing", "number_credits", "job",
    "people_liable", "telephone", "foreign_worker", "credit_risk",
]


def card_default_schema() -> T.StructType:
    """Explicit schema of the card-default table (statuses skip PAY_1)."""
    fields = [("ID", T.LongType()), ("LIMIT_BAL", T.DoubleType())]
    fields += [(c, T.IntegerType()) for c in ("SEX", "EDUCATION", "MARRIAGE", "AGE")]
    fields += [(f"PAY_{i}", T.IntegerType()) for i in (0, 2, 3, 4, 5, 6)]
    fields += [(f"BILL_AMT{i}", T.DoubleType()) for i in range(1, 7)]
    fields += [(f"PAY_AMT{i}", T.DoubleType()) for i in range(1, 7)]
    fields += [("default payment next month", T.IntegerType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large inputs; without one all columns are text."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def split_whitespace(lines: DataFrame, names: Sequence[str], column: str = "value") -> DataFrame:
    """Typed columns by position; a line of another width stops the job."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    checked = F.when(F.size(parts) == len(names), parts).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {len(names)} columns, found "), F.size(parts).cast("string")))
    )
    return lines.select(checked.alias("_p")).select(
        *[F.col("_p")[i].cast("double").alias(n) for i, n in enumerate(names)]
    )


def read_whitespace(spark: SparkSession, path: str, names: Sequence[str] = SOUTH_GERMAN_COLUMNS) -> DataFrame:
    """Whitespace-separated files whose header lines (the first of each file) are replaced by ``names``."""
    lines = with_file_order(spark.read.text(path), "_at")
    # ids rise within a file's first block, so its least one is the file's first line: one row per file
    heads = lines.where(F.col("_at.start") == 0).groupBy("_at.file").agg(F.min("_at.row").alias("_head"))
    placed = lines.withColumn("file", F.col("_at.file")).join(heads, "file", "left")
    head = F.coalesce((F.col("_at.start") == 0) & (F.col("_at.row") == F.col("_head")), F.lit(False))
    # the header becomes NULL here, so no later filter on the numbers can reach its text
    body = placed.select(F.when(~head, F.col("value")).alias("value")).where(F.trim("value") != "")
    return split_whitespace(body, names)


def percent_to_number(text: Column) -> Column:
    return F.regexp_replace(text, "%$", "").cast("double")


def clean_club_sample(
    df: DataFrame,
    percent: Sequence[str] = ("int_rate", "revol_util"),
    drop: Sequence[str] = ("loan_csv_row", "issue_date", "issue_d", "loan_status", "issue_time"),
) -> DataFrame:
    """Strip percent signs, drop ids and dates, keep complete rows only."""
    text = {n for n, t in df.dtypes if t == "string"}
    fixed = {c: percent_to_number(F.col(c)) for c in percent if c in text}
    out = df.withColumns(fixed) if fixed else df
    return out.drop(*drop).na.drop()


def with_file_order(df: DataFrame, name: str = "_ordinal") -> DataFrame:
    """An ordering column that follows the order of rows in the input files.

    Rows of one split get rising ids, splits are ordered by their offset.
    """
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(name),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key in ``order``: an aggregate, so hot keys combine early."""
    payload = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*payload), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


#: Bytes of a file that are held at once.
PIECE = 8 << 20


def file_checksums(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 and size per file, of any size: each file is one running digest over pieces of 8 MB.

    Spark lists the files; a digest is sequential, so a file is one task. Where Arrow does not know the store's
    scheme the content comes through Spark's reader, which holds a whole file (up to 2 GB).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                try:
                    store, place = opened_store(uri)
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
                    yield pa.RecordBatch.from_pylist([{"path": uri, "file": None, "bytes": None, "sha256": None}], DIGESTS)
                    continue
                digest, size = hashlib.sha256(), 0
                with store.open_input_stream(place, buffer_size=0) as stream:
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                yield pa.RecordBatch.from_pylist([{"path": uri, "file": unquote(uri.rsplit("/", 1)[-1]), "bytes": size, "sha256": digest.hexdigest()}], DIGESTS)

    names = files.inputFiles()  # with empty files, which a scan leaves out
    listed = spark.createDataFrame([(n,) for n in names], "path string")
    spread = listed.repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)), "path")
    found = materialised(spread.mapInArrow(digests, "path string, file string, bytes long, sha256 string"))
    known = found.where(F.col("sha256").isNotNull()).select("file", "bytes", "sha256")
    others = [r["path"] for r in found.where(F.col("sha256").isNull()).select("path").collect()]
    if not others:
        return known
    whole = spark.read.format("binaryFile").load(others)
    own = F.element_at(F.split("path", "/"), -1).alias("file")
    return known.unionByName(whole.select(own, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))


def fingerprint(df: DataFrame, method: str = "xxhash64") -> DataFrame:
    """Order-independent staleness key of a table: rows, two hash sums and the schema.

    Exact 128-bit-safe sums: hashes are added as decimals. ``md5`` (15 hex digits of the row's text, nulls as
    an empty field) is slower, takes simple columns only and can be repeated by any SQL engine.
    """
    if method == "md5":
        text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
        h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    else:
        h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    ).withColumn("schema", F.lit(df.schema.simpleString()))


def read_saved_runs(spark: SparkSession, pattern: str, fmt: str = "json", schema=None) -> DataFrame:
    """Saved per-run files by glob; ``run_id`` is the folder above ``results``."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if fmt == "json":
        reader = reader.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(pattern)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/results/[^/]+$", 1)
    return df.select(run.alias("run_id"), *[F.col(f"`{c}`") for c in df.columns if c != "run_id"])
