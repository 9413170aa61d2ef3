"""Shared inputs of the registered queries, as DataFrames and as SQL text.

The registered queries derive cases, scores and groups from the given tables.
Every builder below has an SQL twin used by the oracle statements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

CATALOG: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODELS = ("disc", "price", "qty")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the SQL twins read the times as UTC
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 8, **special: int) -> DataFrame:
    """Round doubles and widen integers, so both engines print the same values."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), special.get(f.name, digits)) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal(20,0"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(expr: str, name: str, digits: int = 8) -> str:
    return f'round(({expr})::DOUBLE, {digits}) + 0.0 AS "{name}"'


# --- scored rows ---------------------------------------------------------------


def line_id():
    """Order and line number alone do not identify a line item in these tables."""
    cents = F.round(F.col("l_extendedprice") * 100.0).cast("long")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)


SQL_LINE_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100.0::DOUBLE)::BIGINT)"
)


def wide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, row_id, y and the three scores of a line item side by side."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("run_"), "l_linestatus").alias("run_id"),
        line_id().alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        ((F.col("l_discount") * 10.0 + F.col("l_quantity") / 1000.0) / 1.1).alias("disc"),
        (F.col("l_extendedprice") / (F.col("l_extendedprice") + 30000.0)).alias("price"),
        ((F.col("l_quantity") + F.col("l_tax") * 100.0) / 59.0).alias("qty"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, model, row_id, y, p: three deterministic scores per line item."""
    return wide_scores(spark, sf_dir).unpivot(["run_id", "row_id", "y"], list(MODELS), "model", "p")


SQL_SCORES = f"""wide AS (
  SELECT 'run_' || l_linestatus AS run_id, {SQL_LINE_ID} AS row_id,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         (l_discount * 10.0::DOUBLE + l_quantity / 1000.0::DOUBLE) / 1.1::DOUBLE AS disc,
         l_extendedprice / (l_extendedprice + 30000.0::DOUBLE) AS price,
         (l_quantity + l_tax * 100.0::DOUBLE) / 59.0::DOUBLE AS qty
  FROM lineitem),
scores AS (
  SELECT run_id, row_id, y, 'disc' AS model, disc AS p FROM wide
  UNION ALL SELECT run_id, row_id, y, 'price', price FROM wide
  UNION ALL SELECT run_id, row_id, y, 'qty', qty FROM wide)"""


# cumulative class counts per distinct score
SQL_CURVE = """counts AS (
  SELECT run_id, model, p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg
  FROM scores GROUP BY ALL),
curve AS (
  SELECT *, coalesce(sum(pos) OVER w, 0)::DOUBLE AS pos_before, coalesce(sum(neg) OVER w, 0)::DOUBLE AS neg_before,
         (sum(pos) OVER (PARTITION BY run_id, model))::DOUBLE AS pos_total,
         (sum(neg) OVER (PARTITION BY run_id, model))::DOUBLE AS neg_total
  FROM counts
  WINDOW w AS (PARTITION BY run_id, model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


# --- cases with dates ----------------------------------------------------------


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders seen as loans: origination, status, close date, first default cycle."""
    li = table(spark, sf_dir, "lineitem")
    closed = li.groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("closed"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("cycle"),
    )
    status = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("Cancelled"))
        .when(F.col("o_orderstatus") == "F", F.lit("Defaulted"))
        .when(F.col("o_orderstatus") == "O", F.lit("Completed"))
        .otherwise(F.lit("Current"))
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(closed, orders.o_orderkey == closed.l_orderkey, "left").select(
        F.col("o_orderkey").alias("row_id"),
        "o_custkey",
        F.col("o_orderdate").alias("orig"),
        status.alias("status"),
        "closed",
        F.when(F.col("o_totalprice") < 100000.0, F.col("cycle").cast("double")).alias("cycle"),
        "o_totalprice",
        "o_orderpriority",
    )


SQL_LOANS = """closing AS (
  SELECT l_orderkey, min(l_shipdate) AS closed,
         max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS cycle
  FROM lineitem GROUP BY l_orderkey),
loans AS (
  SELECT o_orderkey AS row_id, o_custkey, o_orderdate AS orig,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'Cancelled' WHEN o_orderstatus = 'F' THEN 'Defaulted'
              WHEN o_orderstatus = 'O' THEN 'Completed' ELSE 'Current' END AS status,
         closed, CASE WHEN o_totalprice < 100000 THEN cycle::DOUBLE END AS cycle, o_totalprice, o_orderpriority
  FROM orders LEFT JOIN closing ON o_orderkey = l_orderkey)"""

SQL_LABELS = """snap AS (SELECT greatest(max(orig), max(closed)) AS snapshot FROM loans),
timing AS (
  SELECT loans.*, snapshot,
         floor(date_diff('second', orig, snapshot) / 86400.0::DOUBLE) / 30.4375::DOUBLE AS observed,
         coalesce(cycle, floor(date_diff('second', orig, closed) / 86400.0::DOUBLE) / 30.4375::DOUBLE) AS to_default,
         status IN ('Defaulted', 'Chargedoff') AS is_default
  FROM loans, snap),
labelled AS (
  SELECT *, CASE
      WHEN is_default AND (to_default IS NULL OR to_default < 0) THEN -1
      WHEN is_default AND to_default <= 12 THEN 1
      WHEN status <> 'Cancelled' AND (status IN ('Completed', 'FinalPaymentInProgress') OR observed >= 12) THEN 0
      ELSE -1 END AS y
  FROM timing)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(p for p in parts) + "\n"
