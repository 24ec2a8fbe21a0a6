"""Tables and small helpers that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(df: DataFrame, rows: int = 250_000) -> int:
    """Partitions to deal a table's rows over, so that a task's memory does not grow with the
    table. Of a table as it is read, its files know the count."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def millis(c: str) -> Column:
    """Milliseconds of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")


def block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as blocks of one to twelve hours on their user's timeline."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", millis("ts").alias("s"))
    return ev.withColumn("e", F.col("s") + (F.col("event_id") % 12 + 1) * HOUR)


#: SQL of the same
EV = (
    "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS s,"
    f" epoch_us(ts) // 1000 + (event_id % 12 + 1) * {HOUR} AS e FROM events)"
)
EFF = (
    EV + ", eff AS (SELECT *, least(e, coalesce(lead(s) OVER w, 9223372036854775807)) AS eff_end,"
    " coalesce(lag(value) OVER w, value) AS prev_gain, row_number() OVER w AS rn"
    " FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))"
)
