"""Points and read counts derived from the ``events`` table of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POINTS = """
WITH b AS (
  SELECT event_id, concat('chr', cast(user_id % 3 + 1 AS {text})) AS CpG_chrm, cast({seconds} AS bigint) AS CpG_beg,
         cast(round(value * 1e2) AS bigint) % 1000 AS k
  FROM {events})
SELECT 's1' AS sample_id, CpG_chrm, CpG_beg, CpG_beg + 2 AS CpG_end,
       CASE cast(floor(CpG_beg / 2e5) AS bigint) % 4
            WHEN 0 THEN 1e0 - k * 3e-4 WHEN 1 THEN 3e-1 + k * 4e-4 WHEN 2 THEN k * 2e-4
            ELSE CASE WHEN event_id % 2 = 0 THEN 9e-1 ELSE 25e-2 END END AS beta,
       event_id AS input_row_index
FROM b
"""
SQL_POINTS = _POINTS.format(text="varchar", seconds="floor(epoch(ts)) - 1704067200", events="events")
SQL_COUNTS = f"SELECT *, 5 + input_row_index % 30 AS coverage, cast(floor(beta * (5 + input_row_index % 30) + 5e-1) AS bigint) AS meth FROM ({SQL_POINTS})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, CpG_chrm, CpG_beg, CpG_end, beta, input_row_index."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    seconds = "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
    return spark.sql(_POINTS.format(text="string", seconds=seconds, events="{events}"), events=events)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read counts: coverage and methylated reads in place of betas."""
    rows = spark.sql("SELECT *, 5 + input_row_index % 30 AS coverage, cast(floor(beta * (5 + input_row_index % 30) + 5e-1) AS bigint) AS meth FROM {p}", p=points(spark, sf_dir))
    return rows.drop("beta")
