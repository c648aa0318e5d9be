"""Preparation of measurement rows as they arrive.

Filters are stateless, so one plan serves batches and streams; a micro-batch is read once and written to both sides.
Window features look ahead in position and stay with batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cpgdomains.operators.prepare import split_removed, with_beta

COUNTS = "sample_id string, CpG_chrm string, CpG_beg long, CpG_end long, meth double, coverage double"


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Count tables that appear in a folder, tab separated, without headers."""
    return with_beta(spark.readStream.schema(COUNTS).option("sep", "\t").csv(folder))


def write_split(rows: DataFrame, kept: str, removed: str, checkpoint: str, min_coverage: float = 10, low_coverage_like: tuple[float, ...] | None = None, **trigger) -> StreamingQuery:
    """Kept and removed rows as Parquet; each micro-batch replaces its own folder, so a repeated one writes nothing twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        for part, path in zip(split_removed(batch, min_coverage, low_coverage_like), (kept, removed), strict=True):
            part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def coverage_by_chromosome(rows: DataFrame) -> DataFrame:
    """Running counts per sample and chromosome, for complete or update output."""
    return rows.groupBy("sample_id", "CpG_chrm").agg(F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("mean_coverage"))
