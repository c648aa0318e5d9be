"""Filters on prepared points: quarantine, chromosome subsets, training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cpgdomains.schema import AUTOSOMES, POINT_KEYS, SUMMARY

#: Betas that counts of one to four reads give.
LOW_COVERAGE_LIKE = (0.0, 0.25, 0.33, 0.5, 0.66, 0.67, 0.75, 1.0)


def with_beta(counts: DataFrame) -> DataFrame:
    """Methylated reads over coverage; null without coverage."""
    return counts.withColumn("beta", F.try_divide(F.col("meth").cast("double"), F.col("coverage").cast("double")))


def removal_reason(min_coverage: float | None, low_coverage_like: tuple[float, ...] | None) -> Column:
    """Why a row goes, null if it stays: its coverage is below the least or unknown, or its beta looks like few reads."""
    out = F.lit(None).cast("string")
    if low_coverage_like is not None:
        out = F.when(F.col("beta").isin(*[float(v) for v in low_coverage_like]), "low_coverage_like_beta").otherwise(out)
    if min_coverage is not None:
        enough = (F.col("coverage") >= min_coverage) & ~F.isnan("coverage")
        out = F.when(~F.coalesce(enough, F.lit(False)), "low_coverage").otherwise(out)
    return out


def split_removed(rows: DataFrame, min_coverage: float | None = 10, low_coverage_like: tuple[float, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of one scan; removed rows carry ``removal_reason``. Works on streams too."""
    marked = rows.withColumn("removal_reason", removal_reason(min_coverage, low_coverage_like))
    return marked.where("removal_reason IS NULL").drop("removal_reason"), marked.where("removal_reason IS NOT NULL")


def validate(points: DataFrame) -> None:
    """Raises unless the required columns exist, beta is a number, and no beta is outside 0 to 1. One aggregate; NaN and null pass."""
    kinds = dict(points.dtypes)
    if missing := [c for c in ("CpG_chrm", "CpG_beg", "CpG_end", "beta") if c not in kinds]:
        raise ValueError(f"missing columns: {missing}")
    if kinds["beta"] not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not kinds["beta"].startswith("decimal"):
        raise ValueError("beta must be numeric")
    bad = points.agg(F.count_if((F.col("beta") < 0) | ((F.col("beta") > 1) & ~F.isnan(F.col("beta").cast("double"))))).first()[0]
    if bad:
        raise ValueError(f"{bad} betas lie outside 0 to 1")


def chromosomes(points: DataFrame) -> list[str]:
    """In first-appearance order."""
    return [r[0] for r in points.groupBy("CpG_chrm").agg(F.min("input_row_index").alias("i")).orderBy("i").collect()]


def subset(points: DataFrame, chroms: list[str] | None = None) -> DataFrame:
    """Points of the chromosomes, with ``chrom_ord`` as requested (or by first appearance); a missing chromosome is an error."""
    present = chromosomes(points)
    wanted = list(dict.fromkeys(present if chroms is None else chroms))
    if absent := [c for c in wanted if c not in present]:
        raise ValueError(f"chromosomes not found: {absent}")
    ordinal = F.array_position(F.array(*[F.lit(c) for c in wanted]), F.col("CpG_chrm")).cast("int") - 1
    return points.where(F.col("CpG_chrm").isin(wanted)).withColumn("chrom_ord", ordinal)


def training_chromosomes(points: DataFrame, chroms: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(to train on, requested but missing); autosomes present by default. An error if none is left."""
    present = set(chromosomes(points))
    wanted = list(dict.fromkeys(AUTOSOMES if chroms is None else chroms))
    found = [c for c in wanted if c in present]
    if not found:
        raise ValueError("no training chromosome is present")
    return found, [] if chroms is None else [c for c in wanted if c not in present]


def training_sample(points: DataFrame, chroms: list[str], most: int | None = 50_000, seed: int = 42) -> DataFrame:
    """At most ``most`` points of each sample's chromosomes, without replacement, by a hash of the place: a sampling operator.

    Counts by leading digits of the hash say which ones the sample needs; only those points are ranked.
    """
    if most is not None and most <= 0:
        raise ValueError("most must be positive")
    rows = points.where(F.col("CpG_chrm").isin(chroms))
    if most is None:
        return rows
    by = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("CpG_beg").cast("string"), F.col("input_row_index").cast("string")))
    marked = rows.withColumn("_by", by).withColumn("_lead", F.substring("_by", 1, 4))
    before = F.sum("n").over(Window.partitionBy(*POINT_KEYS).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1))
    counted = marked.groupBy(*POINT_KEYS, "_lead").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    # a row per sample and chromosome
    least = counted.where(F.col("before") < most).groupBy(*POINT_KEYS).agg(F.max("_lead").alias("_last")).withColumnsRenamed({c: f"_{c}" for c in POINT_KEYS})
    here = F.col("_lead") <= F.col("_last")
    for c in POINT_KEYS:
        here = here & F.col(c).eqNullSafe(F.col(f"_{c}"))
    w = Window.partitionBy(*POINT_KEYS).orderBy("_by", "CpG_beg", "input_row_index")
    return marked.join(F.broadcast(least), here).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).select(*rows.columns)


def training_summary(points: DataFrame, chroms: list[str], missing: list[str] = (), most: int | None = 50_000) -> DataFrame:
    """One row per chromosome asked for: how many points there are and how many the sample takes."""
    spark: SparkSession = points.sparkSession
    n = F.col("n_cpg_total")
    took = n if most is None else F.least(n, F.lit(most).cast("long"))
    counted = points.where(F.col("CpG_chrm").isin(chroms)).groupBy(F.col("CpG_chrm").alias("chrom")).agg(F.count(F.lit(1)).alias("n_cpg_total"))
    rows = counted.select("chrom", F.lit(True).alias("available"), F.lit(True).alias("selected_for_training"), "n_cpg_total", took.alias("n_cpg_sampled"), (took < n).alias("sampled"), (took / n).alias("sampling_fraction"))
    return rows.unionByName(spark.createDataFrame([(c, False, False, 0, 0, False, 0.0) for c in missing], SUMMARY))
