"""Measurement tables: beta values or read counts, tab separated, with or without a header, plain or gzipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cpgdomains.operators.prepare import LOW_COVERAGE_LIKE, split_removed, validate, with_beta
from cpgdomains.schema import Resolution

#: Header names by column, lower case.
ALIASES = {
    "CpG_chrm": ("cpg_chrm", "chrom", "chr", "chromosome"),
    "CpG_beg": ("cpg_beg", "start", "pos", "position"),
    "CpG_end": ("cpg_end", "end", "stop"),
    "beta": ("beta", "meth_beta", "methylation", "meth_percent"),
    "meth": ("meth", "methylated", "methylated_reads"),
    "coverage": ("coverage", "cov", "depth", "total_reads"),
    "probe": ("probe", "probe_id", "cpg", "cpg_id"),
}
_PLACE = ("CpG_chrm", "CpG_beg", "CpG_end")
LAYOUTS = {"beta": (*_PLACE, "beta"), "probe": (*_PLACE, "beta", "probe"), "counts": (*_PLACE, "meth", "coverage")}
_TYPES = {"CpG_chrm": "string", "CpG_beg": "long", "CpG_end": "long", "probe": "string"}


def header_layout(values: list[str]) -> str | None:
    """The layout whose header a row's first values are, or None."""
    seen = [str(v).strip().lower() for v in values]
    fits = lambda names: len(seen) >= len(names) and all(s in ALIASES[n] for s, n in zip(seen, names, strict=False))
    return next((k for k in ("counts", "probe", "beta") if fits(LAYOUTS[k])), None)


def is_header(layout: str) -> Column:
    """True for a header line of ``layout``; such a line can be told from data without knowing its place."""
    out = F.lit(True)
    for i, name in enumerate(LAYOUTS[layout]):
        out = out & F.lower(F.trim(F.col(f"_c{i}"))).isin(*ALIASES[name])
    return out


@dataclass(frozen=True)
class Prepared:
    """A sample: kept points, removed rows, and the resolution that later defaults go by."""

    sample_id: str
    points: DataFrame
    removed: DataFrame
    resolution: str


def _fields(spark: SparkSession, path: str) -> list[str]:
    """The first line's values, of several files that of any."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    return first[0][0].split("\t")


def _looks_like_counts(spark: SparkSession, path: str) -> bool:
    """Without a header, five columns are counts if over nine in ten fifth values of the whole file are numbers: one aggregate."""
    fifth = F.split("value", "\t")[4]
    return (spark.read.text(path).agg(F.avg(fifth.try_cast("double").isNotNull().cast("double"))).first()[0] or 0) > 0.9


def layout_of(spark: SparkSession, path: str, resolution: str) -> str:
    """Which columns a file has, by its first line, or by all fifth values; microarray files have 4 or 5, count files 5 or more (4: betas)."""
    values = _fields(spark, path)
    n, named = len(values), header_layout(values)
    if n < 4:
        raise ValueError(f"{path} has {n} columns; 4 are needed")
    kind = Resolution(resolution)
    if kind == Resolution.WGBS:
        return "beta" if n == 4 else "counts"
    if kind == Resolution.AUTO:
        if named:
            return named
        return "beta" if n == 4 else "counts" if _looks_like_counts(spark, path) else "probe"
    if n > 5:
        raise ValueError(f"{path} has {n} columns; microarray files have 4 or 5")
    return "beta" if n == 4 else "probe"


def read_table(spark: SparkSession, path: str, layout: str, sample_id: str) -> DataFrame:
    """Typed rows with ``input_row_index``: unique and ascending in the order of a file, data rows only. A folder's files follow each
    other by name; ``_file`` and ``_start`` say which piece of which file a row is of.

    Values that aren't numbers raise (ANSI casts).
    """
    names = LAYOUTS[layout]
    raw = spark.read.csv(path, sep="\t", schema=", ".join(f"_c{i} string" for i in range(len(names))), enforceSchema=True)
    piece = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = raw.select("*", *piece, F.monotonically_increasing_id().alias("input_row_index")).where(~F.coalesce(is_header(layout), F.lit(False)))
    typed = [F.trim(f"_c{i}").cast(_TYPES.get(n, "double")).alias(n) for i, n in enumerate(names)]
    return rows.select(F.lit(sample_id).alias("sample_id"), *typed, "input_row_index", *_PIECE)


_PIECE = ("_file", "_start")


def dense_index(df: DataFrame) -> DataFrame:
    """``input_row_index`` as 0, 1, 2... in order of files' names and of the lines in each, header lines not counted.

    Numbers count up within a piece of a file, whichever partitions hold the pieces, so a row's place is its number less its piece's
    first one, plus the rows of the pieces before: one row per piece on the driver, no shuffle. Only a header line, the first of
    a piece, leaves no gap.
    """
    found = sorted(tuple(r) for r in df.groupBy(*_PIECE).agg(F.count(F.lit(1)), F.min("input_row_index"), F.max("input_row_index")).collect())
    gaps = any(last - first + 1 != n for *_, n, first, last in found)  # lines left out in between: rank instead
    table, so_far = [], 0
    for file, start, n, first, _ in found:
        table.append((file, start, so_far - (0 if gaps else first)))
        so_far += n
    shift = df.sparkSession.createDataFrame(table, "_file string, _start long, shift long")
    number = F.row_number().over(Window.partitionBy(*_PIECE).orderBy("input_row_index")) - 1 if gaps else F.col("input_row_index")
    return df.withColumn("input_row_index", number).join(F.broadcast(shift), list(_PIECE)).withColumn("input_row_index", F.col("input_row_index") + F.col("shift")).drop("shift", *_PIECE)


def prepare_sample(
    spark: SparkSession, path: str, sample_id: str, resolution: str = "auto", min_coverage: float = 10, remove_low_coverage_like: bool = False,
    low_coverage_like: tuple[float, ...] | None = None, retain_removed: bool = True, check: bool = True,
) -> Prepared:
    """Read, filter and validate one sample. Kept points have the canonical columns; removed rows keep all, with a reason."""
    layout = layout_of(spark, path, resolution)
    rows = dense_index(read_table(spark, path, layout, sample_id))
    if layout == "counts":
        rows = with_beta(rows)
    values = (tuple(low_coverage_like) if low_coverage_like is not None else LOW_COVERAGE_LIKE) if remove_low_coverage_like else None
    kept, removed = split_removed(rows, min_coverage if layout == "counts" else None, values)
    points = kept.select("sample_id", *_PLACE, "beta", "input_row_index")
    if check:
        validate(points)
    kind = Resolution(resolution)
    known = kind if kind != Resolution.AUTO else Resolution.WGBS if layout == "counts" else Resolution.K450
    return Prepared(sample_id, points, removed if retain_removed else removed.limit(0), known.value)


def normalise_columns(df: DataFrame) -> DataFrame:
    """Canonical names for a DataFrame whose columns have any alias, or none: then by place."""
    renamed = {}
    for c in df.columns:
        for name, known in ALIASES.items():
            if c.strip().lower() in known:
                renamed[c] = name
    out = df.withColumnsRenamed(renamed)
    if not set(_PLACE) <= set(out.columns):
        if len(df.columns) < 4:
            raise ValueError("4 columns are needed")
        fifth = len(df.columns) >= 5 and (df.agg(F.avg(F.col(df.columns[4]).cast("string").try_cast("double").isNotNull().cast("double"))).first()[0] or 0) > 0.9
        names = LAYOUTS["counts" if fifth else "probe" if len(df.columns) >= 5 else "beta"]
        out = df.toDF(*names, *df.columns[len(names) :])
    return with_beta(out) if "beta" not in out.columns and {"meth", "coverage"} <= set(out.columns) else out


def finalise(df: DataFrame, remove_low_coverage_like: bool = False) -> DataFrame:
    """Canonical columns with canonical types, rows with betas of few reads left out if asked."""
    typed = df.select(F.col("CpG_chrm").cast("string").alias("CpG_chrm"), *(F.col(c).cast("long").alias(c) for c in ("CpG_beg", "CpG_end")), F.col("beta").cast("double").alias("beta"))
    return split_removed(typed, None, LOW_COVERAGE_LIKE)[0] if remove_low_coverage_like else typed
