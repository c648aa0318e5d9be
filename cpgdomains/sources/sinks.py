"""Writers: tables, BED and metadata files with exact names.

``write_*`` of whole tables are distributed. Files of one name each hold the regions of one sample and state; a run's regions are
sorted once and streamed once through Hadoop's file system into all the files they belong to, so that any store that Spark knows
takes them and the number of jobs doesn't follow the number of files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cpgdomains.schema import STATES
from cpgdomains.sources.shared import Files

#: Columns of the files, in order.
BED = ["CpG_chrm", "start", "end", "state"]
METADATA = ["CpG_chrm", "start", "end", "avg_beta", "probe_count", "state", "length", "n_segments"]
PMD_METADATA = [*METADATA, "contains_intermediate", "n_pmd_segments", "n_intermediate_segments"]


def metadata_columns(state: str) -> list[str]:
    """A state's metadata columns: the same for every table of that state, empty ones too."""
    return PMD_METADATA if state == "PMD" else METADATA


def write_points(points: DataFrame, path: str) -> None:
    """Prepared table, tab separated with a header."""
    points.select("CpG_chrm", "CpG_beg", "CpG_end", "beta").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_points_table(points: DataFrame, path: str) -> None:
    """Parquet by sample and chromosome, so that later runs read only what they need."""
    points.write.mode("overwrite").partitionBy("sample_id", "CpG_chrm").parquet(path)


def _text(df: DataFrame) -> list[Column]:
    """Every column as file text: null is empty, booleans are True and False."""
    plain = lambda c, t: F.initcap(F.col(c).cast("string")) if t == "boolean" else F.col(c).cast("string")
    return [F.coalesce(plain(c, t), F.lit("")).alias(c) for c, t in df.dtypes]


def write_file(df: DataFrame, path: str, header: bool = False, sep: str = "\t") -> str:
    """One separated file of exactly this name, rows in the frame's order; an empty frame an empty file."""
    with Files(df.sparkSession) as files:
        files.put(path, *([sep.join(df.columns)] if header else []))
        for row in df.select(*_text(df)).toLocalIterator():
            files.put(path, sep.join(row))
    return path


def in_order(regions: DataFrame) -> DataFrame:
    return regions.orderBy("CpG_chrm", "start", "end", "state")


def write_table(df: DataFrame, folder: str, order: list[str], header: bool = False, sep: str = "\t") -> str:
    """A separated table of any size as a folder of files that executors write: in order of ``order`` from file to file, by name, and within each."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    rows.select(*_text(rows)).write.csv(folder, sep=sep, header=header, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return folder


def write_bed(regions: DataFrame, path: str) -> str:
    """chrom, start, end, state without a header."""
    return write_file(in_order(regions).select(*BED), path)


def write_state_beds(regions: DataFrame, folder: str, stem: str, states: list[str] = STATES) -> list[str]:
    """One BED per state, in state order."""
    paths = {s: f"{folder}/{stem}_{s}.bed" for s in states}
    rows = in_order(regions.where(F.col("state").isin(states)))
    _spread(rows, list(paths.values()), lambda r: [(paths[r["state"]], _line(r, BED))])
    return list(paths.values())


def _line(row: Row, columns: list[str]) -> str:
    return "\t".join(row[c] for c in columns)


def _spread(rows: DataFrame, paths: list[str], lines: Callable[[Row], Iterator[tuple[str, str]] | list[tuple[str, str]]], heads: dict[str, str] | None = None) -> None:
    """Stream ordered rows once; ``lines`` says what each adds to which file. All ``paths`` are made, with their ``heads``."""
    with Files(rows.sparkSession) as files:
        for path in paths:
            files.put(path, *([heads[path]] if heads and path in heads else []))
        for row in rows.select(*_text(rows)).toLocalIterator():
            for path, line in lines(row):
                files.put(path, line)


def _ordinal(column: str, values: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))


def write_raw(raw: DataFrame, folder: str, sample: str, chroms: list[str], longer_than: int | None = None) -> list[str]:
    """Raw regions of one sample: segments_<chrom>_<sample>_<STATE>.bed of each of ``chroms``, also without regions, and
    summary_files/segments_raw_<STATE>.bed, chromosomes in the order of ``chroms``; the summaries' paths.

    ``longer_than``: only longer regions go into the summaries; the files by chromosome hold all.
    """
    own = {(c, s): f"{folder}/segments_{c}_{sample}_{s}.bed" for c in chroms for s in STATES}
    whole = {s: f"{folder}/summary_files/segments_raw_{s}.bed" for s in STATES}
    listed = raw.where(F.col("CpG_chrm").isin(chroms) & F.col("state").isin(STATES))
    rows = listed.orderBy(_ordinal("state", STATES), _ordinal("CpG_chrm", chroms), "start", "end").select(*BED)

    def lines(r: Row) -> Iterator[tuple[str, str]]:
        line = _line(r, BED)
        yield own[r["CpG_chrm"], r["state"]], line
        if longer_than is None or int(r["end"]) - int(r["start"]) > longer_than:
            yield whole[r["state"]], line

    _spread(rows, [*own.values(), *whole.values()], lines)
    return list(whole.values())


def write_clean(clean: DataFrame, folder: str, sample: str, chroms: list[str]) -> list[str]:
    """Cleaned regions of one sample: BED and metadata by chromosome and state below clean_regions/, and by state below
    summary_files/, chromosomes in the order of their names; the summaries' BED paths."""
    top = f"{folder}/clean_regions"
    own = {(c, s): (f"{top}/segments_cleaned_{c}_{sample}_{s}.bed", f"{top}/metadata_cleaned_{c}_{sample}_{s}.tsv") for c in chroms for s in STATES}
    whole = {s: (f"{folder}/summary_files/segments_cleaned_{s}.bed", f"{folder}/summary_files/metadata_cleaned_{s}.tsv") for s in STATES}
    rows = clean.where(F.col("CpG_chrm").isin(chroms) & F.col("state").isin(STATES)).orderBy(_ordinal("state", STATES), "CpG_chrm", "start", "end").select(*PMD_METADATA)

    def lines(r: Row) -> Iterator[tuple[str, str]]:
        for bed, table in (own[r["CpG_chrm"], r["state"]], whole[r["state"]]):
            yield bed, _line(r, BED)
            yield table, _line(r, metadata_columns(r["state"]))

    heads = {table: "\t".join(metadata_columns(s)) for (_, s), (_, table) in own.items()} | {table: "\t".join(metadata_columns(s)) for s, (_, table) in whole.items()}
    _spread(rows, [p for both in (*own.values(), *whole.values()) for p in both], lines, heads)
    return [bed for bed, _ in whole.values()]


def read_clean(spark: SparkSession, folder: str, state: str, chrom: str | None = None, sample: str | None = None) -> DataFrame:
    """A metadata table read back, of a summary or of one chromosome and sample; an error if it isn't there."""
    path = f"{folder}/summary_files/metadata_cleaned_{state}.tsv" if chrom is None else f"{folder}/clean_regions/metadata_cleaned_{chrom}_{sample}_{state}.tsv"
    kinds = {"CpG_chrm": "string", "state": "string", "avg_beta": "double", "contains_intermediate": "boolean"}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in metadata_columns(state))
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False)


def write_search_history(history: DataFrame, path: str) -> str:
    """Scores and cutoffs of every trial of a rule search, best first."""
    return write_file(history.orderBy(F.desc("f1_macro"), "trial"), path, header=True)


def write_search_summary(best: DataFrame, path: str) -> str:
    """Cutoffs and scores of the best trial, comma separated."""
    return write_file(best, path, header=True, sep=",")


def read_points(spark: SparkSession, path: str, sample_id: str) -> DataFrame:
    """A prepared table read back, as ``write_points`` writes it, with a row number that is unique and ascends with file order."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="CpG_chrm string, CpG_beg long, CpG_end long, beta double", enforceSchema=False)
    return rows.select(F.lit(sample_id).alias("sample_id"), "*", F.monotonically_increasing_id().alias("input_row_index"))
