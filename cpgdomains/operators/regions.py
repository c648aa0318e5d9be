"""Points to islands, and islands to cleaned regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cpgdomains.schema import POINT_KEYS, STATES, State

#: Base pairs of a stretch within which islands are found before they are joined to whole ones.
STRETCH = 1_000_000


def raw_regions(points: DataFrame, state: str = "state", min_probes: int = 1, stretch: int = STRETCH) -> DataFrame:
    """Islands of equal state in the order (CpG_beg, input_row_index) of each sample and chromosome.

    Start is the first point's begin, end the last point's end. Islands of fewer than ``min_probes`` points go, and their
    neighbours aren't joined. Islands form within stretches of a chromosome, in parallel, and join where they meet.
    """
    order = ["CpG_beg", "input_row_index"]
    piece = [*POINT_KEYS, "stretch"]
    rows = points.select(*POINT_KEYS, *order, "CpG_end", "beta", F.col(state).alias("state"), F.floor(F.col("CpG_beg") / stretch).alias("stretch"))
    w = Window.partitionBy(*piece).orderBy(*order)
    new = (~F.col("state").eqNullSafe(F.lag("state").over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    parts = rows.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    parts = parts.groupBy(*piece, "island").agg(
        F.first("state").alias("state"), F.min("CpG_beg").alias("start"), F.max_by("CpG_end", at).alias("end"), F.min(at).alias("first"),
        F.sum("beta").alias("s"), F.count("beta").alias("known"), F.count(F.lit(1)).alias("n"),
    )
    w = Window.partitionBy(*POINT_KEYS).orderBy("first")
    new = (~F.col("state").eqNullSafe(F.lag("state").over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    parts = parts.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy(*POINT_KEYS, "run").agg(
        F.min("start").alias("start"), F.max_by("end", "first").alias("end"), (F.sum("s") / F.sum("known")).alias("avg_beta"), F.sum("n").alias("probe_count"), F.first("state").alias("state")
    )
    return whole.where(F.col("probe_count") >= min_probes).drop("run")


def _joined() -> list:
    """One region of several: extent, beta weighted by points, counts."""
    weighted = F.sum(F.col("avg_beta") * F.col("probe_count")) / F.sum("probe_count")
    return [F.min("start").alias("start"), F.max("end").alias("end"), weighted.alias("avg_beta"), *(F.sum(c).alias(c) for c in ("probe_count", "n_segments", "n_state", "n_intermediate"))]


def _tracks(regions: DataFrame, states: list[str], with_intermediate: bool, gap: int) -> DataFrame:
    """Regions of each of the states, INTERMEDIATE ones absorbed if asked, in one plan: every region goes to the tracks of all states
    that it may lengthen or interrupt, and all tracks of a chromosome are cut into blocks at once."""
    if gap < 0:
        raise ValueError("gap must not be negative")
    state, middle = F.col("state"), F.lit("INTERMEDIATE")
    joins = [s for s in states if with_intermediate and s != "INTERMEDIATE"]
    alone = F.when(state.isin([s for s in states if s not in joins]), F.array(state)).otherwise(F.array().cast("array<string>"))
    rows = regions.withColumn("track", F.explode(F.concat(F.array(*[F.lit(s) for s in joins]).cast("array<string>"), alone)))
    rows = rows.withColumns({"n_segments": F.lit(1).cast("long"), "n_state": (state == F.col("track")).cast("long"), "n_intermediate": (state == middle).cast("long"), "inside": state.isin(F.col("track"), middle)})
    w = Window.partitionBy(*POINT_KEYS, "track").orderBy("start", "end", "state")
    before = F.lag("state").over(w)
    apart = before.isNull() | ~before.isin(F.col("track"), middle) | ~F.col("inside") | (F.col("start") - F.lag("end").over(w) > gap) | ~F.col("track").isin(joins)
    blocks = rows.withColumn("b", apart.cast("int")).withColumn("block", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("inside")
    out = blocks.groupBy(*POINT_KEYS, "track", "block").agg(*_joined())
    return out.where("n_state > 0").drop("block").withColumnRenamed("track", "state")


def absorb_intermediate(regions: DataFrame, state: str, gap: int = 100_000) -> DataFrame:
    """Runs of ``state`` and INTERMEDIATE rows in (start, end) order, cut where another state or a gap of more than ``gap`` lies.

    A run without a row of ``state`` gives nothing. The gap is measured from the row before.
    """
    return _tracks(regions, [state], True, gap)


def merge_within_gap(regions: DataFrame, gap: int = 100_000) -> DataFrame:
    """Regions of one state, joined while the next starts at most ``gap`` after the furthest end so far."""
    if gap < 0:
        raise ValueError("gap must not be negative")
    w = Window.partitionBy(*POINT_KEYS, "state").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = regions.withColumn("b", (far.isNull() | (F.col("start") - far > gap)).cast("int")).withColumn("block", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*POINT_KEYS, "state", "block").agg(*_joined()).drop("block")


def _clean(regions: DataFrame, states: list[str], merge_gap: int = 100_000, with_intermediate: bool = True, intermediate_gap: int = 100_000, min_length: int = 5000, min_probes: int = 6) -> DataFrame:
    merged = merge_within_gap(_tracks(regions, states, with_intermediate, intermediate_gap), merge_gap).withColumn("length", F.col("end") - F.col("start"))
    kept = merged.where((F.col("length") >= min_length) & (F.col("probe_count") >= min_probes))
    pmd = lambda c: F.when(F.col("state") == "PMD", c)
    return kept.select(
        *POINT_KEYS, "start", "end", "avg_beta", "probe_count", "state", "length", pmd(F.col("n_intermediate") > 0).alias("contains_intermediate"),
        "n_segments", pmd(F.col("n_state")).alias("n_pmd_segments"), pmd(F.col("n_intermediate")).alias("n_intermediate_segments"),
    )


def clean_regions(regions: DataFrame, state: str, **options) -> DataFrame:
    """Cleaned regions of one state: INTERMEDIATE absorbed (not for that state itself), near ones merged, short or sparse ones dropped.

    Options: merge_gap, with_intermediate, intermediate_gap, min_length, min_probes. Tracks of different states may overlap, as one
    INTERMEDIATE run can join two neighbours. The three columns that only PMD has are null for other states.
    """
    return _clean(regions, [state], **options)


def clean_all(regions: DataFrame, **options) -> DataFrame:
    """All four cleaned tracks, in one plan that reads the regions once."""
    return _clean(regions, STATES, **options)


def longer_than(regions: DataFrame, length: int) -> DataFrame:
    """Strictly longer regions."""
    return regions.where(F.col("end") - F.col("start") > length)


def of_state(regions: DataFrame, state: State | str | int) -> DataFrame:
    from cpgdomains.functions.states import state_name

    return regions.where(F.col("state") == state_name(F.lit(str(int(state)) if isinstance(state, int) else state)))
