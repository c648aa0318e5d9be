"""Points against regions, and tables for plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgdomains.functions.states import state_colour, state_name

#: Base pairs of the cells by which points meet regions.
CELL = 1_000_000


def flattened(regions: DataFrame, cell: int = CELL) -> DataFrame:
    """Stretches without overlaps: sample_id, CpG_chrm, start, end, label of the last region in (start, end, state) order that covers them.

    Regions are cut at all their bounds; those that cover a stretch are found on (sample, chromosome, cell). As few rows as regions
    have bounds, where they don't overlap much.
    """
    keys = ["sample_id", "CpG_chrm"]
    r = regions.where(F.col("end") > F.col("start")).select(*keys, "start", "end", state_name("state").alias("label"), F.struct("start", "end", "state").alias("ord"))
    bounds = r.select(*keys, F.explode(F.array("start", "end")).alias("at")).distinct()
    cuts = bounds.withColumn("to", F.lead("at").over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("to").isNotNull())
    cuts = cuts.withColumn("cell", F.floor(F.col("at") / cell))
    r = r.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
    over = cuts.join(r, [*keys, "cell"]).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    return over.groupBy(*keys, F.col("at").alias("start"), F.col("to").alias("end")).agg(F.max_by("label", "ord").alias("label"))


def annotate(points: DataFrame, regions: DataFrame, column: str = "overlay", default: str | None = "NONE", cell: int = CELL) -> DataFrame:
    """Each point's region state where start <= CpG_beg < end; of several the last in (chromosome, start, end) order; else ``default``.

    One left join on (sample, chromosome, cell) with stretches that don't overlap, of which a point meets one at most; Spark
    broadcasts them while they are small. Regions' sample_id must match.
    """
    flat = flattened(regions, cell)
    flat = flat.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
    flat = flat.select(F.col("sample_id").alias("_sample"), F.col("CpG_chrm").alias("_chrm"), "_cell", F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("label").alias("_label"))
    here = (F.col("sample_id") == F.col("_sample")) & (F.col("CpG_chrm") == F.col("_chrm")) & (F.floor(F.col("CpG_beg") / cell) == F.col("_cell"))
    found = points.drop(column).join(flat, here & (F.col("CpG_beg") >= F.col("_start")) & (F.col("CpG_beg") < F.col("_end")), "left")
    return found.withColumn(column, F.coalesce("_label", F.lit(default).cast("string"))).drop("_sample", "_chrm", "_cell", "_start", "_end", "_label")


def overlaps(chrom: str, start: int, end: int) -> Column:
    """Closed-interval overlap of a point with a region."""
    return (F.col("CpG_chrm") == chrom) & (F.col("CpG_beg") <= end) & (F.col("CpG_end") >= start)


def one_region(spark, sample_id: str, chrom: str, start: int, end: int, state: str) -> DataFrame:
    return spark.createDataFrame([(sample_id, chrom, start, end, state)], "sample_id string, CpG_chrm string, start long, end long, state string")


def quotas(retained: int, removed: int, most: int) -> tuple[int, int]:
    """How many points of each stream a plot of ``most`` points shows: the fair share of the retained ones, held between what the
    removed ones can't fill (one at least) and what there is; the rest is removed ones."""
    if retained + removed <= most:
        return retained, removed
    fair = round(most * retained / (retained + removed))
    kept = min(max(fair, most - removed, 1), retained, most)
    return kept, most - kept


def downsample(points: DataFrame, removed: DataFrame | None, most: int | None = 120_000, seed: int = 42) -> DataFrame:
    """At most ``most`` points of both streams, column ``layer`` telling them apart: a sampling operator, in order of a hash of the place.

    None draws all points.
    """
    def pick(df: DataFrame, layer: str, n: int | None) -> DataFrame:
        rows = df.select("CpG_chrm", "CpG_beg", "CpG_end", "beta", "input_row_index").withColumn("layer", F.lit(layer))
        if n is None:
            return rows
        by = F.md5(F.concat_ws("|", F.lit(str(seed)), "CpG_chrm", F.col("CpG_beg").cast("string"), F.col("input_row_index").cast("string")))
        return rows.orderBy(by, "input_row_index").limit(n)

    a, b = (None, None) if most is None else quotas(points.count(), removed.count() if removed is not None else 0, most)
    out = pick(points, "retained", a)
    return out if removed is None else out.unionByName(pick(removed, "removed", b))


def zoom(start: int, end: int) -> tuple[int, int]:
    """The range that a plot of a region shows: a tenth on both sides, 1000 base pairs at least."""
    flank = max(1000, -(-(end - start) // 10))
    return max(0, start - flank), end + flank


def plot_points(points: DataFrame, label: str = "state", colours: dict[str, str] | None = None) -> DataFrame:
    """Scatter data: position, beta, label and its colour."""
    return points.select("sample_id", "CpG_chrm", "CpG_beg", "beta", state_name(label).alias("label"), state_colour(label, colours).alias("colour"))


def plot_table(
    points: DataFrame, regions: DataFrame | None = None, removed: DataFrame | None = None, most: int | None = 120_000, window: tuple[int, int] | None = None, label: str = "state", colours: dict[str, str] | None = None,
) -> DataFrame:
    """A whole scatter plot as a table: CpG_chrm, CpG_beg, beta, layer, label, overlay, colour.

    ``window``: a region that the plot shows with its flanks. At most ``most`` points in both layers (None: all), drawn before labels
    are looked up; removed points have no label. With ``regions`` the colour is that of the region a point lies in, else of its label.
    """
    here = F.lit(True)
    if window:
        start, end = zoom(*window)
        here = F.col("CpG_beg").between(start, end)
    points = points.where(here)
    drawn = downsample(points, removed.where(here) if removed is not None else None, most)
    own = points.select("sample_id", "CpG_chrm", "input_row_index", *([state_name(label).alias("label")] if label in points.columns else [F.lit(None).cast("string").alias("label")]))
    out = drawn.where("layer = 'retained'").join(own, ["CpG_chrm", "input_row_index"])
    out = annotate(out, regions) if regions is not None else out.withColumn("overlay", F.lit(None).cast("string"))
    rest = drawn.where("layer = 'removed'").select("*", *(F.lit(None).cast("string").alias(c) for c in ("label", "overlay")))
    columns = ["CpG_chrm", "CpG_beg", "beta", "layer", "label", "overlay"]
    both = out.select(*columns).unionByName(rest.select(*columns))
    return both.withColumn("colour", state_colour("overlay" if regions is not None else "label", colours))


def embedding_table(scored: DataFrame, components: int = 2, label: str = "state", region: tuple[str, int, int] | None = None, most: int | None = None, colours: dict[str, str] | None = None) -> DataFrame:
    """Principal-component scores of points as a plot table: PC1 on, label, colour, and whether a point lies in a highlighted region.

    ``scored``: what a fitted model's ``apply`` gives. ``most``: points drawn at most, in order of a hash of the place.
    """
    inside = overlaps(*region) if region else F.lit(False)
    rows = scored.select("CpG_chrm", "CpG_beg", "input_row_index", *(F.get("scores", i).alias(f"PC{i + 1}") for i in range(components)), state_name(label).alias("label"), state_colour(label, colours).alias("colour"), inside.alias("highlighted"))
    if most is None:
        return rows
    by = F.md5(F.concat_ws("|", "CpG_chrm", F.col("CpG_beg").cast("string"), F.col("input_row_index").cast("string")))
    return rows.orderBy(by, "input_row_index").limit(most)


def first_appearance(points: DataFrame) -> DataFrame:
    """Chromosomes with their rank by first input row."""
    firsts = points.groupBy("CpG_chrm").agg(F.min("input_row_index").alias("first_row"))
    # as many rows as chromosomes
    return firsts.withColumn("chrom_ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_row")).cast("long"))
