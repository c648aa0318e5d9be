import gzip
import os

import pytest
from pyspark.sql import functions as F

from cpgdomains.operators import prepare
from cpgdomains.schema import POINTS, REGIONS
from cpgdomains.sources import sinks, tables


def put(tmp_path, name, text):
    path = tmp_path / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


COUNTS = "chr1\t310\t312\t7\t12\nchr1\t340\t342\t11\t11\nchr1\t455\t457\t1\t4\nchr2\t6\t8\t0\t0\nchr2\t12\t14\t7\t14\n"
BETAS = "chr1\t700\t702\t0.0\tp1\nchr1\t820\t822\t0.25\tp2\nchr1\t905\t907\t0.37\tp3\n"


@pytest.mark.parametrize("header", ["", "chrom\tstart\tend\tmeth\tcoverage\n", " Chr \tPOS\tstop\tmethylated_reads\tTotal_Reads\n"])
@pytest.mark.parametrize("name", ["a.tsv", "a.tsv.gz"])
@pytest.mark.parametrize("resolution", ["wgbs", "auto"])
def test_counts(spark, tmp_path, header, name, resolution):
    p = tables.prepare_sample(spark, put(tmp_path, name, header + COUNTS), "s", resolution)
    kept, removed = p.points.collect(), p.removed.collect()
    assert [(r.CpG_chrm, r.CpG_beg, r.CpG_end) for r in kept] == [("chr1", 310, 312), ("chr1", 340, 342), ("chr2", 12, 14)]
    assert kept[0].beta == pytest.approx(7 / 12) and p.resolution == "wgbs"
    assert [(r.CpG_beg, r.coverage, r.beta, r.removal_reason) for r in removed] == [(455, 4.0, 0.25, "low_coverage"), (6, 0.0, None, "low_coverage")]
    assert [r.input_row_index for r in kept] == [0, 1, 4] and [r.input_row_index for r in removed] == [2, 3]


def test_coverage_limit_is_inclusive_and_beta_set(spark, tmp_path):
    path = put(tmp_path, "a.tsv", COUNTS)
    p = tables.prepare_sample(spark, path, "s", "wgbs", min_coverage=10, remove_low_coverage_like=True)
    assert [r.CpG_beg for r in p.points.collect()] == [310]  # 1.0 and 0.5 look like few reads
    assert p.removed.groupBy("removal_reason").count().where("removal_reason = 'low_coverage_like_beta'").first()["count"] == 2
    own = tables.prepare_sample(spark, path, "s", "wgbs", remove_low_coverage_like=True, low_coverage_like=(0.5,), retain_removed=False)
    assert own.points.count() == 2 and own.removed.count() == 0


@pytest.mark.parametrize("header", ["", "CpG_chrm\tCpG_beg\tCpG_end\tbeta\tprobe_id\n"])
@pytest.mark.parametrize("resolution", ["450k", "27k", "850k", "auto"])
def test_betas_with_probes(spark, tmp_path, header, resolution):
    p = tables.prepare_sample(spark, put(tmp_path, "b.tsv", header + BETAS), "s", resolution, remove_low_coverage_like=True)
    assert [r.beta for r in p.points.collect()] == [0.37] and p.points.columns == ["sample_id", "CpG_chrm", "CpG_beg", "CpG_end", "beta", "input_row_index"]
    assert [r.probe for r in p.removed.collect()] == ["p1", "p2"]


def test_four_columns_and_wrong_files(spark, tmp_path):
    four = put(tmp_path, "c.tsv", "\n".join("\t".join(x.split("\t")[:4]) for x in BETAS.splitlines()))
    for resolution in ("wgbs", "450k", "auto"):
        assert tables.prepare_sample(spark, four, "s", resolution).points.count() == 3
    with pytest.raises(ValueError):
        tables.prepare_sample(spark, put(tmp_path, "d.tsv", "chr1\t1\t3\n"), "s", "wgbs")
    with pytest.raises(ValueError):
        tables.prepare_sample(spark, put(tmp_path, "e.tsv", "chr1\t1\t3\t0.1\ta\tb\n"), "s", "450k")
    with pytest.raises(ValueError, match="outside"):
        tables.prepare_sample(spark, put(tmp_path, "f.tsv", "chr1\t1\t3\t1.5\n"), "s", "450k")
    with pytest.raises(ValueError):
        tables.prepare_sample(spark, put(tmp_path, "g.tsv", ""), "s", "450k")
    with pytest.raises(ValueError):
        tables.prepare_sample(spark, four, "s", "other")


def test_header_rows():
    assert tables.header_layout(["chr", "pos", "end", "meth", "cov"]) == "counts" and tables.header_layout(["chr", "pos", "end", "beta", "cpg"]) == "probe"
    assert tables.header_layout(["chr", "pos", "end", "beta", "x"]) == "beta" and tables.header_layout(["chr1", "1", "3", "0.5"]) is None and tables.header_layout(["chr", "pos"]) is None


def test_names_by_alias_or_place(spark):
    named = spark.createDataFrame([("c", 1, 3, 3, 4)], "Chrom string, Start long, Stop long, methylated long, depth long")
    assert tables.normalise_columns(named).first().beta == 0.75
    plain = spark.createDataFrame([("c", 1, 3, 0.5, "p")], "_1 string, _2 long, _3 long, _4 double, _5 string")
    assert tables.normalise_columns(plain).columns == ["CpG_chrm", "CpG_beg", "CpG_end", "beta", "probe"]
    assert tables.finalise(tables.normalise_columns(plain), True).count() == 0
    with pytest.raises(ValueError):
        tables.normalise_columns(plain.select("_1", "_2"))


def test_dense_index(spark, tmp_path):
    for k in range(3):
        put(tmp_path, f"{k}.tsv", BETAS * 5)
    rows = tables.dense_index(tables.read_table(spark, str(tmp_path), "probe", "s"))
    assert sorted(r.input_row_index for r in rows.collect()) == list(range(45))


def points(spark, rows):
    return spark.createDataFrame([("s", c, p, p + 2, b, i) for i, (c, p, b) in enumerate(rows)], POINTS)


def test_validation(spark):
    prepare.validate(points(spark, [("c", 1, 0.0), ("c", 2, 1.0), ("c", 3, float("nan")), ("c", 4, None)]))
    for bad in (-0.01, 1.01):
        with pytest.raises(ValueError):
            prepare.validate(points(spark, [("c", 1, bad)]))
    with pytest.raises(ValueError):
        prepare.validate(points(spark, [("c", 1, 0.5)]).drop("beta"))
    with pytest.raises(ValueError):
        prepare.validate(points(spark, [("c", 1, 0.5)]).withColumn("beta", F.col("beta").cast("string")))


def test_chromosome_subsets(spark):
    p = points(spark, [("chr10", 1, 0.5), ("chr2", 1, 0.5), ("chr10", 2, 0.5), ("chrX", 1, 0.5)])
    assert prepare.chromosomes(p) == ["chr10", "chr2", "chrX"]
    assert {r.CpG_chrm: r.chrom_ord for r in prepare.subset(p, ["chrX", "chr10", "chrX"]).collect()} == {"chrX": 0, "chr10": 1}
    assert {r.CpG_chrm: r.chrom_ord for r in prepare.subset(p).collect()} == {"chr10": 0, "chr2": 1, "chrX": 2}
    with pytest.raises(ValueError):
        prepare.subset(p, ["chr1"])
    assert prepare.training_chromosomes(p) == (["chr2", "chr10"], []) and prepare.training_chromosomes(p, ["chr2", "chr7"]) == (["chr2"], ["chr7"])
    with pytest.raises(ValueError):
        prepare.training_chromosomes(p, ["chr7"])


def test_training_sample(spark):
    p = points(spark, [("chr1", i, 0.5) for i in range(30)] + [("chr2", i, 0.5) for i in range(5)])
    assert {r.CpG_chrm: r["count"] for r in prepare.training_sample(p, ["chr1", "chr2"], 10).groupBy("CpG_chrm").count().collect()} == {"chr1": 10, "chr2": 5}
    assert sorted(prepare.training_sample(p, ["chr1"], 10).collect()) == sorted(prepare.training_sample(p, ["chr1"], 10).collect())
    summary = {r.chrom: r for r in prepare.training_summary(p, ["chr1", "chr2"], ["chr9"], 10).collect()}
    assert summary["chr1"].sampled and summary["chr1"].sampling_fraction == pytest.approx(1 / 3) and not summary["chr2"].sampled and not summary["chr9"].available
    with pytest.raises(ValueError):
        prepare.training_sample(p, ["chr1"], 0)


def test_files(spark, tmp_path):
    raw = spark.createDataFrame([("s", "chr2", 5, 9, 0.5, 3, "HIGH"), ("s", "chr10", 1, 4, 0.25, 3, "PMD"), ("s", "chr10", 0, 4, 0.25, 3, "HIGH")], REGIONS)
    path = sinks.write_bed(raw, f"{tmp_path}/all.bed")
    assert open(path).read() == "chr10\t0\t4\tHIGH\nchr10\t1\t4\tPMD\nchr2\t5\t9\tHIGH\n"
    short = sinks.write_raw(raw, str(tmp_path / "my.bed.d"), "s1", ["chr2", "chr10", "chr7"], longer_than=3)
    assert [os.path.basename(p) for p in short] == [f"segments_raw_{s}.bed" for s in ("LOW", "PMD", "INTERMEDIATE", "HIGH")]
    top = tmp_path / "my.bed.d"
    assert (top / "segments_chr7_s1_LOW.bed").read_text() == "" and (top / "segments_chr10_s1_PMD.bed").read_text() == "chr10\t1\t4\tPMD\n"
    assert len(list(top.glob("segments_*.bed"))) == 12
    assert (top / "summary_files/segments_raw_HIGH.bed").read_text() == "chr2\t5\t9\tHIGH\nchr10\t0\t4\tHIGH\n"
    assert (top / "summary_files/segments_raw_PMD.bed").read_text() == ""
    from cpgdomains.operators.regions import clean_all

    clean = clean_all(raw, min_length=0, min_probes=0)
    paths = sinks.write_clean(clean, str(tmp_path), "s1", ["chr2", "chr10"])
    assert [os.path.basename(p) for p in paths] == [f"segments_cleaned_{s}.bed" for s in ("LOW", "PMD", "INTERMEDIATE", "HIGH")]
    head = (tmp_path / "summary_files/metadata_cleaned_PMD.tsv").read_text().splitlines()
    assert head == ["CpG_chrm\tstart\tend\tavg_beta\tprobe_count\tstate\tlength\tn_segments\tcontains_intermediate\tn_pmd_segments\tn_intermediate_segments", "chr10\t1\t4\t0.25\t3\tPMD\t3\t1\tFalse\t1\t0"]
    assert len((tmp_path / "summary_files/metadata_cleaned_LOW.tsv").read_text().split("\t")) == 8
    assert sinks.read_clean(spark, str(tmp_path), "PMD").first().n_pmd_segments == 1
    assert sinks.read_clean(spark, str(tmp_path), "PMD", "chr10", "s1").first().contains_intermediate is False
    assert sinks.read_clean(spark, str(tmp_path), "LOW", "chr2", "s1").count() == 0
    assert (tmp_path / "clean_regions/segments_cleaned_chr2_s1_HIGH.bed").read_text() == "chr2\t5\t9\tHIGH\n"
    assert (tmp_path / "summary_files/segments_cleaned_HIGH.bed").read_text() == "chr10\t0\t4\tHIGH\nchr2\t5\t9\tHIGH\n"
    states = sinks.write_state_beds(raw, str(tmp_path), "all")
    assert [open(p).read().count("\n") for p in states] == [0, 1, 0, 2]
    history = spark.createDataFrame([(0, 0.5), (1, 0.75)], "trial long, f1_macro double")
    assert open(sinks.write_search_history(history, f"{tmp_path}/h.tsv")).read() == "trial\tf1_macro\n1\t0.75\n0\t0.5\n"
    sinks.write_points(points(spark, [("c", 1, 0.5)]), f"{tmp_path}/points")
    assert spark.read.csv(f"{tmp_path}/points", sep="\t", header=True).first().beta == "0.5"
    again = sinks.read_points(spark, f"{tmp_path}/points", "s")
    assert again.columns == ["sample_id", "CpG_chrm", "CpG_beg", "CpG_end", "beta", "input_row_index"] and again.first().beta == 0.5
    sinks.write_points_table(points(spark, [("c", 1, 0.5), ("d", 1, 0.5)]), f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").where("CpG_chrm = 'd'").count() == 1


def test_rows_of_a_folder_are_numbered_by_file_names(spark, tmp_path):
    for k, times in enumerate((1, 9, 4)):
        put(tmp_path, f"part-{k}.tsv", "chr\tstart\tend\tbeta\tcpg\n" + "".join(f"chr1\t{100 * k + i}\t{100 * k + i + 2}\t0.1\tp\n" for i in range(times)))
    rows = tables.prepare_sample(spark, str(tmp_path), "s", "auto").points.orderBy("input_row_index").collect()
    assert [r.CpG_beg for r in rows] == [0, *range(100, 109), *range(200, 204)] and [r.input_row_index for r in rows] == list(range(14))


def test_tables_are_written_by_executors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "Files", None)  # what streams rows through the driver
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)
    rows = spark.range(1000).repartition(7).select((-F.col("id")).alias("at"), F.lit(" x y").alias(" Name "), F.when(F.col("id") > 0, F.col("id") / 8).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = sinks.write_table(rows, str(tmp_path / "t"), ["at"], header=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(x for x in os.listdir(folder) if x.startswith("part-"))
    texts = [(tmp_path / "t" / x).read_text().splitlines() for x in files]
    assert len(files) > 1 and {t[0] for t in texts} == {" Name \tv"}
    assert [x for t in texts for x in t[1:]] == [f" x y\t{i / 8}" for i in range(999, 0, -1)] + [" x y\t"]


@pytest.mark.parametrize("name", ["scan_counts_header", "scan_betas_removed"])
def test_scans_send_no_rows_through_the_driver(spark, name, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(sinks, "Files", None)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_training_samples_rank_only_what_they_need(spark):
    rows = spark.range(4000).select(F.lit("s").alias("sample_id"), F.concat(F.lit("chr"), (F.col("id") % 2).cast("string")).alias("CpG_chrm"), F.col("id").alias("CpG_beg"), F.lit(0.5).alias("beta"), F.col("id").alias("input_row_index"))
    found = prepare.training_sample(rows, ["chr0", "chr1"], 30)
    by = F.md5(F.concat_ws("|", F.lit("42"), F.col("CpG_beg").cast("string"), F.col("input_row_index").cast("string")))
    wanted = [r.CpG_beg for c in ("chr0", "chr1") for r in rows.where(F.col("CpG_chrm") == c).orderBy(by).limit(30).collect()]
    assert sorted(r.CpG_beg for r in found.collect()) == sorted(wanted) and found.columns == rows.columns
    assert prepare.training_sample(rows, ["chr0"], 5000).count() == 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_last" in plan and plan.index("_rank") < plan.index("_last")  # ranked after the cut
