import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgdomains.operators import overlay, rules
from cpgdomains.plans import config
from cpgdomains.plans.pipeline import Segmenter, Settings
from cpgdomains.schema import POINTS, StateCutoffs
from cpgdomains.streaming import prepare as streaming


def genome(spark, n=240):
    rng = np.random.default_rng(11)
    rows = []
    for c in ("chr1", "chr2"):
        for i in range(n):
            level, spread = [(0.9, 0.04), (0.45, 0.1), (0.05, 0.03)][(i // 40) % 3]
            rows.append(("s", c, i * 500, i * 500 + 2, float(np.clip(rng.normal(level, spread), 0, 1)), len(rows)))
    return spark.createDataFrame(rows, POINTS)


BASE = dict(windows=[(4000, "4kb"), (10_000, "10kb")], stay=0.99, noise=0.2, min_probes=2, min_region_length=1000, merge_gap=1000, merge_with_intermediate_gap=1000, n_pca=3)


def test_kmeans_run_writes_files_and_restores(spark, tmp_path):
    points = genome(spark)
    s = Segmenter(Settings(**BASE, n_states=3)).fit(points, search=20)
    assert s.settings.cutoffs is not None and {r.chrom for r in s.summary.collect()} == {"chr1", "chr2"}
    raw, clean, paths = s.run(points, out_dir=str(tmp_path / "out"))
    assert (tmp_path / "out/segments_chr2_s_INTERMEDIATE.bed").exists() and (tmp_path / "out/clean_regions/metadata_cleaned_chr1_s_LOW.tsv").exists()
    assert len(paths) == 8 and raw.count() > 6 and clean.count() > 0
    assert sum(r.probe_count for r in raw.collect()) <= 480
    path = config.save(spark, s, str(tmp_path / "model"), "wgbs")
    again = config.pretrained(spark, str(tmp_path / "model"), "wgbs")
    assert again.settings == s.settings and again.model.features == s.model.features
    assert sorted(again.regions(points).collect()) == sorted(raw.collect())
    assert again.summary.count() == 2 and again.training.count() == 480
    assert config.resolve(path, "a/b").endswith("model/a/b") and config.resolve(path, "/a") == "/a"
    with pytest.raises(FileNotFoundError):
        config.pretrained(spark, str(tmp_path / "model"), "27k")
    assert config.cutoffs_from_yaml(spark, path) == s.settings.cutoffs
    assert config.load(spark, path, learned=False).model is None
    (tmp_path / "model/wgbs_artifacts").rename(tmp_path / "elsewhere")
    config.relocate(spark, path, "wgbs_artifacts", str(tmp_path / "elsewhere"))
    assert config.load(spark, path).training.count() == 480
    for source in ("kmeans", "rules", "segments"):
        assert s.label_points(points, source).where("state IS NOT NULL").count() == 480
    with pytest.raises(ValueError):
        s.label_points(points, "other")
    table = overlay.plot_table(s.label_points(points, "rules"), clean, points.limit(5), most=100)
    assert table.count() == 100 and set(table.columns) == {"CpG_chrm", "CpG_beg", "beta", "layer", "label", "overlay", "colour"}
    s.release()
    assert not s._kept


def test_several_samples_give_what_each_gives_alone(spark, tmp_path):
    one = genome(spark)
    other = one.where("CpG_beg < 90000").withColumns({"sample_id": F.lit("t"), "beta": F.lit(1.0) - F.col("beta")})
    for smoother in ("sticky", "continuous-time"):
        s = Segmenter(Settings(**BASE, assignment="definition", smoother=smoother, holding=20_000.0, ct_max_iter=3))
        both, clean, paths = s.run(one.unionByName(other), out_dir=str(tmp_path / smoother))
        assert len(paths) == 16 and (tmp_path / smoother / "t/segments_chr1_t_PMD.bed").exists()
        alone = [s.run(x)[0] for x in (one, other)]
        key = lambda r: (r.sample_id, r.CpG_chrm, r.start, r.end, r.state, r.probe_count)
        assert sorted(map(key, both.collect())) == sorted(key(r) for x in alone for r in x.collect())
    with pytest.raises(ValueError):
        Segmenter(Settings(**BASE)).fit(one.unionByName(other))


def test_files_of_the_continuous_run_come_before_the_length_filter(spark, tmp_path):
    points = genome(spark, 120)
    s = Segmenter(Settings(**(BASE | {"min_region_length": 30_000}), assignment="definition", smoother="continuous-time", holding=20_000.0, ct_max_iter=3))
    raw, _, _ = s.run(points, out_dir=str(tmp_path))
    beds = sum(len((tmp_path / f"segments_chr1_s_{x}.bed").read_text().splitlines()) for x in ("LOW", "PMD", "INTERMEDIATE", "HIGH"))
    summary = sum(len((tmp_path / f"summary_files/segments_raw_{x}.bed").read_text().splitlines()) for x in ("LOW", "PMD", "INTERMEDIATE", "HIGH"))
    assert beds > raw.where("CpG_chrm = 'chr1'").count() and summary == raw.count()
    found = s.one_chromosome(points, "chr1", str(tmp_path / "one"))
    assert all(r.end - r.start > 30_000 for r in found.collect())
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "one").glob("segments_chr1_s_*.bed")) >= beds
    with pytest.raises(ValueError):
        s.one_chromosome(points.unionByName(points.withColumn("sample_id", F.lit("t"))), "chr1", str(tmp_path / "two"))


def test_least_probes_follow_the_entry_point():
    s = Segmenter(Settings())
    assert (s._least(None, 5), s._least(None, 3), s._least(7, 3)) == (5, 3, 7)
    assert Segmenter(Settings(min_probes=4))._least(None, 3) == 4


def test_fit_and_run(spark, tmp_path):
    s = Segmenter(Settings(**BASE, assignment="definition"))
    _, _, paths = s.fit_run(genome(spark), out_dir=str(tmp_path), search=15)
    lines = (tmp_path / "rule_based_optimization_summary.csv").read_text().splitlines()
    assert len(lines) == 2 and lines[0].startswith("beta_low_max,beta_high_min,4kb_int_min") and "f1_macro" in lines[0] and len(paths) == 8


def test_definition_with_continuous_time(spark):
    points = genome(spark, 120)
    cutoffs = StateCutoffs.from_mapping({"beta_low_max": 0.25, "beta_high_min": 0.7, "pmd_cutoffs": {"4kb": {"int_min": 0.5, "std_max": 0.3, "high_max": 0.3}}})
    s = Segmenter(Settings(**BASE, assignment="definition", smoother="continuous-time", holding=20_000.0, ct_max_iter=3, cutoffs=cutoffs))
    raw = s.regions(points, ["chr2"])
    found = raw.collect()
    assert {r.CpG_chrm for r in found} == {"chr2"} and all(r.end - r.start > 1000 for r in found)
    assert s.segment(points, ["chr2"], key="k") is s.segment(points, ["chr2"], key="k")
    assert s.segment(points, ["chr2"], key="k") is not s.segment(points, ["chr2"], key="k", force=True)
    labelled = rules.label_by_rules(s.emissions(points), cutoffs)
    assert labelled.where("state = 'PMD'").count() > 0


def test_defaults_follow_the_resolution():
    assert Settings().smoother == "sticky" and Settings(resolution="450K").smoother == "continuous-time" and len(Settings().windows) == 3
    with pytest.raises(ValueError):
        Settings(resolution="850k")
    with pytest.raises(NotImplementedError):
        Segmenter(Settings(assignment="auto")).label(None)
    with pytest.raises(ValueError):
        Segmenter().label(None)


def test_stream_splits_as_a_batch_does(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.tsv").write_text("s\tc\t1\t3\t5\t20\ns\tc\t5\t7\t1\t4\n")
    args = [str(tmp_path / x) for x in ("kept", "removed", "check")]
    rows = streaming.read_counts(spark, str(src))
    streaming.write_split(rows, *args).awaitTermination()
    (src / "b.tsv").write_text("s\tc\t9\t11\t10\t10\n")
    streaming.write_split(streaming.read_counts(spark, str(src)), *args).awaitTermination()
    kept = {r.CpG_beg: r.beta for r in spark.read.parquet(args[0]).collect()}
    assert kept == {1: 0.25, 9: 1.0} and [r.CpG_beg for r in spark.read.parquet(args[1]).collect()] == [5]
    q = streaming.coverage_by_chromosome(streaming.read_counts(spark, str(src))).writeStream.format("memory").queryName("cov").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert math.isclose(spark.table("cov").first().mean_coverage, 34 / 3)


def test_a_plot_without_a_limit_shows_all_points(spark):
    points = genome(spark, 120)
    assert overlay.plot_table(points, removed=points.limit(7), most=None).count() == points.count() + 7
    assert overlay.downsample(points, None, None).count() == points.count() > overlay.downsample(points, None, 50).count() == 50


def test_the_zoomed_plot_query_has_more_points_than_a_sampled_plot(spark, monkeypatch, tmp_path):
    import __spark_entry__ as entry

    at = F.expr("timestampadd(SECOND, cast(400000 + id % 200000 AS int), timestamp_ntz'2024-01-01 00:00:00')")
    spark.range(120_500).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit(5.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    assert entry.queries()["plot_points"](spark, str(tmp_path)).count() == 120_500
