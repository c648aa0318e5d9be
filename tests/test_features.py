import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cpgdomains.operators import features as f
from cpgdomains.schema import POINTS

WINDOW = [(100, "w")]


def points(spark, rows):
    return spark.createDataFrame([("s", c, p, p + 2, b, i) for i, (c, p, b) in enumerate(rows)], POINTS)


def brute(rows, size):
    h, out = size // 2, {}
    for i, (c, p, _) in enumerate(rows):
        b = np.array([x for d, q, x in rows if d == c and p - h <= q <= p + h and x is not None and x == x])
        out[i] = (b.mean(), b.std(), (b > 0.7).mean(), ((b >= 0.2) & (b <= 0.7)).mean(), (b < 0.2).mean(), float(len(b))) if len(b) else (None,) * 5 + (0.0,)
    return out


def same(found, wanted):
    for r in found:
        for x, y in zip([r[f"w_{s}"] for s in f.SUFFIXES], wanted[r.input_row_index], strict=True):
            assert (x is None or x != x) == (y is None) and (y is None or abs(x - y) < 1e-7), (r, wanted[r.input_row_index])


@pytest.mark.parametrize("plan", ["range", "edge"])
def test_windows_against_brute_force(spark, plan):
    rng = np.random.default_rng(2)
    rows = [(f"chr{rng.integers(3)}", int(rng.integers(0, 3000)), float(rng.choice([0.0, 0.2, 0.7, 0.5, 1.0, rng.random()]))) for _ in range(400)]
    rows += [("chr9", 10, 0.3), ("chr1", 500, None), ("chr1", 510, float("nan")), ("far", 0, 0.2), ("far", 50, 0.7), ("far", 51, 1.0), ("lost", 5, None)]
    same(f.emissions(points(spark, rows), WINDOW, plan=plan).collect(), brute(rows, 100))


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_plans_agree_at_any_size(spark, size):
    rng = np.random.default_rng(size)
    rows = [("c", int(p), float(b)) for p, b in zip(rng.integers(0, 400, 150), rng.random(150), strict=True)]
    for plan in ("range", "edge"):
        same(f.emissions(points(spark, rows), [(size, "w")], plan=plan).collect(), brute(rows, size))


def test_density_chooses_the_plan(spark):
    rows = [("c", i, 0.5) for i in range(1000)]
    table = points(spark, rows)
    assert f.densities(table, [500, 2000]) == [500, 1000] and f.densities(points(spark, rows[:1]), [500]) == [1] and f.densities(points(spark, []), [1]) == [0]
    assert all(r.w_n_cpg == min(r.CpG_beg + 251, 1000, 501, 1000 - r.CpG_beg + 250) for r in f.emissions(table, [(500, "w")]).collect())


def test_no_points(spark):
    assert f.emissions(points(spark, []), WINDOW).count() == 0


def test_zscores_imputation_and_logs(spark):
    table = spark.createDataFrame([(1.0, 5.0, 0.0), (3.0, 5.0, None), (2.0, 5.0, 3.0), (6.0, 5.0, float("nan"))], "a double, b double, n double")
    z = [r.z_a for r in f.standardised(table, ["a", "b"]).collect()]
    assert abs(np.mean(z)) < 1e-12 and abs(np.std(z) - 1) < 1e-12
    assert {r.z_b for r in f.standardised(table, ["b"]).collect()} == {0.0}
    assert [r.n for r in f.imputed(table, ["n"]).collect()] == [0.0, 1.5, 3.0, 1.5]
    with pytest.raises(ValueError, match="no values"):
        f.imputed(table.withColumn("n", F.lit(None).cast("double")), ["n"])
    with pytest.raises(ValueError, match="infinite"):
        f.imputed(table.withColumn("n", F.lit(float("inf"))), ["n"])
    assert f.log_counts(table.select("a"), ["a"]).first().a == pytest.approx(np.log(2))
    with pytest.raises(Exception, match="negative"):
        f.log_counts(table.withColumn("a", F.lit(-1.0)), ["a"]).collect()


def test_feature_choice(spark):
    table = f.emissions(points(spark, [("c", 1, 0.5)]), [(10, "x"), (20, "y")])
    assert f.select_features(table, ["y"]) == ["beta", *[f"y_{s}" for s in f.SUFFIXES[:-1]]]
    assert not any(c.endswith("n_cpg") for c in f.select_features(table)) and len(f.select_features(table)) == 11
    with pytest.raises(ValueError):
        f.select_features(table.select("CpG_chrm"))


@given(st.integers(1, 10**6))
@settings(max_examples=5, deadline=None)
def test_names(size):
    assert f.feature_names([(size, "q")], counts=False) == [f"q_{s}" for s in f.SUFFIXES[:-1]]


def test_rows_of_windows_follow_places_not_points(spark):
    rows = [("c", int(p), float(b)) for p, b in zip(np.repeat(np.arange(0, 400, 10), 50), np.random.default_rng(4).random(2000), strict=True)]
    table = points(spark, rows)
    places = f._places(table, 0.2, 0.7, 0.7)
    assert places.count() == 40 and f._edge(places, WINDOW).count() == f._range(places, WINDOW).count() == 40
    for plan in ("range", "edge", "auto"):
        found = f.emissions(table, WINDOW, plan=plan).collect()
        assert len(found) == 2000
        same(found, brute(rows, 100))
    same(f.emissions(table, WINDOW, at=table.where("CpG_beg = 50")).collect(), brute(rows, 100))
    assert f.emissions(table, WINDOW, at=table.where("CpG_beg = 50")).count() == 50


@given(st.lists(st.integers(0, 9), min_size=1, max_size=70), st.data())
@settings(max_examples=60, deadline=None)
def test_sums_of_ranges(values, data):
    first = np.array(data.draw(st.lists(st.integers(0, len(values) - 1), min_size=1, max_size=9)))
    end = np.array([data.draw(st.integers(int(i) + 1, len(values))) for i in first])
    (found,) = f.range_sums([np.array(values, float)], first, end)
    assert found.tolist() == [sum(values[i:j]) for i, j in zip(first, end, strict=True)]


def test_sums_of_ranges_keep_digits_after_large_values():
    values = np.array([1e16] * 50 + [0.1] * 3)
    assert f.range_sums([values], np.array([51, 50]), np.array([52, 53]))[0] == pytest.approx([0.1, 0.3], rel=1e-12)
