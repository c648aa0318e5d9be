import random

import pytest

from cpgdomains.operators import overlay, regions
from cpgdomains.schema import POINTS, REGIONS, STATES


def labelled(spark, rows):
    return spark.createDataFrame([("s", c, p, e, b, i, s) for i, (c, p, e, b, s) in enumerate(rows)], POINTS + ", state string")


def test_islands_break_on_chromosome_and_state(spark):
    rows = [("chr1", 1, 9, 0.1, "LOW"), ("chr1", 3, 5, 0.3, "LOW"), ("chr1", 5, 7, 0.5, "PMD"), ("chr1", 7, 9, 0.1, "LOW"), ("chr2", 1, 3, 0.2, "LOW"), ("chr10", 1, 3, 0.4, "LOW"), ("chr1", 9, 11, 0.6, None)]
    found = {(r.CpG_chrm, r.start): r for r in regions.raw_regions(labelled(spark, rows)).collect()}
    assert set(found) == {("chr1", 1), ("chr1", 5), ("chr1", 7), ("chr1", 9), ("chr2", 1), ("chr10", 1)}
    first = found["chr1", 1]
    assert (first.end, first.probe_count) == (5, 2) and first.avg_beta == pytest.approx(0.2)  # end of the last row, not the furthest


@pytest.mark.parametrize("stretch", [1, 10, 1000])
def test_islands_join_across_stretches(spark, stretch):
    rng = random.Random(stretch)
    rows = [("c", rng.randint(0, 300), 0, rng.random(), rng.choice(["LOW", "LOW", "HIGH"])) for _ in range(200)]
    rows = [(c, p, p + 2, b, s) for c, p, _, b, s in rows]
    order = sorted(range(200), key=lambda i: (rows[i][1], i))
    wanted, last = [], None
    for i in order:
        _, p, e, b, s = rows[i]
        if s == last:
            wanted[-1] = (wanted[-1][0], e, wanted[-1][2] + 1, s)
        else:
            wanted.append((p, e, 1, s))
        last = s
    found = [(r.start, r.end, r.probe_count, r.state) for r in regions.raw_regions(labelled(spark, rows), stretch=stretch).collect()]
    assert sorted(found) == sorted(wanted)


def test_dropped_island_leaves_its_neighbours_apart(spark):
    rows = [("c", i, i + 1, 0.5, s) for i, s in enumerate(["LOW"] * 4 + ["PMD"] + ["LOW"] * 4)]
    assert [r.probe_count for r in regions.raw_regions(labelled(spark, rows), min_probes=2).collect()] == [4, 4]


def table(spark, rows):
    return spark.createDataFrame([("s", "c", s, e, b, n, st) for s, e, b, n, st in rows], REGIONS)


def loop_absorb(rows, state, gap):
    out, block, last = [], [], None
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[4])):
        if r[4] not in (state, "INTERMEDIATE") or (block and r[0] - last > gap):
            if any(x[4] == state for x in block):
                out.append(block)
            block = []
        if r[4] in (state, "INTERMEDIATE"):
            block.append(r)
            last = r[1]
    if any(x[4] == state for x in block):
        out.append(block)
    return [(min(x[0] for x in b), max(x[1] for x in b), sum(x[3] for x in b), len(b)) for b in out]


def loop_merge(rows, gap):
    out = []
    for s, e, n, k in sorted(rows):
        if out and s - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] + n, out[-1][3] + k)
        else:
            out.append((s, e, n, k))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_absorb_and_merge_against_loops(spark, seed):
    rng = random.Random(seed)
    at, rows = 0, []
    for _ in range(60):
        at += rng.randint(0, 30)
        end = at + rng.randint(1, 40)
        rows.append((at, end, 0.5, rng.randint(1, 5), rng.choice(STATES)))
        at = end if seed % 2 else at + 5
    gap = rng.choice([0, 5, 20])
    found = regions.absorb_intermediate(table(spark, rows), "PMD", gap)
    wanted = loop_absorb(rows, "PMD", gap)
    assert sorted((r.start, r.end, r.probe_count, r.n_segments) for r in found.collect()) == sorted(wanted)
    merged = regions.merge_within_gap(found, gap)
    assert sorted((r.start, r.end, r.probe_count, r.n_segments) for r in merged.collect()) == sorted(loop_merge(wanted, gap))


def test_gap_limit_and_nested_regions(spark):
    rows = [(0, 100, 0.1, 5, "LOW"), (200, 210, 0.2, 5, "LOW"), (311, 320, 0.3, 5, "LOW"), (400, 1000, 0.1, 1, "LOW"), (410, 420, 0.1, 1, "LOW"), (1050, 1060, 0.1, 1, "LOW")]
    found = regions.clean_regions(table(spark, rows), "LOW", merge_gap=100, with_intermediate=False, min_length=0, min_probes=0).orderBy("start").collect()
    assert [(r.start, r.end) for r in found] == [(0, 210), (311, 1060)]
    with pytest.raises(ValueError):
        regions.merge_within_gap(table(spark, rows), -1)


def test_one_intermediate_run_joins_both_neighbours(spark):
    rows = [(0, 10, 0.9, 6, "HIGH"), (10, 20, 0.5, 6, "INTERMEDIATE"), (20, 30, 0.1, 6, "LOW")]
    out = {(r.state, r.start, r.end) for r in regions.clean_all(table(spark, rows), min_length=0, min_probes=0).collect()}
    assert out == {("HIGH", 0, 20), ("LOW", 10, 30), ("INTERMEDIATE", 10, 20)}


def test_pmd_columns_and_filters(spark):
    rows = [(0, 10, 0.4, 3, "PMD"), (10, 30, 0.6, 6, "INTERMEDIATE"), (500_000, 500_004, 0.4, 9, "PMD")]
    r, = regions.clean_regions(table(spark, rows), "PMD", min_length=5, min_probes=9).collect()
    assert (r.length, r.contains_intermediate, r.n_pmd_segments, r.n_intermediate_segments, r.n_segments) == (30, True, 1, 1, 2)
    assert r.avg_beta == pytest.approx((0.4 * 3 + 0.6 * 6) / 9)
    low, = regions.clean_regions(table(spark, [(0, 10, 0.4, 6, "LOW")]), "LOW", min_length=10).collect()
    assert low.contains_intermediate is None and low.n_pmd_segments is None
    assert regions.longer_than(table(spark, rows), 10).count() == 1  # strictly longer
    assert regions.of_state(table(spark, rows), 1).count() == regions.of_state(table(spark, rows), "pmd").count() == 2


def test_overlay_half_open_and_last_region_wins(spark):
    pts = spark.createDataFrame([("s", "c", p, p + 2, 0.5, i) for i, p in enumerate([9, 10, 15, 19, 20, 10**7])], POINTS)
    r = table(spark, [(10, 20, 0.1, 1, "LOW"), (12, 18, 0.1, 1, "high"), (30, 30, 0.1, 1, "PMD")])
    for cell in (1, 7, 10**6):
        found = {x.CpG_beg: x.overlay for x in overlay.annotate(pts, r, cell=cell).collect()}
        assert found == {9: "NONE", 10: "LOW", 15: "HIGH", 19: "LOW", 20: "NONE", 10**7: "NONE"}


def test_plot_helpers(spark):
    assert overlay.zoom(5000, 6000) == (4000, 7000) and overlay.zoom(100_000, 200_001) == (89_999, 210_002)
    assert overlay.quotas(100, 0, 10) == (10, 0) and overlay.quotas(1, 1000, 10) == (1, 9) and overlay.quotas(5, 5, 10) == (5, 5) and sum(overlay.quotas(70, 30, 10)) == 10
    pts = spark.createDataFrame([("s", "c", i, i + 2, 0.5, i) for i in range(50)], POINTS)
    assert overlay.downsample(pts, pts.limit(10), 12).count() == 12 and overlay.downsample(pts, None, 12).count() == 12
    assert pts.where(overlay.overlaps("c", 10, 12)).count() == 5  # closed on both sides
    assert {r.colour for r in overlay.plot_points(pts.selectExpr("*", "'low' AS state"), colours={"low": "#000000"}).collect()} == {"#000000"}
