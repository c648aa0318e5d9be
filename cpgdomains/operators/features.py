"""Centred distance-window features of every point.

The frame of a point at p is [p - W // 2, p + W // 2], both ends included, within (sample, chromosome). Points of one place
share their frame, so counts and sums are first taken per place, and features are found for places and joined to the points: the
work of a window follows the places in it, of which there are W at most, however many points lie on them. Chromosomes are cut into
bins with a halo of half the widest window, so that one long chromosome is many tasks of bounded size; a bin keeps what its own
places get. All windows of a kind share one shuffle. Null and NaN betas count nowhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgdomains.schema import POINT_KEYS

#: Windows' widths that a bin of RANGE frames spans: the halo then repeats an eighth of the places.
BIN_WINDOWS = 8
#: Base pairs of a bin of running sums at least; wider windows have bins of their own width, whose halo repeats each place once.
BIN = 200_000
SUFFIXES = ("avg_meth", "std", "high_pct", "int_pct", "low_pct", "n_cpg")


def feature_names(windows: list[tuple[int, str]], counts: bool = True) -> list[str]:
    return [f"{label}_{s}" for _, label in windows for s in SUFFIXES if counts or s != "n_cpg"]


def _beta() -> Column:
    return F.when(~F.isnan("beta"), F.col("beta"))


def _conditions(low: float, int_high: float, high: float) -> list[Column]:
    b = _beta()
    return [b > F.lit(high), (b >= F.lit(low)) & (b <= F.lit(int_high)), b < F.lit(low)]


def densities(points: DataFrame, sizes: list[int]) -> list[float]:
    """For each window, the largest number of points it holds on average over any (sample, chromosome): one aggregate, for a choice of plan by hand."""
    per = points.groupBy(*POINT_KEYS).agg(F.count(F.lit(1)).alias("n"), (F.max("CpG_beg") - F.min("CpG_beg") + 1).alias("span"))
    row = per.agg(*(F.max(F.col("n") * F.least(F.lit(s), F.col("span")) / F.col("span")).alias(f"d{i}") for i, s in enumerate(sizes))).first()
    return [v or 0.0 for v in row]


def emissions(
    points: DataFrame, windows: list[tuple[int, str]], low: float = 0.2, int_high: float = 0.7, high: float = 0.7, plan: str = "auto", at: DataFrame | None = None
) -> DataFrame:
    """``points`` with six columns per window: mean, population std, shares high / intermediate / low, count.

    ``plan``: "range" for RANGE frames over places, "edge" or "auto" for running sums, whose cost doesn't grow with the window.
    ``at``: some of the points, which get features of all; by default all get them.
    """
    places = _places(points, low, int_high, high)
    out = points if at is None else at
    found = (_range if plan == "range" else _edge)(places, windows).withColumnsRenamed({c: f"_{c}" for c in (*POINT_KEYS, "CpG_beg")})
    here = F.col("CpG_beg") == F.col("_CpG_beg")
    for c in POINT_KEYS:
        here = here & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.drop(*feature_names(windows)).join(found, here).select(*out.columns, *feature_names(windows))


def _places(points: DataFrame, low: float, int_high: float, high: float) -> DataFrame:
    """A row per (sample, chromosome, position): sums of its betas and their squares, counts of all, high, intermediate and low ones."""
    hi, mid, lo = (F.count_if(c) for c in _conditions(low, int_high, high))
    sums = [F.coalesce(F.sum(v), F.lit(0.0)) for v in (_beta(), _beta() * _beta())]
    counts = [F.count(_beta()), hi, mid, lo]
    return points.where("CpG_beg IS NOT NULL").groupBy(*POINT_KEYS, "CpG_beg").agg(*(v.alias(k) for k, v in zip(_SUMS, (*sums, *counts), strict=True)))


_SUMS = ("s1", "s2", "n", "hi", "mid", "lo")


def _with_halo(places: DataFrame, width: int, half: int) -> DataFrame:
    """Each place once in its own bin and once in each neighbouring bin whose places' windows may reach it."""
    own = F.floor(F.col("CpG_beg") / width)
    reach = F.array_distinct(F.array(own, F.floor((F.col("CpG_beg") - half) / width), F.floor((F.col("CpG_beg") + half) / width)))
    return places.withColumn("own_bin", own).withColumn("bin", F.explode(reach))


def _range(places: DataFrame, windows: list[tuple[int, str]]) -> DataFrame:
    order = Window.partitionBy(*POINT_KEYS, "bin").orderBy("CpG_beg")
    most = max(s for s, _ in windows)
    framed = _with_halo(places, BIN_WINDOWS * most, most // 2)
    framed = framed.select("*", *(F.sum(k).over(order.rangeBetween(-(size // 2), size // 2)).alias(f"{k}_{i}") for i, (size, _) in enumerate(windows) for k in _SUMS)).where("bin = own_bin")
    out = []
    for i, (_, label) in enumerate(windows):
        n = F.when(F.col(f"n_{i}") > 0, F.col(f"n_{i}"))
        mean = F.col(f"s1_{i}") / n
        spread = F.col(f"s2_{i}") / n - mean * mean
        columns = [mean, F.sqrt(F.when(spread < 0, 0.0).otherwise(spread)), *(F.col(f"{k}_{i}") / n for k in ("hi", "mid", "lo")), F.col(f"n_{i}").cast("double")]
        out += [c.alias(f"{label}_{s}") for c, s in zip(columns, SUFFIXES, strict=True)]
    return framed.select(*POINT_KEYS, "CpG_beg", *out)


def _edge(places: DataFrame, windows: list[tuple[int, str]]) -> DataFrame:
    most = max(s for s, _ in windows)
    names = feature_names(windows)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("CpG_beg")
        p, own = table["CpG_beg"].to_numpy(), table["own"].to_numpy()
        s1, s2 = (table[k].to_numpy().astype(np.longdouble) for k in ("s1", "s2"))
        counts = [np.concatenate([[0], np.cumsum(table[k].to_numpy())]) for k in ("n", "hi", "mid", "lo")]
        mine = table.filter(table["own"]).select([*POINT_KEYS, "CpG_beg"])
        columns = []
        for size, _ in windows:
            first, end = np.searchsorted(p, p[own] - size // 2), np.searchsorted(p, p[own] + size // 2, "right")
            n, *shares = (c[end] - c[first] for c in counts)
            known, some = n > 0, np.maximum(n, 1)
            total, squares = range_sums([s1, s2], first, end)
            with np.errstate(invalid="ignore"):
                mean = total / some
                std = np.sqrt(np.maximum(squares / some - mean * mean, 0))
            columns += [pa.array(np.asarray(v, dtype=float), mask=~known) for v in (mean, std, *(x / some for x in shares))] + [pa.array(n.astype(float))]
        for name, column in zip(names, columns, strict=True):
            mine = mine.append_column(name, column)
        return mine

    width = max(BIN, most)
    rows = _with_halo(places, width, most // 2).select(*POINT_KEYS, "bin", "CpG_beg", (F.col("bin") == F.col("own_bin")).alias("own"), *_SUMS)
    schema = f"sample_id string, CpG_chrm string, CpG_beg long, {', '.join(f'`{c}` double' for c in names)}"
    return rows.groupBy(*POINT_KEYS, "bin").applyInArrow(run, schema)


def range_sums(columns: list[np.ndarray], first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For each column the sums of its values from ``first`` to before ``end``, which lies after it.

    By additions alone, as differences of running sums over many values lose digits where windows hold few: a sum is that from ``first``
    to the middle of the smallest block of 2 ** k values that holds the range, and from there on.
    """
    last = end - 1
    level = np.frexp((first ^ last).astype(float))[1]
    out = [c[first] for c in columns]
    for k in np.unique(level[level > 0]).tolist():
        which, half = np.flatnonzero(level == k), 1 << (k - 1)
        i, j = first[which], last[which]
        for c, sums in zip(columns, out, strict=True):
            blocks = np.concatenate([c, np.zeros(-len(c) % (2 * half), c.dtype)]).reshape(-1, half)
            before, after = np.cumsum(blocks[0::2, ::-1], axis=1)[:, ::-1], np.cumsum(blocks[1::2], axis=1)
            sums[which] = before[i >> k, i & (half - 1)] + after[j >> k, j & (half - 1)]
    return out


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scores by population mean and deviation as ``z_<column>``; a constant column gives 0."""
    row = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return df.select("*", *((F.lit(0.0) if not row[f"s_{c}"] else (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"])).alias(f"z_{c}") for c in columns))


def log_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``log1p`` of count features; a negative value raises when the plan runs."""
    checked = lambda c: F.when(F.col(c) >= 0, F.log1p(c)).when(F.col(c) < 0, F.raise_error(F.lit(f"{c} is negative")).cast("double"))
    return df.withColumns({c: checked(c) for c in columns})


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null and NaN give way to the column's exact median; a column without values and infinite values are errors."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    row = df.agg(*(F.median(v).alias(c) for c, v in clean.items()), *(F.max((F.abs(v) == float("inf")).cast("int")).alias(f"inf_{c}") for c, v in clean.items())).first()
    for c in columns:
        if row[c] is None:
            raise ValueError(f"feature {c} has no values")
        if row[f"inf_{c}"]:
            raise ValueError(f"feature {c} has infinite values")
    return df.withColumns({c: F.coalesce(clean[c], F.lit(row[c])) for c in columns})


def select_features(df: DataFrame, windows: list[str] | None = None) -> list[str]:
    """Feature columns, counts excluded, of the given window labels (all by default)."""
    found = [c for c in df.columns if c == "beta" or any(c.endswith(f"_{s}") for s in SUFFIXES[:-1]) and (windows is None or c.rsplit("_", 2 if c.endswith(("avg_meth", "_pct")) else 1)[0] in windows)]
    if not found:
        raise ValueError("no feature columns")
    return found
