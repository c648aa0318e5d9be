"""Agreement of two labellings and quality of clusters, from contingency tables and centroids."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Counts by pair of labels."""
    return df.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))


def agreement_of(counts: DataFrame, true: str, pred: str, keys: list[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted F1, macro precision and recall (0 where undefined), ARI and NMI per ``keys``.

    ``counts``: label pairs with column n. Labels are those that either side has.
    """
    keys = list(keys)
    if not keys:
        return agreement_of(counts.withColumn("all", F.lit(0)), true, pred, ["all"]).drop("all")
    base = counts.select(*keys, F.col(true).cast("string").alias("t"), F.col(pred).cast("string").alias("p"), F.col("n").cast("double").alias("n"))
    truths = base.groupBy(*keys, F.col("t").alias("label")).agg(F.sum("n").alias("n_true"))
    preds = base.groupBy(*keys, F.col("p").alias("label")).agg(F.sum("n").alias("n_pred"))
    hits = base.where("t = p").select(*keys, F.col("t").alias("label"), F.col("n").alias("tp"))
    per = reduce(lambda a, b: a.join(b, [*keys, "label"], "full_outer"), [truths, preds, hits]).fillna(0.0)
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, t, p = (F.col(c) for c in ("tp", "n_true", "n_pred"))
    per = per.withColumns({"precision": over(tp, p), "recall": over(tp, t), "f1": over(2 * tp, t + p)})
    pairs = lambda c: c * (c - 1) / 2
    xlogx = lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)
    total: Column = F.sum("n_true")
    labels = per.groupBy(*keys).agg(
        total.alias("total"), (F.sum("tp") / total).alias("accuracy"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * t) / total).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.sum(pairs(t)).alias("pairs_true"), F.sum(pairs(p)).alias("pairs_pred"), F.sum(xlogx(t)).alias("log_true"), F.sum(xlogx(p)).alias("log_pred"),
    )
    cells = base.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("pairs_both"), F.sum(xlogx(F.col("n"))).alias("log_both"))
    joined = labels.join(cells, keys)
    n = F.col("total")
    expected = F.col("pairs_true") * F.col("pairs_pred") / F.greatest(pairs(n), F.lit(1.0))
    best = (F.col("pairs_true") + F.col("pairs_pred")) / 2
    h_true, h_pred = F.log(n) - F.col("log_true") / n, F.log(n) - F.col("log_pred") / n
    mutual = F.log(n) + (F.col("log_both") - F.col("log_true") - F.col("log_pred")) / n
    mean = (h_true + h_pred) / 2
    return joined.select(
        *keys, "accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro",
        F.when(F.abs(best - expected) < 1e-12, 1.0).otherwise((F.col("pairs_both") - expected) / (best - expected)).alias("ari"),
        F.when(mean < 1e-12, 1.0).otherwise(F.greatest(mutual, F.lit(0.0)) / mean).alias("nmi"),
    )


def agreement(df: DataFrame, true: str, pred: str) -> DataFrame:
    return agreement_of(confusion(df, true, pred), true, pred)


def report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Per label: precision, recall, f1 and support."""
    counts = confusion(df, true, pred)
    t = counts.groupBy(F.col(true).alias("label")).agg(F.sum("n").alias("support"))
    p = counts.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("predicted"))
    h = counts.where(F.col(true) == F.col(pred)).select(F.col(true).alias("label"), F.col("n").alias("hits"))
    both = t.join(p, "label", "full_outer").join(h, "label", "left").fillna(0)
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.select("label", over("hits", "predicted").alias("precision"), over("hits", "support").alias("recall"), F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("hits") / (F.col("support") + F.col("predicted"))).otherwise(0.0).alias("f1"), "support")


def davies_bouldin(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row, davies_bouldin: mean over clusters of the worst (spread + spread) / distance of centroids; null below two clusters."""
    centres = df.groupBy(label).agg(*(F.avg(f).alias(f"c_{f}") for f in features))
    squared = sum(((F.col(f) - F.col(f"c_{f}")) ** 2 for f in features), F.lit(0.0))
    spread = df.join(centres, label).groupBy(label).agg(F.avg(F.sqrt(squared)).alias("spread"), *(F.first(f"c_{f}").alias(f"c_{f}") for f in features))
    a, b = spread.alias("a"), spread.alias("b")
    gap = F.sqrt(sum(((F.col(f"a.c_{f}") - F.col(f"b.c_{f}")) ** 2 for f in features), F.lit(0.0)))
    ratio = (F.col("a.spread") + F.col("b.spread")) / F.when(gap > 0, gap)
    # clusters against clusters: a handful of rows each
    worst = a.join(b, F.col(f"a.{label}") != F.col(f"b.{label}")).groupBy(F.col(f"a.{label}")).agg(F.max(ratio).alias("worst"))
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def silhouette(df: DataFrame, features: list[str], label: str, most: int = 5000, seed: int = 42, keys: list[str] | None = None) -> float | None:
    """Mean Euclidean silhouette over at most ``most`` rows (a sampling operator); None if it isn't defined.

    Rows are drawn in order of a hash of the columns ``keys``, or of the features.
    """
    by = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in keys or features)))
    rows = df.select(label, *features, by.alias("by")).orderBy("by", *features).limit(most).toPandas()
    x, labels = rows[features].to_numpy(float), rows[label].to_numpy()
    kinds = np.unique(labels)
    if len(x) < 2 or len(kinds) < 2 or len(kinds) >= len(x):
        return None
    member = (labels[:, None] == kinds[None, :]).astype(float)
    sizes, own = member.sum(axis=0), member.argmax(axis=1)
    scores = []
    for i in range(0, len(x), 512):
        d = np.sqrt(np.maximum(((x[i : i + 512, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0))
        sums, k = d @ member, own[i : i + 512]
        at = np.arange(len(k))
        alone = sizes[k] == 1
        a = sums[at, k] / np.maximum(sizes[k] - 1, 1)
        means = sums / sizes
        means[at, k] = np.inf
        b = means.min(axis=1)
        scores.append(np.where(alone, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)))
    return float(np.concatenate(scores).mean())


def histogram(df: DataFrame, feature: str, label: str, bins: int = 50) -> DataFrame:
    """label, bin (0 on), lower, upper, n: equal widths between each label's own smallest and largest value; empty bins are absent."""
    bounds = df.where(F.col(feature).isNotNull()).groupBy(label).agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    lo, hi = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    bounds = bounds.select(label, lo.alias("lo"), ((hi - lo) / bins).alias("step"))
    placed = df.where(F.col(feature).isNotNull()).join(bounds, label).withColumn("bin", F.least(F.floor((F.col(feature) - F.col("lo")) / F.col("step")), F.lit(bins - 1)))
    counted = placed.groupBy(label, "bin", "lo", "step").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(label, F.col("bin").cast("long").alias("bin"), (F.col("lo") + F.col("bin") * F.col("step")).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("upper"), "n")


def histograms(df: DataFrame, features: list[str], label: str, bins: int = 50) -> DataFrame:
    """``histogram`` of several features in one pass: feature, place (0 on, in the order given), label, bin, lower, upper, n."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)])
    long = df.select(label, F.explode(pairs).alias("p")).select(F.struct("p.place", "p.feature", label).alias("group"), "p.value")
    return histogram(long, "value", "group", bins).select("group.feature", "group.place", f"group.{label}", "bin", "lower", "upper", "n")


def hexagons(df: DataFrame, x: str, y: str, label: str, size: float, least: int = 1) -> DataFrame:
    """Counts per label in hexagonal cells of width ``size``: centre, n; cells of fewer than ``least`` points are absent."""
    height = size * 3**0.5
    near = lambda c, step, shift: (F.floor((F.col(c) - shift) / step + 0.5) * step + shift)
    ax, ay, bx, by = near(x, size, 0.0), near(y, height, 0.0), near(x, size, size / 2), near(y, height, height / 2)
    to = lambda cx, cy: (F.col(x) - cx) ** 2 + (F.col(y) - cy) ** 2
    first = to(ax, ay) <= to(bx, by)
    return df.groupBy(label, F.when(first, ax).otherwise(bx).alias("centre_x"), F.when(first, ay).otherwise(by).alias("centre_y")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
