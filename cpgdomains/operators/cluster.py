"""Labels by clustering: feature pipeline, KMeans with restarts, and the assignment of clusters to states."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import permutations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cpgdomains.schema import STATES

MIN_FRACTION = 0.001
#: KMeans starts that run at once.
AT_ONCE = 4


@dataclass
class ClusterModel:
    """Everything that scoring needs; ``pipeline`` assembles z-scores, projects them and assigns the nearest centre."""

    features: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    pipeline: PipelineModel | None
    space: str
    cost: float

    def scaled(self, df: DataFrame) -> DataFrame:
        def z(c: str) -> Column:
            value = F.when(~F.isnan(c), F.col(c))
            if c in self.medians:
                value = F.coalesce(value, F.lit(self.medians[c]))
            return F.lit(0.0) if not self.scales[c] else (value - F.lit(self.means[c])) / F.lit(self.scales[c])

        if missing := [c for c in self.features if c not in df.columns]:
            raise KeyError(f"features {missing} are missing")
        return df.withColumns({f"z_{c}": z(c) for c in self.features})

    def centres(self) -> list[np.ndarray]:
        return self.pipeline.stages[-1].clusterCenters()

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds ``scores`` (coordinates in the model's space), ``distances`` to each centre and ``cluster``."""
        out = self.pipeline.transform(self.scaled(df)).withColumn("scores", vector_to_array("space"))
        gaps = [F.sqrt(sum(((F.col("scores")[i] - F.lit(float(v))) ** 2 for i, v in enumerate(c)), F.lit(0.0))) for c in self.centres()]
        return out.withColumn("distances", F.array(*gaps)).drop("z", "space", *(f"z_{c}" for c in self.features))

    def loadings(self, df: DataFrame) -> DataFrame:
        """feature, component (PC1 on), loading; each component's largest loading is positive."""
        m = self.pca.pc.toArray()
        m = m * np.sign(m[np.abs(m).argmax(axis=0), np.arange(m.shape[1])])
        rows = [(f, f"PC{k + 1}", float(m[i, k])) for i, f in enumerate(self.features) for k in range(m.shape[1])]
        return df.sparkSession.createDataFrame(rows, "feature string, component string, loading double")

    @property
    def pca(self):
        if self.space != "pca":
            raise ValueError("the model has no PCA")
        return self.pipeline.stages[1]

    def explained_variance(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame([(f"PC{k + 1}", float(v)) for k, v in enumerate(self.pca.explainedVariance)], "component string, ratio double")


def top_loadings(loadings: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest loadings by size of each component."""
    from pyspark.sql import Window

    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return loadings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ranked_features(loadings: DataFrame, component: str = "PC2") -> list[str]:
    """Features by the size of their loading on a component, largest first, but beta before all others."""
    rows = loadings.where(F.col("component") == component).orderBy(F.desc(F.abs("loading")), "feature").select("feature").collect()
    return sorted((r[0] for r in rows), key=lambda c: c != "beta")


def fit(training: DataFrame, features: list[str], n_states: int = 4, space: str = "pca", n_pca: int = 5, restarts: int = 10, seed: int = 42) -> ClusterModel:
    """KMeans over z-scores or their principal components; of ``restarts`` seeds the lowest cost stays. Equal rows are one row of more weight.

    Medians fill nulls only in columns that have some. The z-scores are centred, as PCA's transform isn't.
    """
    if space not in ("pca", "raw"):
        raise ValueError("space must be 'pca' or 'raw'")
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in features}
    training = training.select(*(v.alias(c) for c, v in known.items())).cache()
    try:
        # nulls, infinities and moments in one pass; a median only where a column has gaps
        row = training.agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{k}_{c}") for c in features for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop)))).first()
        gaps = [c for c in features if row[f"n_{c}"] < row["rows"]]
        if empty := [c for c in gaps if not row[f"n_{c}"]]:
            raise ValueError(f"features {empty} have no values")
        if wild := [c for c in features if row[f"m_{c}"] is not None and not np.isfinite(row[f"m_{c}"])]:
            raise ValueError(f"features {wild} have infinite values")
        medians, at = {}, row.asDict()
        if gaps:
            medians = training.agg(*(F.median(c).alias(c) for c in gaps)).first().asDict()
            filled = training.fillna(medians)
            at |= filled.agg(*(f(c).alias(f"{k}_{c}") for c in gaps for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first().asDict()
        means, scales = ({c: at[f"{k}_{c}"] for c in features} for k in ("m", "s"))
        model = ClusterModel(features, medians, means, scales, None, space, 0.0)
        stages = [VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol="z" if space == "pca" else "space")]
        if space == "pca":
            stages.append(PCA(k=min(n_pca, at["rows"], len(features)), inputCol="z", outputCol="space"))
        scaled = model.scaled(training).select(*(f"z_{c}" for c in features))
        front = Pipeline(stages=stages).fit(scaled)
        # rows that are alike are one row with their number as its weight, which costs the starts less and leaves their aim the same
        alike = training.groupBy(*features).agg(F.count(F.lit(1)).cast("double").alias("weight"))
        ready = front.transform(model.scaled(alike)).select("space", "weight").cache()
        try:
            ready.count()
            start = lambda i: KMeans(k=n_states, seed=seed + i, featuresCol="space", predictionCol="cluster", weightCol="weight").fit(ready)
            with ThreadPoolExecutor(AT_ONCE) as pool:
                models = list(pool.map(start, range(restarts)))
        finally:
            ready.unpersist()
    finally:
        training.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    model.pipeline, model.cost = PipelineModel(front.stages + [best]), best.summary.trainingCost
    return model


def nearest_centre(df: DataFrame, centres: list[dict[str, float]]) -> DataFrame:
    """``distances`` to fixed centres over named columns and ``cluster``, the first nearest."""
    gaps = F.array(*[F.sqrt(sum(((F.col(c) - F.lit(v)) ** 2 for c, v in centre.items()), F.lit(0.0))) for centre in centres])
    return df.withColumn("distances", gaps).withColumn("cluster", (F.array_position("distances", F.array_min("distances")) - 1).cast("int"))


def cluster_statistics(df: DataFrame, windows: list[str], label: str = "cluster") -> DataFrame:
    """Per cluster: size, mean beta, and mean over windows of the mean intermediate, high and low share and std."""
    over = lambda s: sum((F.avg(f"{w}_{s}") for w in windows), F.lit(0.0)) / len(windows)
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.avg("beta").alias("beta"), over("int_pct").alias("intermediate"), over("high_pct").alias("high"), over("low_pct").alias("low"), over("std").alias("std"))


def absorption(stats: list[tuple[int, int, float]], least: float = MIN_FRACTION) -> dict[int, int]:
    """(cluster, size, mean beta) rows to {cluster: cluster it counts as}: tiny ones join the large one of nearest beta."""
    total = sum(n for _, n, _ in stats)
    large = sorted((c, b) for c, n, b in stats if n / total >= least)
    return {c: c if n / total >= least else min(large, key=lambda x: (abs(x[1] - b), x[0]))[0] for c, n, b in stats}


def absorb_small(df: DataFrame, label: str = "cluster", least: float = MIN_FRACTION) -> DataFrame:
    stats = [(r[0], r[1], r[2]) for r in df.groupBy(label).agg(F.count(F.lit(1)), F.avg("beta")).collect()]  # a row per cluster
    out = F.col(label)
    for k, v in absorption(stats, least).items():
        if k != v:
            out = F.when(F.col(label) == k, F.lit(v)).otherwise(out)
    return df.withColumn(label, out)


def state_scores(stats: DataFrame, low: float = 0.2, high: float = 0.7) -> DataFrame:
    """Adds a score per state to cluster statistics; the middle score peaks halfway between ``low`` and ``high``."""
    beta, mid, hi, lo, std = (F.col(c) for c in ("beta", "intermediate", "high", "low", "std"))
    middle = F.greatest(F.lit(0.0), 1.0 - F.abs(beta - (low + high) / 2) / (max(high - low, 1e-6) / 2))
    return stats.withColumns({
        "score_LOW": 2.0 * lo + (1.0 - beta) - 0.5 * mid - 0.75 * hi - 0.5 * std,
        "score_PMD": 3.0 * mid + lo - 1.5 * hi - std + middle,
        "score_INTERMEDIATE": 2.0 * mid + hi - lo + middle + std,
        "score_HIGH": 2.0 * hi + beta - 0.5 * mid - 0.75 * lo - 0.5 * std,
    })


def assign(scores: dict[int, tuple[float, ...]]) -> dict[int, str]:
    """{cluster: state}: the choice of distinct states with the largest sum, of equal sums that with the largest scores in
    cluster order, of equal ones the first in order of the states."""
    clusters = sorted(scores)
    if len(clusters) > len(STATES):
        raise ValueError(f"{len(clusters)} clusters can't have distinct states")
    if not clusters:
        return {}
    choices = np.array(list(permutations(range(len(STATES)), len(clusters))))
    gained = np.array([scores[c] for c in clusters])[np.arange(len(clusters)), choices]
    # lexsort is stable and takes its last key first: sums, then the clusters' scores in order, all from the largest down
    ranked = np.lexsort((*(-gained.T[::-1]), -gained.sum(axis=1)))
    return dict(zip(clusters, (STATES[k] for k in choices[ranked[0]].tolist()), strict=True))


def relabel(df: DataFrame, windows: list[str], label: str = "cluster", out: str = "state", low: float = 0.2, high: float = 0.7, by: tuple[str, ...] = ()) -> DataFrame:
    """Biological states of clusters, tiny clusters absorbed first, apart for each value of the columns ``by``.

    One aggregate gives sums per cluster (and value of ``by``); absorbed clusters' sums add up, so that no second pass is needed.
    The table of states joins back, small enough for any plan: a row per cluster and value of ``by``.
    """
    by = list(by)
    names = {"beta": ["beta"], "intermediate": [f"{w}_int_pct" for w in windows], "high": [f"{w}_high_pct" for w in windows], "low": [f"{w}_low_pct" for w in windows], "std": [f"{w}_std" for w in windows]}
    columns = [c for group in names.values() for c in group]
    found: dict[tuple, dict[int, dict]] = {}
    for r in df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("size"), *(F.sum(c).alias(f"s_{c}") for c in columns), *(F.count(c).alias(f"n_{c}") for c in columns)).collect():
        found.setdefault(tuple(r[k] for k in by), {})[r[label]] = r.asDict()
    mean = lambda rows, c: sum(x[f"s_{c}"] or 0.0 for x in rows) / max(1, sum(x[f"n_{c}"] for x in rows))
    stats, joins = [], []
    for number, (key, clusters) in enumerate(found.items()):
        into = absorption([(c, x["size"], mean([x], "beta")) for c, x in clusters.items()])
        joins += [(number, key, c, to) for c, to in into.items()]
        for whole in sorted(set(into.values())):
            rows = [clusters[c] for c, to in into.items() if to == whole]
            stats.append((number, whole, *(sum(mean(rows, c) for c in group) / len(group) for group in names.values())))
    spark = df.sparkSession
    scored = state_scores(spark.createDataFrame(stats, "k int, c int, beta double, intermediate double, high double, low double, std double"), low, high).collect()
    scores: dict[int, dict[int, tuple]] = {}
    for r in scored:
        scores.setdefault(r["k"], {})[r["c"]] = tuple(r[f"score_{s}"] for s in STATES)
    states = {k: assign(v) for k, v in scores.items()}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [StructField(k, kinds[k]) for k in by] + [StructField(label, kinds[label]), StructField("_into", kinds[label]), StructField(out, StringType())]
    table = spark.createDataFrame([(*key, c, to, states[number][to]) for number, key, c, to in joins], StructType(fields))
    return df.drop(out).join(table, [*by, label], "left").withColumn(label, F.col("_into")).drop("_into")
