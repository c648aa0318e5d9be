"""Labels by threshold rules, and the random search for thresholds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cpgdomains.functions.states import state_code
from cpgdomains.operators.metrics import agreement_of
from cpgdomains.schema import STATES, StateCutoffs, WindowCutoffs


def rule_state(cutoffs: StateCutoffs) -> Column:
    """PMD if any window's four bounds hold and beta lies between the cutoffs; else LOW, HIGH or INTERMEDIATE by beta."""
    if not cutoffs.windows:
        raise ValueError("no window cutoffs are set")
    beta = F.col("beta")
    any_window = F.lit(False)
    for w, c in cutoffs.windows.items():
        any_window = any_window | ((F.col(f"{w}_int_pct") >= c.int_min) & (F.col(f"{w}_std") <= c.std_max) & (F.col(f"{w}_high_pct") <= c.high_max) & (F.col(f"{w}_low_pct") <= c.low))
    pmd = F.coalesce(any_window, F.lit(False)) & (beta >= cutoffs.beta_low_max) & (beta <= cutoffs.beta_high_min)
    return F.when(pmd, "PMD").when(beta <= cutoffs.beta_low_max, "LOW").when((beta >= cutoffs.beta_high_min) & ~F.isnan(beta), "HIGH").otherwise("INTERMEDIATE")


def label_by_rules(emissions: DataFrame, cutoffs: StateCutoffs, column: str = "state") -> DataFrame:
    missing = [f"{w}_{s}" for w in cutoffs.windows for s in ("int_pct", "std", "high_pct", "low_pct") if f"{w}_{s}" not in emissions.columns]
    if missing:
        raise KeyError(f"emissions lack {missing}")
    return emissions.withColumn(column, rule_state(cutoffs))


#: Ranges that the search draws from.
RANGES = {"beta_low_max": (0.05, 0.35), "beta_high_min": (0.60, 0.95), "int_min": (0.40, 0.90), "std_max": (0.10, 0.40), "high_max": (0.05, 0.40), "low_max": (0.05, 0.40)}


def draw_trials(windows: list[str], n: int = 500, seed: int = 42, ranges: dict[str, tuple[float, float]] | None = None) -> list[StateCutoffs]:
    """``n`` uniform draws; the two beta bounds of a draw are drawn anew until the low one is below the high one."""
    r, rng = RANGES | (ranges or {}), np.random.default_rng(seed)
    lows, highs = r["beta_low_max"], r["beta_high_min"]
    if lows[0] >= highs[1]:
        raise ValueError("no low bound lies below a high bound")
    out = []
    while len(out) < n:
        low, high = float(rng.uniform(*lows)), float(rng.uniform(*highs))
        if low < high:
            out.append(StateCutoffs({w: WindowCutoffs(*(float(rng.uniform(*r[k])) for k in ("int_min", "std_max", "high_max", "low_max"))) for w in windows}, low, high))
    return out


@dataclass(frozen=True)
class SearchResult:
    """``history``: scores and cutoffs of every trial; ``summary``: those of the best one; ``labelled``: the rows with its labels."""

    best: StateCutoffs
    best_trial: int
    history: DataFrame
    contingency: DataFrame
    summary: DataFrame
    labelled: DataFrame


def flat(cutoffs: StateCutoffs) -> dict[str, float]:
    """Cutoffs as columns of one row."""
    cells = {f"{w}_{k}": v for w, c in cutoffs.windows.items() for k, v in (("int_min", c.int_min), ("std_max", c.std_max), ("high_max", c.high_max), ("low_max", c.low))}
    return {"beta_low_max": cutoffs.beta_low_max, "beta_high_min": cutoffs.beta_high_min} | cells


def trial_contingency(labelled: DataFrame, truth: str, trials: list[StateCutoffs]) -> DataFrame:
    """trial, true, pred, n: each partition counts all trials over its batches, so a trial costs one row per pair of states."""
    windows = list(trials[0].windows)
    needed = ["beta", *(f"{w}_{s}" for w in windows for s in ("int_pct", "std", "high_pct", "low_pct"))]
    table = np.array([[t.beta_low_max, t.beta_high_min, *(v for w in windows for v in (t.windows[w].int_min, t.windows[w].std_max, t.windows[w].high_max, t.windows[w].low))] for t in trials])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(table), 16), dtype=np.int64)
        for b in batches:
            beta, true = b["beta"].to_numpy(), b["true"].to_numpy(np.int64)
            for k, row in enumerate(table):
                pmd = np.zeros(len(b), dtype=bool)
                for i, w in enumerate(windows):
                    im, sm, hm, lm = row[2 + 4 * i : 6 + 4 * i]
                    pmd |= (b[f"{w}_int_pct"].to_numpy() >= im) & (b[f"{w}_std"].to_numpy() <= sm) & (b[f"{w}_high_pct"].to_numpy() <= hm) & (b[f"{w}_low_pct"].to_numpy() <= lm)
                pmd &= (beta >= row[0]) & (beta <= row[1])
                pred = np.where(pmd, 1, np.where(beta <= row[0], 0, np.where(beta >= row[1], 3, 2)))
                total[k] += np.bincount(true * 4 + pred, minlength=16)
        k, cell = np.nonzero(total)
        yield pd.DataFrame({"trial": k, "true": cell // 4, "pred": cell % 4, "n": total[k, cell]})

    rows = labelled.select(state_code(truth).alias("true"), *needed).where("true IS NOT NULL")
    return rows.mapInPandas(count, "trial long, true long, pred long, n long").groupBy("trial", "true", "pred").agg(F.sum("n").alias("n"))


def search_rules(
    labelled: DataFrame, truth: str, windows: list[str], n_iter: int = 500, seed: int = 42, ranges: dict | None = None, trials: list[StateCutoffs] | None = None, score: str = "f1_macro",
) -> SearchResult:
    """The draw (or the one of ``trials``) with the best ``score`` against the labels in ``truth``; the first of equals wins."""
    trials = draw_trials(windows, n_iter, seed, ranges) if trials is None else trials
    if not trials:
        raise ValueError("there are no trials")
    spark = labelled.sparkSession
    # at most n_iter * 16 rows, whatever the input's size
    counted = spark.createDataFrame(trial_contingency(labelled, truth, trials).toPandas(), "trial long, true long, pred long, n long")
    rows = [{"trial": k} | flat(t) for k, t in enumerate(trials)]
    drawn = spark.createDataFrame([tuple(x.values()) for x in rows], "trial long, " + ", ".join(f"`{c}` double" for c in list(rows[0])[1:]))
    history = agreement_of(counted, "true", "pred", ["trial"]).join(drawn, "trial")
    best = history.orderBy(F.desc(score), "trial").first()
    if best is None:
        raise ValueError("no labelled rows")
    own = trials[best["trial"]]
    summary = history.where(F.col("trial") == best["trial"]).select(*list(rows[0])[1:], *(c for c in history.columns if c not in rows[0]))
    return SearchResult(own, best["trial"], history, counted, summary, label_by_rules(labelled, own, "rule_based_label"))


def prevalence(labelled: DataFrame, column: str = "state") -> DataFrame:
    """Count of each state, absent ones too."""
    spark = labelled.sparkSession
    wanted = spark.createDataFrame([(s,) for s in STATES], f"{column} string")
    return wanted.join(labelled.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").fillna(0, ["n"])
