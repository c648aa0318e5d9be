"""Compression classifier: how much better does a dictionary of good text compress a text than one of bad text?

Two zstandard dictionaries are trained from bounded samples of labelled text; if either label's sample holds under 24 * ``LEAST``
bytes (192 KB), or training is refused, the whole samples are both labels' dictionaries as they are. The difference of the compressed sizes,
divided by the plainly compressed size, is calibrated by a logistic regression on other labelled rows; the ratio of
plain compression and the logarithm of the length say how much the difference is worth. Scoring reads each row once, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import named, text_bytes

LEVEL = 3
#: Bytes of a trained dictionary at least.
LEAST = 8 << 10


@dataclass(frozen=True)
class Model:
    """Dictionaries (empty: none) and the calibration: score = logistic(weights . (1, scaled features))."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.means)) / np.array(self.scales)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ np.array(self.weights[1:]), -700, 700)))


class Measure:
    """The features of a text's bytes."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.good, self.bad = (self._with(d) for d in (good, bad))

    @staticmethod
    def _with(content: bytes) -> zstandard.ZstdCompressor:
        if not content:
            return zstandard.ZstdCompressor(level=LEVEL)
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)

    def __call__(self, text: bytes) -> tuple[float, float, float]:
        plain, good, bad = (len(c.compress(text)) for c in (self.plain, self.good, self.bad))
        return (bad - good) / plain, plain / (len(text) + 16), math.log(len(text) + 16)


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary of at most ``size`` bytes and a 24th of the texts, as training on less gives a stunted one; of few texts all their bytes."""
    size = min(size, sum(map(len, texts)) // 24)
    if size >= LEAST:
        try:
            return zstandard.train_dictionary(size, texts).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(texts)


def dictionaries(good: list[bytes], bad: list[bytes], size: int) -> tuple[bytes, bytes]:
    """Both trained, of one size at most as a larger one helps any text, or both their samples' own bytes. No texts: empty."""
    size = min(size, *(sum(map(len, t)) // 24 for t in (good, bad) if t)) if good or bad else size
    made = [dictionary(t, size) for t in (good, bad)]
    whole = [b"".join(t) for t in (good, bad)]
    return tuple(whole if any(t and d == w for t, d, w in zip((good, bad), made, whole, strict=True)) else made)


def calibrate(features: np.ndarray, labels: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """(weights, means, scales) by Newton's method with a small ridge; one class alone gives its smoothed share."""
    means, scales = features.mean(axis=0), features.std(axis=0) + 1e-9
    a = np.c_[np.ones(len(features)), (features - means) / scales]
    w = np.zeros(a.shape[1])
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        w[0] = math.log(share / (1 - share))
        return tuple(w), tuple(means), tuple(scales)
    ridge = np.diag([1e-6] + [1e-2] * features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - labels) + ridge @ w)
        w -= step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w), tuple(means), tuple(scales)


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id's text divides by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _measured(good: bytes, bad: bytes):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(good, bad)
        for batch in batches:
            rows = [measure(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["label"], *(pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3))], names=["label", "difference", "ratio", "length"])

    return f


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1000, calibration: int = 6000, size: int = 1 << 16, sample_bytes: int = 32 << 20) -> Model:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, rows of ``is_held_out`` excluded.

    Bounds: ``per_label`` texts of each label build the dictionaries (trained, or all of their bytes where a label's are few: see
    ``dictionaries``) and come to the driver, whole texts of ``sample_bytes`` a label at most (those that would pass it are left
    out); features of at most ``calibration`` other rows fit the calibration. Both are the first in hash order of the id. Of several
    labels of an id the largest counts. Without labelled rows every score is 0.5. Null texts count as empty.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("label"))
    dealt = usable.withColumn("h", F.xxhash64("doc_id", F.lit(6)))
    # a quarter of the hash space is for calibration alone, so that it sees texts that no dictionary holds
    inside, rest = (dealt.where((F.pmod("h", F.lit(4)) == 0) == x) for x in (False, True))
    first = [r for label in (0, 1) for r in inside.where(F.col("label") == label).orderBy("h", "doc_id").select("doc_id", "label").limit(per_label).collect()]
    second = rest.orderBy("h", "doc_id").select("doc_id", "label").limit(calibration).collect()
    spark = docs.sparkSession
    schema = "doc_id long, label int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    # both lists are bounded by the parameters, so the joins' small sides are too
    sample = rows.join(F.broadcast(spark.createDataFrame(first, schema)), "doc_id").withColumn("n", F.octet_length("text"))
    # a row per sampled id: an id's rows are as long as they are together
    room, chosen = {0: sample_bytes, 1: sample_bytes}, []
    for r in sample.groupBy("doc_id", "label").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").collect():
        if r["n"] <= room[r["label"]]:
            room[r["label"]] -= r["n"]
            chosen.append((r["doc_id"], r["label"]))
    for r in rows.join(F.broadcast(spark.createDataFrame(chosen, schema)), "doc_id").select("label", "text").sort("doc_id", "text").collect():
        texts[r["label"]].append(bytes(r["text"]))
    good, bad = dictionaries(texts[1], texts[0], size)
    sample = rows.join(F.broadcast(spark.createDataFrame(second, schema)), "doc_id").select("label", "text").mapInArrow(_measured(good, bad), "label int, difference double, ratio double, length double").collect()
    if not sample:
        return Model(good, bad, (0.0,) * 4, (0.0,) * 3, (1.0,) * 3)
    sample.sort()
    return Model(good, bad, *calibrate(np.array([r[1:] for r in sample]), np.array([r[0] for r in sample], dtype=np.float64)))


def _scored(model: Model, threshold: float, text: str, keep: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.good, model.bad)
        for batch in batches:
            features = np.array([measure(t or b"") for t in batch[text].cast(pa.binary()).to_pylist()]).reshape(-1, 3)
            score = model.scores(features)
            names = [n for n in batch.schema.names if keep or n != text]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[*names, "score", "predicted"])

    return f


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row (none may be called score or predicted), score (0 to 1, higher: label 1 likelier) of the
    column ``text`` and predicted (1 from ``threshold`` on).

    Null text counts as empty, which has a score too. Every row is scored, also with equal or null ids. Empty table: no rows.
    """
    kept = docs.select(*named(list(keep)))
    rows = docs.select(*named([*keep, *([text] if text not in keep else [])]))
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(_scored(model, threshold, text, text in keep), schema)
