"""Configuration bundles: a YAML file of every setting, with models and tables beside it under relative paths.

All paths are Hadoop paths, so that a bundle lies in any store that the executors share.
"""

from __future__ import annotations

import dataclasses
import posixpath

import yaml
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from cpgdomains.operators.cluster import ClusterModel
from cpgdomains.plans.pipeline import Segmenter, Settings
from cpgdomains.schema import Resolution, StateCutoffs
from cpgdomains.sources.shared import exists, read_text, write_text

VERSION = 1


def save(spark: SparkSession, segmenter: Segmenter, folder: str, name: str = "segmenter", artifacts: str | None = None, learned: bool = True) -> str:
    """Write ``<name>.yaml`` below ``folder`` and its models and tables below ``artifacts`` (a folder; ``<name>_artifacts`` beside the
    YAML file by default), unless ``learned`` is false; a restored run equals this one. The YAML file's path."""
    path = posixpath.join(folder, f"{name}.yaml")
    top = artifacts or f"{name}_artifacts"
    settings = dataclasses.asdict(segmenter.settings) | {"cutoffs": None}
    settings["windows"] = [list(w) for w in segmenter.settings.windows]
    doc: dict = {"version": VERSION, "settings": settings, "out_dir": segmenter.out_dir, "state_cutoffs": segmenter.settings.cutoffs.to_mapping() if segmenter.settings.cutoffs else None, "artifacts": {}}
    if learned and (m := segmenter.model):
        at = posixpath.join(top, "kmeans")
        m.pipeline.write().overwrite().save(resolve(path, at))
        doc["kmeans"] = {"features": m.features, "medians": m.medians, "means": m.means, "scales": m.scales, "space": m.space, "cost": m.cost}
        doc["artifacts"]["kmeans"] = relative(path, at)
    for key, table in (("summary", segmenter.summary), ("training", segmenter.training)) if learned else ():
        if table is not None:
            at = posixpath.join(top, key)
            table.write.mode("overwrite").parquet(resolve(path, at))
            doc["artifacts"][key] = relative(path, at)
    return write_text(spark, path, yaml.safe_dump(doc, sort_keys=False))


def _absolute(path: str) -> bool:
    return "://" in path or path.startswith(("/", "file:"))


def resolve(base: str, path: str) -> str:
    """An artifact's place: as it is if absolute, else below the configuration file's folder."""
    return path if _absolute(path) else posixpath.join(posixpath.dirname(base), path)


def relative(base: str, path: str) -> str:
    """The path as it is kept: relative to the configuration file's folder if it lies below, so that both can be moved together."""
    top = posixpath.dirname(base).rstrip("/") + "/"
    return path[len(top) :] if path.startswith(top) else path


def relocate(spark: SparkSession, path: str, old: str, new: str) -> str:
    """Artifacts that moved from folder ``old`` to ``new``: the configuration file is written anew with their paths."""
    doc = yaml.safe_load(read_text(spark, path))
    top = resolve(path, old).rstrip("/") + "/"
    doc["artifacts"] = {k: relative(path, posixpath.join(resolve(path, new), r[len(top) :])) if (r := resolve(path, v)).startswith(top) else v for k, v in doc["artifacts"].items()}
    return write_text(spark, path, yaml.safe_dump(doc, sort_keys=False))


def load(spark: SparkSession, path: str, learned: bool = True) -> Segmenter:
    """A bundle's segmenter; with ``learned`` its models and tables too."""
    doc = yaml.safe_load(read_text(spark, path))
    known = {f.name for f in dataclasses.fields(Settings)}
    settings = {k: v for k, v in doc["settings"].items() if k in known}
    settings["windows"] = [tuple(w) for w in settings["windows"]]
    settings["cutoffs"] = StateCutoffs.from_mapping(doc["state_cutoffs"]) if doc.get("state_cutoffs") else None
    out = Segmenter(Settings(**settings), out_dir=doc.get("out_dir"))
    at = {k: resolve(path, v) for k, v in doc.get("artifacts", {}).items()} if learned else {}
    if (k := doc.get("kmeans")) and "kmeans" in at:
        out.model = ClusterModel(k["features"], k["medians"], k["means"], k["scales"], PipelineModel.load(at["kmeans"]), k["space"], k["cost"])
    if "summary" in at:
        out.summary = spark.read.parquet(at["summary"])
    if "training" in at:
        out.training = spark.read.parquet(at["training"])
    return out


def cutoffs_from_yaml(spark: SparkSession, path: str) -> StateCutoffs:
    """The rule cutoffs of a configuration file, whether they stand alone or among its settings."""
    doc = yaml.safe_load(read_text(spark, path)) or {}
    if "state_cutoffs" in doc and doc["state_cutoffs"] is None:
        raise ValueError(f"{path} has no state cutoffs")
    return StateCutoffs.from_mapping(doc)


def pretrained(spark: SparkSession, folder: str, resolution: str) -> Segmenter:
    """The bundle named after a resolution in a folder of bundles."""
    path = posixpath.join(folder, f"{Resolution(resolution).value}.yaml")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return load(spark, path)
