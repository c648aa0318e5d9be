"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

All but the last return the columns of documents, whatever they are beside doc_id and text, in their order. Decisions, in order:
rows that the quality classifier scores below 0.3 go; of equal texts the row with the largest doc_id stays; of each near-copy
group the one with the smallest doc_id stays; words of windows that an earlier document has go; what remains is packed.

Decisions are about rows, not ids: rows that share a doc_id or have none are judged one by one, by a number that the stage gives
each row. A null text counts as empty everywhere and stays null unless a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgdomains.llm.common import materialise, named, numbered
from cpgdomains.llm.exact_dedup import exact_dedup
from cpgdomains.llm.packing import pack_documents
from cpgdomains.llm.quality import score_quality, train
from cpgdomains.llm.simhash import simhash_dedup
from cpgdomains.llm.substring_dedup import substring_dedup

TOKENIZER = "word_bpe_49k.json"

#: The first stage's classifier and the tokenizer's ids can't be expressed in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier predicts as label 1, learned from ``labels`` outside the held-out fifth.

    Each row is judged by its whole text alone: empty and null texts have a score too, equal texts share it, equal or null
    doc_ids don't matter. Without labelled rows every score is 0.5, so all rows stay. Empty table: no rows.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = {f"c{i}": c for i, c in enumerate(docs.columns)}  # whatever they are called
    rows = docs.select(*(c.alias(k) for k, c in zip(own, named(docs.columns), strict=True)))
    scored = score_quality(rows, model, keep=tuple(own), text=next(k for k, c in own.items() if c == "text"))
    return scored.where("predicted = 1").select(*(F.col(k).alias(c) for k, c in own.items()))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that with the largest doc_id (null: the smallest); of repeated rows one.

    Null and empty texts equal each other. Texts of any length. Empty table: no rows.
    """
    rows, key = numbered(docs, "exact")
    gone = exact_dedup(rows, row=key).where(~F.col("kept")).select(key)
    return rows.join(gone, key, "left_anti").select(*named(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (null: the smallest) stays, of equal ids one.

    Texts link where their five-word shingles have a similarity of 0.8 or more, however many bits of their fingerprints differ: most are
    found by fingerprints, all others by an exact search. Texts of one fingerprint are one group, so of empty texts and null ones a
    single row stays. Empty table: no rows.
    """
    rows, key = numbered(docs, "near")
    gone = simhash_dedup(rows, similar=0.8, row=key, beyond=True).where(~F.col("first")).select(key)
    return rows.join(gone, key, "left_anti").select(*named(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window that a document with a smaller doc_id has too go; no row goes.

    A text that loses words is what is left of them, joined by single spaces, and n_chars, if there is such a column, follows it; all
    others stay as they are. Rows that share a doc_id, or have none, take nothing from each other; those without one come first.
    Empty table: no rows.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = substring_dedup(docs, texts=True, carry=rest)
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carried")["n_chars"]) if "n_chars" in rest else None}
    return found.select(*(new[c].alias(c) if c in new else F.col("doc_id") if c == "doc_id" else F.col("carried")[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, with their places in sequences; each row is a document of its own, whatever its doc_id.

    An empty or null text is its end token alone. A text longer than a sequence is cut. Empty table: no rows.
    """
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("exact_dedup", exact_duplicates), ("simhash_near_dedup", near_duplicates), ("substring_dedup", repeated_passages), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
