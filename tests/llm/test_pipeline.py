import os
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from cpgdomains.llm.common import numbered

from .data import ODD, PASSAGE, docs

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_on_odd_rows(spark, tmp_path):
    table = docs(spark, ODD + [(40 + i, f"plain text number {i}") for i in range(20)])
    spark.createDataFrame([(i, 1) for i in range(40, 60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = table
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, rows, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == table.columns, name
            rows.write.parquet(f"{tmp_path}/{k}")
            rows = spark.read.parquet(f"{tmp_path}/{k}")
    ids = {r.doc_id for r in rows.collect()}
    assert {4, 9, None} <= ids and not {3, 5, 7} & ids  # 4 differs from 7 in case only, which fingerprints ignore
    assert not {6, 8} & ids  # their shingles are nearly those of a row without an id, which comes first


def test_run_is_the_stages_in_turn(spark, tmp_path):
    docs(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("start = 0").count() > 5


def test_near_copies_go_and_first_stays(spark, tmp_path):
    base = [f"w{i}" for i in range(2000)]
    near = " ".join([*base[:1000], "other", *base[1001:]])
    rows = docs(spark, [(3, " ".join(base)), (1, near), (2, "something else entirely")])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()) == [1, 2]


def pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_exact_stage_judges_rows_not_ids(spark):
    rows = docs(spark, [(5, "a b"), (7, "a b"), (5, "unique text here"), (9, "dup x"), (9, "dup x"), (None, "n n"), (None, "n n"), (None, "a b"), (3, None), (4, "")])
    kept = corpus_pipeline.exact_duplicates(spark, rows, "")
    assert kept.columns == rows.columns
    assert pairs(kept) == sorted([(7, "a b"), (5, "unique text here"), (9, "dup x"), (None, "n n"), (4, "")], key=str)


def test_near_stage_judges_rows_not_ids(spark):
    base = [f"w{i}" for i in range(500)]
    near = " ".join([*base[:250], "other", *base[251:]])
    rows = docs(spark, [(5, " ".join(base)), (6, near), (6, "something else entirely"), (None, "n n"), (None, "n n"), (8, None), (9, "")])
    kept = corpus_pipeline.near_duplicates(spark, rows, "")
    assert kept.columns == rows.columns
    assert pairs(kept) == sorted([(5, " ".join(base)), (6, "something else entirely"), (None, "n n"), (8, None)], key=str)


def test_stages_keep_other_columns_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "score double, doc_id long, `a.b` string, text string, predicted int, kept string, row_number long"
    own = " ".join(f"own{i}" for i in range(30))
    table = spark.createDataFrame([(0.5, 1, "x", f"p {PASSAGE}", 7, "k", 3), (0.1, 2, "y", f"{own} {PASSAGE}", 8, "l", 4), (0.2, 3, "z", None, 9, "m", 5)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        assert sorted(tuple(r)[4:] for r in out.collect()) == [(7, "k", 3), (8, "l", 4), (9, "m", 5)], name
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.pack(spark, table.limit(0), "").count() == 0
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, table, "").collect()}
    assert cut == {1: f"p {PASSAGE}", 2: own, 3: None}


def test_rows_of_files_are_numbered_by_their_place(spark, tmp_path):
    spark.range(500).withColumn("row_number", F.lit("own")).repartition(5).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    rows, key = numbered(table, "x")
    assert key not in table.columns and rows.columns == [*table.columns, key]
    first = {r.id: r[key] for r in rows.collect()}
    assert len(set(first.values())) == 500
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert {r.id: r[key] for r in numbered(table, "x")[0].select("id", key).collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    again, key = numbered(table.groupBy("id").count(), "x")  # no files behind it
    assert again.select(key).distinct().count() == 500


def test_nothing_else_imports_the_subpackage():
    code = "import sys, pkgutil, importlib, cpgdomains\nfor m in pkgutil.walk_packages(cpgdomains.__path__, 'cpgdomains.'):\n    if not m.name.startswith('cpgdomains.llm'): importlib.import_module(m.name)\nassert not [m for m in sys.modules if m.startswith('cpgdomains.llm.')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
