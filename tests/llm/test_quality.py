import os
import zlib

import numpy as np
import pytest

from cpgdomains.llm.quality import LEAST, calibrate, dictionaries, dictionary, is_held_out, score_quality, train

from .data import ODD, docs


def corpus(n=400):
    rng = np.random.default_rng(1)
    words = ["river", "stone", "quiet", "morning", "letter", "garden", "winter", "bread"]
    good = [(i, ". ".join(" ".join(rng.choice(words, 8)) for _ in range(6))) for i in range(n)]
    bad = [(n + i, " ".join(w.upper() + "!!" for w in rng.choice(words, 40))) for i in range(n)]
    return good, bad


def test_learns_and_leaves_the_held_out_fifth_alone(spark):
    good, bad = corpus()
    table = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = train(table, labels)
    flipped = spark.createDataFrame([(i, (q if zlib.crc32(str(i).encode()) % 5 else 1 - q)) for i, q in [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad]], "doc_id long, quality int")
    assert train(table, flipped) == model
    found = score_quality(table.withColumn("held_out", is_held_out(table["doc_id"])), model, keep=("doc_id", "held_out")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    right = [r.predicted == (r.doc_id < len(good)) for r in found if r.held_out]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert all((r.score >= 0.3) == r.predicted for r in found)


def test_odd_rows_all_have_scores(spark):
    good, bad = corpus(50)
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(100)], "doc_id long, quality int")
    model = train(docs(spark, good + bad), labels)
    rows = score_quality(docs(spark, ODD), model, keep=("doc_id", "text", "h")).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(docs(spark, []), model).count() == 0


def test_without_labels_or_with_one_class(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs(spark, ODD), train(docs(spark, ODD), none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(1, 13)], "doc_id long, quality int")
    assert all(r.score >= 0.5 for r in score_quality(docs(spark, ODD), train(docs(spark, ODD), ones)).collect())


def test_few_texts_are_their_own_dictionary():
    assert dictionary([b"abc"], 100) == b"abc"


def test_calibration_orders_scores():
    x = np.c_[np.linspace(-1, 1, 50), np.zeros(50), np.ones(50)]
    w, _, _ = calibrate(x, (x[:, 0] > 0.1).astype(float))
    assert w[1] > 0


def test_a_small_sample_is_used_whole_and_both_labels_alike():
    few = [b"%06d" % i + b" some bad text " * 60 for i in range(100)]
    many = [b"%06d" % i + b" some good text " * 60 for i in range(400)]
    assert 4 * LEAST < sum(map(len, few)) < 24 * LEAST < sum(map(len, many))
    assert dictionary(few, 1 << 16) == b"".join(few)
    assert dictionaries(many, few, 1 << 16) == (b"".join(many), b"".join(few))
    assert dictionaries([], few, 1 << 16) == (b"", b"".join(few)) and dictionaries([], [], 1 << 16) == (b"", b"")


def test_sampled_bytes_are_bounded(spark):
    good, bad = corpus(60)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    model = train(docs(spark, [*good[1:], (0, "long text " * 100_000), *bad]), labels, sample_bytes=4000)
    assert 0 < len(model.good) <= 4000 and 0 < len(model.bad) <= 4000


@pytest.mark.parametrize("name", ["sf0.01"])
def test_held_out_accuracy_on_the_test_tables(spark, name):
    """Labels of a fifth that the fit never sees, at the query's threshold."""
    folder = f"/root/testdata/{name}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    table, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(table.withColumn("held_out", is_held_out(table["doc_id"])), train(table, labels), keep=("doc_id", "held_out"))
    found = scored.where("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert len(found) > 50 and np.mean([r.quality == r.predicted for r in found]) > 0.95
