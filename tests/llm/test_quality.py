import zlib

import numpy as np

from loomline.llm import common, quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.classified(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"), common.work_dir(spark))[0].collect()
    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_scores_against_a_discriminant_computed_apart(spark):
    """Plain numpy formulas (determinants, inverses) on all training rows at once."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = {r.doc_id: r.score for r in quality.classified(docs, labels, common.work_dir(spark))[0].collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    x = {r.doc_id: np.array(quality.statistics(r.text)) for r in docs.collect()}
    train = [d for d in x if d in known and zlib.crc32(str(d).encode()) % 3 != 1]
    classes = [np.array([x[d] for d in train if known[d] == k]) for k in (0, 1)]
    pooled = sum(((c - c.mean(axis=0)) ** 2).sum(axis=0) for c in classes) / (len(train) - 2)

    def density(v, c):
        s = 0.9 * np.cov(c, rowvar=False) + 0.1 * np.diag(np.maximum(pooled, 1e-4))
        z = v - c.mean(axis=0)
        return np.log(len(c) / len(train)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * z @ np.linalg.solve(s, z)

    for d, v in x.items():
        assert abs(got[d] - (0.5 + np.arctan((density(v, classes[1]) - density(v, classes[0])) / 4) / np.pi)) < 1e-6


def test_labels_of_held_out_rows_change_nothing(spark, small):
    docs, labels = common.table(spark, small, "documents"), common.table(spark, small, "labels")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.training_rows(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 6) for r in quality.classified(docs, x, common.work_dir(spark))[0].collect()} for x in (labels, turned))
    assert a == b


def test_odd_documents_and_labels(spark, odd_docs):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (9, 1, None), (13, 0, 0), (None, 0, 0), (4, None, 0), (11, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got, model = quality.classified(odd_docs, labels, common.work_dir(spark))
    assert got.count() == odd_docs.count() and got.filter("score is null or predicted is null or held_out is null").count() == 0
    good = quality.of_good_quality(odd_docs, labels, common.work_dir(spark))
    assert good.columns == odd_docs.columns
    assert sorted(map(str, [r.doc_id for r in good.collect()])) == sorted(map(str, [r.doc_id for r in got.filter("predicted = 1").collect()]))
    none, model = quality.classified(odd_docs, labels.limit(0), common.work_dir(spark))
    assert {r.predicted for r in none.collect()} == {1} and quality.of_good_quality(odd_docs, labels.limit(0), common.work_dir(spark)).count() == odd_docs.count()
    assert quality.classified(odd_docs.limit(0), labels, common.work_dir(spark))[0].count() == 0
