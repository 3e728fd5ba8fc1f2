"""The classifier against densities written out, its held-out accuracy, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.llm import quality_classifier as QC

SF = "/root/testdata/sf0.1"


def test_densities():
    rng = np.random.default_rng(3)
    own = {k: rng.normal(k, 1 + k, (300, 4)) @ rng.normal(size=(4, 4)) for k in (0, 1)}
    model = QC.QuadraticDiscriminant({k: (len(x), x.sum(axis=0), x.T @ x) for k, x in own.items()}, strength=7)
    cov = {k: np.cov(x.T, bias=True) for k, x in own.items()}
    pooled = np.diag(np.diag(cov[0] + cov[1]) / 2 + QC.LEAST_VARIANCE)
    share = (4 + 7) / (300 + 4 + 7)
    point = rng.normal(size=(20, 4))
    logs = []
    for k in (0, 1):
        c = (1 - share) * cov[k] + share * pooled + QC.LEAST_VARIANCE * np.eye(4)
        away = point - own[k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.score(point), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_one_class_or_none():
    x = np.ones((5, len(QC.STATISTICS)))
    assert QC.QuadraticDiscriminant({}).score(x).tolist() == [0.5] * 5
    assert QC.QuadraticDiscriminant({1: (5, x.sum(axis=0), x.T @ x)}).score(x).tolist() == [1.0] * 5


def test_sums_over_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), rng.normal(k, 1, len(QC.STATISTICS)).tolist()) for k in rng.integers(0, 2, 500)]
    model = QC.fit(spark.createDataFrame(rows, "label int, x array<double>").repartition(7))
    mean = np.mean([x for k, x in rows if k], axis=0)
    assert np.allclose(model.classes[1][0], mean)


def test_held_out_accuracy(spark):
    found = QC.op13_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    right = {(r.held_out, r.quality): r["right"] for r in found.groupBy("held_out", "quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).collect()}
    assert right[True, 1] >= 0.98 and right[True, 0] >= 0.97, right


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    good = "Some plain words stand here, and then others follow them. All of it reads well enough.\n"
    texts = [good * n for n in range(1, 9)] + ["word " * 60, "A!! B!! C!!", "$$$ ### %%%" * 9, "x|y|z " * 30] * 2 + [None, "", " \n ", good * 20_000, "中文" * 50, "\x00\x1f"]
    rows = [(i, t, "a", 0.5) for i, t in enumerate(texts)] + [(None, good, "b", 0.1), (0, texts[0], "c", 0.2), (0, texts[0], "c", 0.2)]
    labels = [(i, int(i < 8), 0, "q") for i in range(16)] + [(None, 1, 0, "q"), (0, 1, 0, "q"), (1, None, 0, "q"), (2, 7, 0, "q"), (3, 0, 0, "q"), (777, 1, 0, "q")]
    spark.createDataFrame(rows, "doc_id long, text string, x string, Score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, x string").write.parquet(f"{folder}/labels.parquet")
    return str(folder), len(rows)


def test_odd_rows(spark, odd):
    folder, n = odd
    rows = QC.op13_quality_classifier(spark, folder).collect()
    assert len(rows) == n
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 0}) == 1


def test_empty_tables(spark, odd, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert QC.op13_quality_classifier(spark, str(tmp_path)).collect() == []
