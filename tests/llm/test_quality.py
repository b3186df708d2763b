"""The discriminant against a direct computation, and accuracy on held-out labels."""

import numpy as np

from binflow.llm import quality

SF = "/root/testdata/sf0.01"


def density(x, mean, cov):
    away = x - mean
    return -0.5 * (np.log(np.linalg.det(cov)) + away @ np.linalg.solve(cov, away))


def test_statistics_defined():
    for text in (None, "", " \n", "x", "É" * 10, "a b a\na b a\n", "word " * 50_000):
        row = quality.statistics(text)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()
    assert quality.statistics(None) == quality.statistics("")


def test_fit_and_score(spark):
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    data = {0: rng.normal(0, 1, (80, d)) @ rng.normal(0, 1, (d, d)), 1: rng.normal(2, 1, (120, d))}
    rows = [(*map(float, x), k) for k, m in data.items() for x in m] + [(*[0.0] * d, None), (*[0.0] * d, 7)]
    model = quality.fit(spark.createDataFrame(rows, ", ".join(f"{f} double" for f in quality.FEATURES) + ", quality int"))
    covs = {k: np.cov(m.T, bias=True) for k, m in data.items()}
    pooled = (80 * covs[0] + 120 * covs[1]) / 200
    shrunk = {}
    for k, c in covs.items():
        c = 0.8 * c + 0.2 * pooled
        shrunk[k] = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(d)
    for x in np.concatenate([data[0][:10], data[1][:10]]):
        logs = [np.log(len(data[k]) / 200) + density(x, data[k].mean(axis=0), shrunk[k]) for k in (0, 1)]
        want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        assert abs(model.score(x[None])[0] - want) < 1e-6


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b", "c"), (1, "a b", "c"), (None, None, "c")], "doc_id long, text string, f0 string")
    rows = quality.measured(docs)
    for model, want in ((quality.Discriminant({}), 0.5), (quality.fit(rows.withColumn("quality", quality.F.lit(1))), 1.0)):
        assert [r.score for r in quality.score(rows, model).collect()] == [want] * 3
    assert quality.score(quality.measured(docs.limit(0)), quality.Discriminant({})).count() == 0


def test_held_out(spark):
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = quality.op4(spark, SF).where("held_out").join(truth, "doc_id").collect()
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9 and sum(r.predicted == 0 for r in bad) / len(bad) > 0.8
