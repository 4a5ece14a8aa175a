"""Language mixtures and the quality discriminant: held-out accuracy and defined cases."""

import numpy as np
from helpers import LINE, awkward, empty
from pyspark.sql import functions as F

from tidewatch.llm import language, quality_classifier as qc
from tidewatch.llm.queries import load

RUNS, _ = load()


def test_held_out_language_accuracy(spark, sf_dir):
    got = RUNS["op3_language_mixture"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 30 and got.where("lang <> lang_pred").count() <= 0.02 * got.count()
    assert got.where("score < 0 or score > 1").isEmpty()


def test_mixture_finds_both_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs)
    de, fr = (docs.where((F.col("lang") == x) & (F.col("n_chars") > 1500)).first()["text"][:1500] for x in ("de", "fr"))
    mixed = spark.createDataFrame([(1, de + " " + fr), (2, de), (3, None), (4, "12 !?"), (5, "")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in language.predict(mixed, model).collect()}
    assert set(got[1]["languages"]) == {"de", "fr"} and min(got[1]["proportions"]) > 0.3
    assert got[2]["languages"] == ["de"] and got[2]["score"] > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5))


def test_em_increases_likelihood():
    rng = np.random.default_rng(1)
    likelihood, weight = rng.random((40, 3)), rng.integers(1, 9, 40).astype(float)
    size, share, last = np.array([25, 15]), np.full((2, 3), 1 / 3), np.full(2, -np.inf)
    for _ in range(8):
        share, fit = language._iterate(likelihood, weight, size, share, 1)
        assert (fit >= last - 1e-9).all() and np.allclose(share.sum(axis=1), 1)
        last = fit


def test_languages_of_awkward_documents(spark):
    docs = awkward(spark)
    got = language.predict(docs, language.train(docs))
    assert got.count() == 21 and set(got.columns) >= {"lang_pred", "score", "kept", "source"}
    none = language.predict(docs, language.train(docs.where("lang is null")))
    assert none.where("lang_pred <> 'und'").isEmpty()
    assert language.predict(empty(spark), language.train(empty(spark))).count() == 0


def test_discriminant_equals_a_plain_one(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    taught = qc.taught_rows(qc.with_statistics(docs.select("doc_id", "text")), labels)
    model = qc.train(taught)
    rows = taught.toPandas()
    x, y = np.stack(rows["statistics"]), rows["quality"].to_numpy()
    means = np.stack([x[y == k].mean(axis=0) for k in (0, 1)])
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(own))
    logs = []
    for k in (0, 1):
        s = 0.9 * own[k] + 0.1 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + qc.LEAST_VARIANCE * np.eye(qc.D)
        d = x - means[k]
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))), atol=1e-6)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = RUNS["op5_quality_discriminant"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    good, bad = ([r["score"] for r in got.where(F.col("quality") == k).collect()] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert got.where("predicted <> cast(score >= 0.7 as int)").isEmpty()


def test_scores_of_awkward_documents(spark):
    docs = awkward(spark)
    vectors = qc.with_statistics(docs)
    assert vectors.count() == 21 and vectors.select(F.explode("statistics").alias("v")).where("isnan(v) or v is null or abs(v) > 1e9").isEmpty()
    labels = spark.createDataFrame([(i * 10, i % 2) for i in range(18)] + [(180, None)], "doc_id bigint, quality int")
    scored = qc.classify(vectors, qc.train(qc.taught_rows(vectors, labels)))
    assert scored.count() == 21 and scored.where("score is null or score < 0 or score > 1").isEmpty()
    one = qc.classify(vectors, qc.train(qc.taught_rows(vectors, labels.where("quality = 1"))))
    assert one.select("score").distinct().collect()[0][0] == 1.0
    assert qc.classify(qc.with_statistics(empty(spark)), qc.train(vectors.withColumn("quality", F.lit(None).cast("int")))).count() == 0
    assert qc.statistics([LINE.encode()]).shape == (1, qc.D)
