"""The classifier learns from all labelled documents: nothing of its model comes from a part of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrillo.llm import classifier
from corrillo.llm.common import table


def training(spark, sf_dir):
    """Features and labels of all labelled documents outside the held-out fold, in plain Python."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").where(~classifier.held_out(F.col("doc_id"))).select("text", "quality").collect()
    return np.stack([classifier.features((r["text"] or "").encode()) for r in rows]).astype(np.float64), np.array([r["quality"] > 0 for r in rows])


def test_model_does_not_depend_on_where_the_search_begins(spark, sf_dir, monkeypatch):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    whole = classifier.fit(docs, labels)
    monkeypatch.setattr(classifier, "MAX_LABELLED", 40)
    other = classifier.fit(docs, labels)
    found, good = training(spark, sf_dir)
    assert np.abs(whole.scores(found) - other.scores(found)).max() < 0.01
    for model in (whole, other):
        assert np.isclose(model.offset, np.quantile(found @ model.weights, 1 - good.mean()))  # of all, not of 40


def test_least_loss_over_all_pairs(spark, sf_dir):
    model = classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found, good = training(spark, sf_dir)  # fewer than a block's, so that all pairs are in it
    assert len(good) < classifier.BLOCK_ROWS
    deviation = found.std(0)
    used = deviation > 1e-6
    differences = (found[good][:, None, used] - found[~good][None][:, :, used]).reshape(-1, used.sum()) / deviation[used]
    w = model.weights[used] * deviation[used]
    slope = -(1 / (1 + np.exp(differences @ w))) @ differences / len(differences) + classifier.RIDGE * w
    assert np.abs(slope).max() < 1e-5 and not model.weights[~used].any()


def test_every_labelled_document_counts(spark, sf_dir, monkeypatch):
    """The blocks have every text, and those of a rare kind several times."""
    monkeypatch.setattr(classifier, "BLOCK_ROWS", 50)
    rows = spark.range(300).selectExpr("id AS doc_id", "if(id < 4, 0, 1) AS label").withColumn("features", F.col("doc_id").cast("string").cast("binary"))
    blocks = classifier.dealt_to_blocks(rows, 296, 4).collect()
    kinds = [[classifier.zstandard.decompress(bytes(b[k])) for b in blocks] for k in ("good", "bad")]
    assert len(blocks) == 6 and sum(map(len, kinds[0])) == sum(len(str(i)) for i in range(4, 300))
    assert all(sorted(x) == list(b"0123") for x in kinds[1])


@pytest.mark.parametrize("share", [0, 0.1, 0.37, 0.5, 0.999, 1])
def test_quantile_is_exact(spark, monkeypatch, share):
    monkeypatch.setattr(classifier, "LOOKED_THROUGH", 5)
    monkeypatch.setattr(classifier, "BINS", 4)
    values = [*np.random.default_rng(3).normal(size=50), *[0.25] * 30, 1e9]
    found = classifier.quantile(spark.createDataFrame([(float(v),) for v in values], "score double"), share)
    assert np.isclose(found, np.quantile(values, share))
