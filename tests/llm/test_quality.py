import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import CLASHING, DOCS, ODD_IDS, ODD_TEXTS, documents
from palisade.llm import quality

LABELS = "doc_id bigint, quality int, toxic int"
SF = "/root/testdata/sf0.1"


def test_sum_of_squares_equals_all_pairs():
    r = np.random.default_rng(1)
    model = quality.FactorisationMachine(0.3, r.normal(size=9), r.normal(size=(9, 4)))
    rows = [([0, 3, 8], [1.0, -2.0, 0.5]), ([2], [3.0]), ([1, 2, 3, 4], [0.1, 0.2, 0.3, 0.4])]
    starts = np.array([0, 3, 4])
    fast = model.logits(starts, np.concatenate([i for i, _ in rows]).astype(int),
                        np.concatenate([v for _, v in rows]))
    for (indices, values), logit in zip(rows, fast):
        slow = 0.3 + sum(model.linear[i] * v for i, v in zip(indices, values))
        for a in range(len(indices)):
            for b in range(a):
                slow += values[a] * values[b] * float(
                    model.latent[indices[a]] @ model.latent[indices[b]])
        assert abs(slow - logit) < 1e-9


def test_an_interaction_is_learned():
    """Good exactly where one of two marks is present, which no linear model can tell."""
    rows, labels = [], []
    for n in range(400):
        a, b = n % 2, n // 2 % 2
        rows.append(([i for i, x in enumerate((a, b, 1)) if x], [1.0] * (a + b + 1)))
        labels.append(a ^ b)
    model = quality.fit(rows, labels, 3, epochs=300, rate=0.2)
    starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows])[:-1]))
    logits = model.logits(starts, np.concatenate([i for i, _ in rows]).astype(int),
                          np.concatenate([v for _, v in rows]))
    assert ((logits > 0) == np.array(labels)).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data folder")
def test_held_out_accuracy(spark):
    from palisade.llm.queries import QUERIES
    scored = QUERIES["op4_quality_classifier"](spark, SF)
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert ((rows["score"] >= 0.5) == (rows["quality"] == 1)).mean() > 0.95
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()


def test_held_out_rows_are_never_learned_from(spark):
    docs = documents(spark, ["good words here"] * 60 + ["BAD ### BAD"] * 60)
    out = {i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1}
    honest = [(i, int(i < 60), 0) for i in range(120) if i not in out]
    lies = [(i, int(i >= 60), 0) for i in out]
    models = [quality.learn(docs, spark.createDataFrame(rows, LABELS)) for rows in (
        honest, honest + lies)]
    assert np.array_equal(models[0].linear, models[1].linear)
    assert {r["doc_id"] for r in docs.where(quality.held_out()).collect()} == out


def test_odd_rows(spark):
    docs = documents(spark, ODD_TEXTS, ODD_IDS, CLASHING)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, 0), (9, 0, 1),
                                    (1000, 1, 0)], LABELS)
    none = spark.createDataFrame([], LABELS)
    for some in (labels, none, labels.where("quality = 0")):
        model = quality.learn(docs, some, metadata=["n_chars"])
        rows = quality.score(docs, model, metadata=["n_chars"]).collect()
        assert len(rows) == len(ODD_IDS) and all(0 < r["score"] < 1 for r in rows)
        kept = quality.keep_good(docs, model, metadata=["n_chars"])
        assert kept.schema == docs.schema
        assert kept.count() == sum(r["score"] >= 0.5 for r in rows)
    empty = spark.createDataFrame([], DOCS)
    model = quality.learn(empty, labels)
    assert quality.score(empty, model).count() == 0
    assert quality.keep_good(empty, model).count() == 0
    assert docs.where(quality.held_out() & F.col("doc_id").isNull()).count() == 0
