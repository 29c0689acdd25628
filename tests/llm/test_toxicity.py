import numpy as np
import pytest
from pyspark.sql import functions as F

from rolemill.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    return toxicity.fit(docs, labels)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = docs.join(labels, "doc_id").where(toxicity.held_out("doc_id"))
    rows = toxicity.score(held, model).select("toxic", "score").toPandas()
    order = rows["score"].rank()
    pos = rows["toxic"] == 1
    n, m = pos.sum(), (~pos).sum()
    auc = (order[pos].sum() - n * (n + 1) / 2) / (n * m)
    hit = rows["score"] >= 0.5
    precision, recall = (hit & pos).sum() / max(hit.sum(), 1), (hit & pos).sum() / n
    print("auc", auc, "precision", precision, "recall", recall, n, m)
    assert auc > 0.9 and precision > 0.8 and recall > 0.8


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "words"), (4, "long " * 300_000),
            (5, "same"), (5, "same")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("score", F.lit("x"))
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    base = {r["score"] for r in out if r["doc_id"] in (1, 2, 3)}
    assert len(base) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id int, toxic int")
    assert toxicity.fit(docs, none).weights.sum() == 0


def test_risk_separates_planted_word():
    rng = np.random.default_rng(3)
    text = lambda bad: np.unique(np.append(rng.integers(10, 60, 15), [1] if bad else []))
    toxic = [text(True) for _ in range(60)]
    mixed = [text(i % 10 == 0) for i in range(600)]
    model = toxicity.train(toxic, mixed, 0.1)
    assert model.weights[1] > 3 * np.abs(model.weights[10:60]).max()
