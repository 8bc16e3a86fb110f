import zlib

import numpy as np

import __spark_entry__ as entry
from millrace.llm import op03_quality as Q
from tests.conftest import SMALL


def test_held_out_accuracy(spark):
    sf = SMALL.replace("0.001", "0.1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in entry.queries()["op3_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    s, y = np.array([r.score for r in rows]), np.array([labels[r.doc_id] for r in rows])
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.8
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_fold_and_range(spark, docs):
    rows = entry.queries()["op3_quality"](spark, SMALL).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_held_out_labels_change_nothing(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = Q.learn(docs, labels), Q.learn(docs, flipped)
    assert a.good == b.good and a.bad == b.bad and (a.weights == b.weights).all()


def test_odd_rows(spark, odd, empty, docs):
    model = Q.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = Q.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1  # null counts as empty
    assert Q.score(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit([]).score(["x"])[0] == 0.5 and Q.learn(docs, none).constant == 0.5
    one = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert Q.learn(docs, one).constant == 1.0


def test_query_against_each_text_alone(spark, docs):
    model = Q.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = sorted((r.doc_id, model.score([r.text or ""])[0]) for r in docs.collect())
    found = sorted((r.doc_id, r.score) for r in entry.queries()["op3_quality"](spark, SMALL).collect())
    assert [i for i, _ in found] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(found, want)) < 1e-12
