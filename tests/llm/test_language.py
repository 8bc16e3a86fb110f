import itertools
import zlib

import numpy as np

import __spark_entry__ as entry
from millrace.llm import op10_language as L
from tests.conftest import SMALL


def test_held_out_accuracy(spark):
    sf = SMALL.replace("0.001", "0.01")
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["op10_language"](spark, sf).collect()
    assert len(rows) == len(truth)
    known = {d.lang for d in truth.values()} - {None}
    hits = [r.lang_pred == truth[r.doc_id].lang for r in rows if r.held_out and truth[r.doc_id].lang and r.lang_pred != "und"]
    assert np.mean(hits) > 0.95
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        has = any(c.isalpha() for c in truth[r.doc_id].text or "")
        assert (r.lang_pred in known) if has else r.lang_pred == "und"


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    scores, move = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    gamma, pair = L.forward_backward(scores, np.array([4, 1, 2]), move)
    want, moves, at = np.zeros((7, 3)), np.zeros((3, 3)), 0
    for n in (4, 1, 2):
        paths = list(itertools.product(range(3), repeat=n))
        w = np.array([np.exp(sum(scores[at + i, p] for i, p in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        w /= w.sum()
        for p, x in zip(paths, w):
            for i, c in enumerate(p):
                want[at + i, c] += x
            for a, b in zip(p, p[1:]):
                moves[a, b] += x
        at += n
    assert np.abs(gamma - want).max() < 1e-9 and np.abs(pair - moves).max() < 1e-9


def test_code_switched_text_is_labelled_by_its_larger_part(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    model = L.learn(docs)
    by = {}
    for r in docs.where("lang is not null and n_chars > 600").orderBy("doc_id").collect():
        by.setdefault(r.lang, r.text)
    a, b = sorted(by)[:2]
    mixed = by[a][:500] + " " + by[b][:150]
    lang, score = L.Labeller(model).label([mixed, by[a][:500]])
    assert lang == [a, a] and score[0] < score[1] and 0.6 < score[0] < 0.95


def test_held_out_labels_change_nothing(docs):
    flipped = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN 'qq' ELSE lang END AS lang")
    a, b = L.learn(docs), L.learn(flipped)
    assert a.labels == b.labels and (a.weights == b.weights).all()


def test_odd_rows(odd, empty, docs):
    model = L.learn(docs)
    rows = L.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert L.identify(empty, model).count() == 0
    assert L.learn(empty) is None
    assert {r.lang_pred for r in L.identify(odd, None, keep=["doc_id"]).collect()} == {"und"}


def test_query_against_a_plain_version(spark, docs):
    """Each text alone: every word's features summed one by one, and chains decoded one at a time."""
    model = L.learn(docs)

    def plain(text):
        share = np.zeros(len(model.labels))
        for line in (text or "").replace("\x00", " ").lower().split("\n"):
            words = [w for w in L._WORDS.findall(line) if w != "\x00"]
            if words:
                scores = np.array([model.weights[L.features([w], model.lexicon)[0]].sum(axis=0) for w in words])
                alpha, beta = np.zeros((len(words), len(share))), np.ones((len(words), len(share)))
                for i in range(len(words)):
                    alpha[i] = np.exp(scores[i] - scores[i].max()) * (alpha[i - 1] @ np.exp(model.move) if i else 1)
                    alpha[i] /= alpha[i].sum()
                for i in range(len(words) - 2, -1, -1):
                    beta[i] = np.exp(model.move) @ (np.exp(scores[i + 1] - scores[i + 1].max()) * beta[i + 1])
                    beta[i] /= beta[i].sum()
                gamma = alpha * beta
                share += (gamma / gamma.sum(axis=1, keepdims=True) * np.array([len(w) for w in words])[:, None]).sum(axis=0)
        return (model.labels[share.argmax()], share.max() / share.sum()) if share.sum() else ("und", 0.0)

    found = {r.doc_id: r for r in entry.queries()["op10_language"](spark, SMALL).collect()}
    for r in docs.collect():
        lang, score = plain(r.text)
        assert abs(found[r.doc_id].score - score) < 1e-4 and (found[r.doc_id].lang_pred == lang or score < 0.51)
