import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from millrace.llm import op12_toxicity as T
from tests.conftest import SMALL

LARGE = SMALL.replace("0.001", "0.1")


def plain_marks(symbols: list[int]) -> list[int]:
    """What each insult or threat of a sequence of symbols is marked with, by looking around it."""
    out = []
    for k, s in enumerate(symbols):
        if s not in (T.INSULT, T.THREAT):
            continue
        begin = max([j + 1 for j in range(k) if symbols[j] == T.END], default=0)
        near = symbols[max(begin, k - T.NEAR) : k]
        quoted = symbols[:k].count(T.QUOTE) % 2
        out.append((T.NEGATED if T.NEGATION in near else 0) + (T.AIMED if T.TARGET in near else 0) + (T.REPORTED if quoted or T.REPORT in symbols[begin:k] else 0))
    return out


def test_composed_machine_against_a_plain_reading():
    rng = np.random.default_rng(3)
    for _ in range(300):
        symbols = rng.choice(8, size=40, p=[0.55, 0.12, 0.05, 0.08, 0.07, 0.04, 0.03, 0.06]).tolist()
        state, found, last = 0, [], -1
        for k, s in enumerate(symbols):
            if s:  # plain words are passed over at once
                state = T.GRAMMAR.waited[state][min(k - last - 1, T.NEAR)]
                if s in (T.INSULT, T.THREAT):
                    found.append(T.GRAMMAR.marks[state][s])
                state, last = T.GRAMMAR.follow[state][s], k
        assert found == plain_marks(symbols)


def test_clauses():
    lexicon = T.Lexicon({"idiot$": 2.0, "rotz": 1.5})
    m = T.match(lexicon, "You are an idiot. He said you idiot, and not an idiot! rotzig \"idiot\" I will kill you; they kill time")
    assert m.clauses == [2.0, 2.0, 2.0, 1.5 + 2.0 + 0.0, 1.0]
    assert (m.aimed, m.negated, m.reported) == (4.0, 2.0, 4.0)
    assert m.threats == 1.0  # "they kill": the other one has its target behind it
    assert T.match(lexicon, "idiots") == T.Matches(1, [], 0, 0, 0, 0)  # a whole word


@pytest.fixture(scope="module")
def told(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    return labels, entry.queries()["op12_toxicity"](spark, LARGE).collect()


def test_held_out_accuracy(told):
    labels, rows = told
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    hits = sum(p and y for p, y in known)
    assert hits / sum(p for p, _ in known) > 0.95  # precision
    assert hits / sum(y for _, y in known) > 0.85  # some labels are wrong: recall is not 1
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_query_against_each_text_alone(spark, docs):
    model = T.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = sorted((r.doc_id, model.score([r.text or ""])[0]) for r in docs.collect())
    found = sorted((r.doc_id, r.score) for r in entry.queries()["op12_toxicity"](spark, SMALL).collect())
    assert [i for i, _ in found] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(found, want)) < 1e-12


def test_held_out_labels_change_nothing(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = T.learn(docs, labels), T.learn(docs, flipped)
    assert a.lexicon.stems == b.lexicon.stems and (a.weights == b.weights).all()


def test_odd_rows(spark, odd, empty, docs):
    for labels in (spark.read.parquet(f"{SMALL}/labels.parquet"), spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([(i, 1) for i in range(99)], "doc_id long, toxic int")):
        model = T.learn(docs, labels)
        rows = T.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1  # null counts as empty
        assert T.score(empty, model).count() == 0
    bare = T.fit([])
    assert bare.score(["you are a worthless idiot, you moron. you are trash"])[0] >= 0.7 > bare.score(["a fine day at the river"])[0]
