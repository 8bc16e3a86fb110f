import math

import numpy as np

import __spark_entry__ as entry
from millrace.operators import segmentation as S
from tests.conftest import SMALL


def plain(model: S.Segmenter, run: str) -> list[tuple[int, int]]:
    """The cheapest path by looking up every piece of the run."""
    best = [(0.0, 0)] + [(math.inf, 0)] * len(run)
    for end in range(1, len(run) + 1):
        for start in range(end):
            word = run[start:end]
            if word in model.costs and best[start][0] + model.costs[word] < best[end][0]:
                best[end] = (best[start][0] + model.costs[word], end - start)
        if best[end - 1][0] + model.unknown < best[end][0]:  # known words come first
            best[end] = (best[end - 1][0] + model.unknown, -1)
    out, end = [], len(run)
    while end:
        start = end - abs(best[end][1])
        while best[end][1] < 0 and start and best[start][1] < 0:
            start -= 1
        out.append((start, end))
        end = start
    return out[::-1]


def words(model, text):
    return [text[a:b] for a, b in model.spans(text)]


def test_against_every_piece():
    rng = np.random.default_rng(2)
    for _ in range(40):
        letters = "abc" if rng.random() < 0.5 else "是不知道"
        counts = {"".join(rng.choice([*letters], rng.integers(1, 5))): int(rng.integers(1, 50)) for _ in range(12)}
        model = S.Segmenter(counts, ["".join(rng.choice([*letters], 3))])
        for _ in range(20):
            run = "".join(rng.choice([*letters, "x"], rng.integers(1, 25)))
            assert model.path(run) == plain(model, run)


def test_text_without_spaces():
    model = S.Segmenter({"我们": 40, "今天": 30, "看": 20, "电影": 25, "去": 30, "电": 3, "影": 2, "看电": 1})
    assert words(model, "我们今天去看电影。ABC去") == ["我们", "今天", "去", "看", "电影", "ABC", "去"]
    assert words(S.Segmenter({"看": 9, "电影": 9}, ["看电影"]), "看电影看") == ["看电影", "看"]
    assert words(S.Segmenter({}), "看电影 ab") == ["看电影", "ab"]  # nothing known: whole runs
    assert words(model, "") == [] and words(model, "。 _ !") == []


def test_words_of_rows(spark):
    counts = spark.createDataFrame([("Virtua", 5), ("virtua", 2), ("exit", 3), ("a", 9), (None, 4), ("zero", 0)], "word string, n long")
    model = S.segmenter(counts)
    assert set(model.costs) == {"virtua", "exit", "a"}
    rows = [(1, "VirtuaexitA exit"), (2, None), (None, "exit"), (3, ""), (1, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.segment(docs, model, stop=["exit"]).collect()
    assert [tuple(r) for r in found] == [(1, 0, "virtua", 0, 6)]
    every = S.segment(docs, model, least=1).collect()
    assert sorted((r.doc_id or 0, r.place, r.token) for r in every) == [(0, 0, "exit"), (1, 0, "a"), (1, 0, "virtua"), (1, 1, "exit"), (1, 2, "a"), (1, 3, "exit")]
    assert all(r.token == {1: "VirtuaexitA exit", None: "exit"}[r.doc_id][r.start : r.end].lower() for r in every if not (r.doc_id == 1 and r.token == "a" and r.start == 0))


def test_dictionary_has_the_most_frequent_words(spark):
    docs = spark.createDataFrame([(1, "b a a c c"), (2, "C é 日本"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in S.dictionary(docs, most=3).collect()] == [("c", 3), ("a", 2), ("b", 1)]


def test_query_recovers_most_words(spark):
    rows = entry.queries()["k01_segmented"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").distinct().collect())
    total = {c: sum(r[c] for r in rows) for c in ("words", "found", "hits")}
    assert 2 * total["hits"] / (total["words"] + total["found"]) > 0.8
    assert all(r.hits <= min(r.words, r.found) for r in rows)


def test_long_texts_come_in_several_batches(spark):
    docs = spark.createDataFrame([(1, "ab " * 70_000), (2, "ab")], "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in S.segment(docs, S.Segmenter({"ab": 1})).groupBy("doc_id").count().collect()) == [(1, 70_000), (2, 1)]
