import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from millrace.llm import op11_collocation as C
from tests import oracle
from tests.conftest import SMALL
from tests.llm.conftest import DOCS


def plain(rows: list[tuple], least: int, most: int, listed: int) -> set[tuple]:
    """The contract in plain Python, for any longest phrase."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = set()
    f: dict[str, Counter] = {}
    for text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall(r"[^ \t]+", piece)
            own.update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    for lang, own in f.items():
        n = sum(v for p, v in own.items() if len(p) == 1)
        known = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inner = Counter()
        for p, a in known.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inner[p[i : i + size]] = max(inner[p[i : i + size]], a)
        kept = []
        for p, a in known.items():
            if 100 * inner[p] >= 50 * a:
                continue
            score, _, l, r = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:listed], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n, -score))
    return out


def found(df) -> set[tuple]:
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("most", [2, 3, 5])
def test_against_plain_counts(spark, most):
    rng = np.random.default_rng(most)
    known = np.array(["a", "B", "c", "dé", "E.", "f\t", "\ng", "h ,", "日本"])
    rows = [(i, " ".join(known[rng.zipf(1.5, size=60) % 9]) + " fixed turn of phrase" * (i % 2), [None, "x", "y"][i % 3], None, 0, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    want = plain([(r[1], r[2]) for r in rows], 4, most, 40)
    assert found(C.collocations(docs, least=4, most=most, listed=40)) == want


def test_hot_prefixes_are_dealt_and_complete(spark):
    rows = [(i, f"all rights reserved here all w{i % 7} w{i % 5}", "en", None, 0, None, None) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    counted = C.count_words(docs)
    assert C._hot(counted, 100, 1 << 20)["en"][1].max() > 1
    a = {tuple(r) for r in C.frequent_phrases(docs, counted, hot=100).collect()}
    b = {tuple(r) for r in C.frequent_phrases(docs, counted).collect()}
    assert a == b and ("en", "all rights reserved", 3, 400) in a


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000_001
    phrases = spark.createDataFrame([("x", "p q", 2, big)], "lang string, phrase string, words int, a long")
    counted = spark.createDataFrame([("x", "p", big + 5), ("x", "q", 2 * big + 1)], "lang string, word string, n long")
    assert C.scored(phrases, counted).head().score == 1000000 * big * big // ((big + 5) * (2 * big + 1))


def test_odd_rows(spark, odd, empty):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert found(C.collocations(odd, least=2)) == plain(rows, 2, 3, 2000) != set()
    assert C.collocations(empty).count() == 0


def test_same_rows_as_sql(spark):
    con = oracle.connect(SMALL)
    oracle.compare(spark, con, entry.queries()["op11_collocation"], C.SQL, SMALL)
    left, right = oracle.types(spark, con, entry.queries()["op11_collocation"], C.SQL, SMALL)
    assert left == right


def test_sql_on_odd_rows(odd):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.lang) for r in odd.collect()])
    rows = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({C.SQL})").fetchall()
    assert set(rows) == plain([(r.text, r.lang) for r in odd.collect()], 10, 3, 2000)
