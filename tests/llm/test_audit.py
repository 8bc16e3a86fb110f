import re
from itertools import permutations

import numpy as np

import __spark_entry__ as entry
from millrace.llm import op13_audit as A
from tests import oracle
from tests.conftest import SMALL


def plain(rows: list[tuple], labels: dict) -> set[tuple]:
    """(part, order, step, ...) by applying every order to every document."""
    first: dict = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    told = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])
        told.append((source or "", fails, *labels.get(i, (0, 0))))
    out = {}
    shapley: dict = {}
    for part in {x[0] for x in told}:
        own = [x for x in told if x[0] == part]
        for order in permutations(range(5)):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                numbers = (len(left), len(gone), sum(x[1][f] for x in own) - len(gone), sum(x[1][f] and sum(x[1]) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone))
                out[part, "".join("ABCDE"[j] for j in order), k + 1] = (*numbers, f)
    return {(*k, *v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def test_walk_meets_every_order_once_by_neighbours():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in A.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_survivors():
    counts = np.random.default_rng(1).integers(0, 9, 32)
    assert A.survivors(counts).tolist() == [sum(int(counts[m]) for m in range(32) if not m & s) for s in range(32)]


def test_against_plain_orders(spark, odd, docs):
    for rows, known in ((odd, [(4, 1, None), (4, 0, 1), (6, None, 1), (None, 1, 1)]), (docs, None)):
        labels = spark.read.parquet(f"{SMALL}/labels.parquet") if known is None else spark.createDataFrame(known, "doc_id long, quality int, toxic int")
        told: dict = {}
        for r in labels.where("doc_id IS NOT NULL").collect():
            good, toxic = told.get(r.doc_id, (0, 0))
            told[r.doc_id] = (max(good, int(r.quality == 1)), max(toxic, int(r.toxic == 1)))
        assert {tuple(r) for r in A.audit(rows, labels).collect()} == plain([(r.doc_id, r.text, r.source) for r in rows.collect()], told)


def test_empty_tables(spark, docs, empty):
    assert A.audit(empty, spark.read.parquet(f"{SMALL}/labels.parquet")).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, none).where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_same_rows_as_sql(spark):
    con = oracle.connect(SMALL)
    oracle.compare(spark, con, entry.queries()["op13_audit"], A.SQL, SMALL)
    left, right = oracle.types(spark, con, entry.queries()["op13_audit"], A.SQL, SMALL)
    assert left == right
