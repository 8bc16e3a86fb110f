import re
from collections import defaultdict

import numpy as np

import __spark_entry__ as entry
from millrace.llm import op02_mixing as M
from tests.conftest import SMALL


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped, out = 1.5 * sum(sizes.values()), {}, {}
    while True:
        free = [s for s in names if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        out = {s: rest * weight[s] / w for s in free}
        over = [s for s in free if out[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return capped | out
        capped |= {s: 2.0 * sizes[s] for s in over}


def check(docs, rows):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    want, taken, largest = brute_targets(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) < largest[s] + 1e-6


def test_query_against_brute_force(spark, docs):
    rows = entry.queries()["op2_mixing"](spark, SMALL).collect()
    assert len(rows) == docs.count()
    check(docs.collect(), rows)


def test_reruns_agree(spark, docs):
    key = lambda rows: sorted((r.doc_id, r.copies) for r in rows)
    first = key(M.mix(docs).select("doc_id", "copies").collect())
    assert first == key(M.mix(docs.repartition(7)).select("doc_id", "copies").collect())


def test_pairing_keeps_the_sum_and_the_expectation():
    size, p = np.array([5.0, 3, 8, 2, 9]), np.array([0.3, 0.6, 0.5, 0.9, 0.2])
    total = np.zeros(5)
    for seed in range(4000):
        q = M.round_group(size, p, np.random.default_rng(seed))
        assert abs((q * size).sum() - (p * size).sum()) < 1e-9
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 1
        total += q
    assert np.abs(total / 4000 - p).max() < 0.04


def test_tree_of_several_levels(docs, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 5)
    monkeypatch.setattr(M, "FAN", 3)
    check(docs.collect(), M.mix(docs).collect())


def test_odd_rows(odd, empty):
    rows = M.mix(odd).collect()
    assert len(rows) == odd.count()
    check(odd.collect(), rows)
    assert M.mix(empty).count() == 0
