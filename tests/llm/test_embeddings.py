import numpy as np
import pytest

import __spark_entry__ as entry
from millrace.llm import op06_neardup as D
from millrace.llm import op08_ann as A
from tests.conftest import SMALL


def good(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows):
    """doc rows (id, vector) -> (links, component) by row; ids may repeat."""
    ok = [i for i, (_, v) in enumerate(rows) if good(v)]
    links, root = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], dtype=float), np.array(rows[b][1], dtype=float)
            if a != b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95:
                links[a] += 1
                root[find(a)] = find(b)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), 1 << 60), rows[i][0])
    return sorted((rows[i][0], links[i], low[find(i)]) for i in range(len(rows)))


def test_neardup_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = entry.queries()["op6_neardup"](spark, SMALL).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neardup_cells_blocks_and_odd_vectors(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + rng.normal(size=8) * 0.12).tolist()) for i in range(300)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [None] * 8), (305, rows[0][1]), (305, rows[0][1]), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], f"vec_id long, embedding array<{kind}>, component string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute_links(rows)
    for name, value in (("CELL_ROWS", 40), ("BLOCK", 16)):
        monkeypatch.setattr(D, name, value)
    found = D.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == want
    assert D.near_duplicates(df.limit(0)).count() == 0


def brute_nearest(rows, k=20, every=20):
    ids, x = [i for i, v in rows if good(v)], np.array([v for _, v in rows if good(v)], dtype=float)
    out = {}
    for q in (i for i in ids if i % every == 0):
        s = x @ x[ids.index(q)]
        out[q] = sorted(((-float(d), i) for d, i in zip(s, ids) if i != q))[:k]
    return out


def test_ann_query_recall_and_scores(spark):
    sf = SMALL.replace("0.001", "0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(rows)
    vector = {i: np.array(v, dtype=float) for i, v in rows}
    found: dict = {}
    for r in entry.queries()["op8_ann"](spark, sf).collect():
        found.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
        assert abs(r.score - vector[r.query_id] @ vector[r.vec_id]) < 1e-12
    assert set(found) == set(want)
    hits = 0
    for q, best in want.items():
        own = sorted(found[q])
        assert [x[0] for x in own] == list(range(1, len(best) + 1))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
        hits += len({i for _, i in best} & {x[2] for x in own})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_over_many_shards(spark, monkeypatch):
    """Every shard's graph, and the merge of their answers: 20 shards of 100 vectors each."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/embeddings.parquet").collect()]
    monkeypatch.setattr(A, "SHARD", len(rows) // 20)
    found: dict = {}
    for r in A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows)
    assert sum(len({i for _, i in best} & found[q]) for q, best in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_graph_search_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    a, b, _ = A.search_shard(A.build_shard(np.arange(3000), x), np.arange(0, 3000, 60), x[::60])
    hit = 0
    for q in range(0, 3000, 60):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(b[a == q].tolist()))
    assert hit >= 0.9 * 20 * 50


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (40, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in A.nearest(df).collect())
    assert [x for x in found if x[0] == 0] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (0, 4, 20, 0.5)]
    assert [x[2] for x in found if x[0] == 20] == [0, 1, 2]
    assert A.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [16, 64, 256])
def test_recall_on_uneven_lengths(size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(2000, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    huge = x.copy()
    huge[7] *= 1e6
    for rows in (x * np.exp(rng.normal(size=2000))[:, None], huge):
        asked = np.arange(0, 2000, 20)
        shard = A.build_shard(np.arange(2000), rows)
        owner, found, score = A.search_shard(shard, asked, rows[asked])
        product = rows[asked] @ rows.T
        product[np.arange(len(asked)), asked] = -np.inf
        want = {(q, v) for q, row in zip(asked.tolist(), product) for v in np.argsort(-row)[:20].tolist()}
        assert len(want & {*zip(owner.tolist(), found.tolist())}) / len(want) >= 0.95
        assert np.allclose(score, product[np.searchsorted(asked, owner), found])


def test_a_vector_of_finite_but_huge_length_loses_no_other(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * (1e200 if i == 3 else 1e-180 if i == 9 else 1)).tolist()) for i in range(61)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = A.nearest(df, every=20, k=20).collect()
    x = np.array([v for _, v in rows])
    for q in (0, 20, 40, 60):
        dot = x @ x[q]
        want = [i for i in np.lexsort((np.arange(61), -dot)).tolist() if i != q][:20]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == want
