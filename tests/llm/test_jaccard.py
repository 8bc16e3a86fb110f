import re

import numpy as np

import __spark_entry__ as entry
from millrace.llm import op07_jaccard as J
from tests.conftest import SMALL


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    """(id, text) -> sorted (id, size, component)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), 1 << 60), d)
    return sorted(((d is None, d or 0, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def same(df, rows):
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect()), key=str)
    assert found == brute(rows)


def test_query_against_brute_force(spark, docs):
    same(entry.queries()["op7_jaccard"](spark, SMALL), [(r.doc_id, r.text) for r in docs.collect()])


def family(n: int, seed: int, change: float) -> list[str]:
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, len(w), int(change * len(w))):
            w[k] = f"z{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


def test_families_hubs_and_blocks(spark, monkeypatch):
    """Large groups of near copies around the threshold, a passage that all share, and blocks small enough to be several."""
    for name, value in (("LARGE_GROUP", 8), ("BLOCK", 7), ("FREQUENT", 6)):
        monkeypatch.setattr(J, name, value)
    shared = " ".join(f"common{i}" for i in range(40))
    texts = family(40, 1, 0.02) + family(40, 2, 0.04) + [t + " " + shared for t in family(12, 3, 0.01)] + [shared + f" only {i} here" for i in range(25)] + [shared] * 5
    rows = list(enumerate(texts))
    same(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_threshold_is_exact(spark):
    """Similarities of exactly 0.75 link; a little less does not."""
    a = [f"a{i}" for i in range(11)]  # seven shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1])), (3, " ".join(a[:-2])), (4, "one two three"), (5, "ONE two\tthree"), (6, "one two"), (7, "")]
    same(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_odd_rows(odd, empty):
    same(J.jaccard_components(odd), [(r.doc_id, r.text) for r in odd.collect()])
    assert J.jaccard_components(empty).count() == 0


def test_sketches_are_short_and_drop_no_link():
    """A sketch has at most a quarter of a byte for each shingle, never differs in more bits than sets do in shingles, and tells sets of half their shingles apart."""
    rng = np.random.default_rng(7)
    every = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    sets, kinds = [], []
    for n in (1, 3, 60, 64, 65, 500, 512, 520, 1500):
        base = rng.permutation(every)[: 2 * n]
        for shift in sorted({0, n // 20, n // 7, n // 4, n // 3, n}):
            sets.append(np.unique(base[shift : shift + n]))
    n = np.array([len(s) for s in sets])
    sketches = [J.sketch(s) for s in sets]
    assert all(len(x) <= max(8, len(s) / 4) for x, s in zip(sketches, sets))
    links = np.array([[100 * (both := len(np.intersect1d(x, y))) >= 75 * (len(x) + len(y) - both) for y in sets] for x in sets])
    one = np.array([[J.may_link(sketches[i], sketches[j], n[i], n[j]) for j in range(len(sets))] for i in range(len(sets))])
    like = np.array([[min(a, b) >= J.need(max(a, b)) for b in n] for a in n])
    assert (one | ~links).all()
    assert (J._may_link_matrix({"n": n, "sketch": sketches}, like, J.THRESHOLD) == one).all()
    differ = J._differ(sketches)
    assert all(differ[i, j] <= len(np.setxor1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(len(sets)))
    base = rng.permutation(every)[:1000]
    assert not J.may_link(J.sketch(np.sort(base[:600])), J.sketch(np.sort(base[200:800])), 600, 600)  # 0.5
