"""Operators on small inputs whose results are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import chunks, curation, evaluation, extract, index, rank, relational, retrieval, rules, sequence, state
from millrace.sources import tables


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def test_bm25_prefers_the_denser_document(spark):
    docs = spark.createDataFrame([(1, "virtua virtua virtua exit"), (2, "virtua " + "other words " * 25), (3, "nothing here")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "virtua")], "query_id long, token string")
    found = retrieval.bm25(docs, q, 5).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [1, 2] and found[0].score > found[1].score
    assert found[0].hits == 3


def test_bm25_of_an_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "virtua")], "query_id long, token string")
    assert retrieval.bm25(docs, q, 5).count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate([1, 2, 3])], "query_id long, item long, rank int")
    b = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate([3, 4, 1])], "query_id long, item long, rank int")
    score = {r.item: r.score for r in retrieval.fuse([a, b], 10).collect()}
    assert score[1] > score[2] and score[3] > score[4]
    assert score[1] == pytest.approx(1 / 61 + 1 / 63)


def test_dense_top_two(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<double>")
    assert [r.vec_id for r in retrieval.dense(v, q, 2).orderBy("rank").collect()] == [1, 3]
    allowed = spark.createDataFrame([(2,), (3,)], "vec_id long")
    assert [r.vec_id for r in retrieval.dense_filtered(v, q, allowed, 1).collect()] == [3]


def test_dense_refuses_other_lengths(spark):
    v = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<double>")
    with pytest.raises(Exception, match="different lengths"):
        retrieval.dense(v, q, 2).collect()


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, doc_id long, rank int")
    good = spark.createDataFrame([(1, 11), (1, 99)], "query_id long, doc_id long")
    m = retrieval.metrics(ranked, good, 3).first()
    assert (m.recall, m.mrr) == (0.5, 0.5)
    assert m.ndcg == pytest.approx((1 / 1.584962500721156) / (1 + 1 / 1.584962500721156))


def test_diverse_selection_takes_another_group(spark):
    s = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "a", 0.85), (1, 3, "b", 0.8), (1, 4, None, 0.1)], "query_id long, id long, group_id string, score double")
    assert rows(rank.diverse(s, 3, 0.12), "rank", "id") == [(1, 1), (2, 3), (3, 2)]


def test_chunks_are_slices(spark):
    text = "\n".join(f"line {i} " + "x" * (i % 13) for i in range(40))
    own = [r for r in chunks.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), target=180, most=240, overlap=50).orderBy("chunk_index").collect()]
    assert len(own) > 2 and [r.chunk_index for r in own] == list(range(len(own)))
    assert all(text[r.start_char : r.end_char] == r.text and len(r.text) <= 240 for r in own)
    assert all(b.start_char <= a.end_char + 1 for a, b in zip(own, own[1:]))


def test_chunks_of_a_long_line():
    text = "One sentence. " * 200
    spans = chunks.chunk_spans(text, 100, 120, 20)
    assert all(b - a <= 120 for a, b in spans) and spans[-1][1] == len(text.rstrip())


def test_budget_passes_over_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4)], "k long, id long, size long").withColumn("place", F.col("id"))
    assert rows(sequence.pack(items, "k", 10, "place"), "id", "kept") == [(1, True), (2, False), (3, True)]


def test_intervals_merge_when_they_touch(spark):
    x = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 1, 2)], "k long, s long, e long")
    assert rows(sequence.merge_intervals(x, "k", "s", "e"), "s", "e", "n") == [(0, 7, 3), (9, 12, 1)]


def test_revisions_skip_equal_content(spark):
    c = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, "a", 4)], "id long, content string, t long").withColumn("k", F.lit(1))
    assert rows(state.revisions(c, ["k"], "content", "t", id="id").fillna(0), "id", "revision_of_id", "status") == [(1, 0, "superseded"), (3, 1, "superseded"), (4, 3, "active")]


def test_paging_meets_every_row_once(spark):
    x = spark.createDataFrame([(i, i // 3) for i in range(10)], "id long, t long")
    seen, after = [], None
    while True:
        page = state.page(x, "t", "id", 4, after).orderBy(F.desc("t"), F.desc("id")).collect()
        seen += [r.id for r in page]
        if not page[-1].has_more:
            break
        after = (page[-1].t, page[-1].id)
    assert seen == list(range(9, -1, -1))


def test_clamped_sum_is_a_fold(spark):
    x = spark.createDataFrame([(1, i, d) for i, d in enumerate([0.4, 0.4, -0.1, -2.0, 0.3])], "k long, o long, d double")
    assert rows(state.clamped_sum(x, "k", "o", F.col("d"))) == [(1, 0.3)]


def test_low_quality_does_not_reserve_a_key(spark):
    x = spark.createDataFrame([(1, "k", 0.1), (2, "k", 0.9), (3, "k", 0.95)], "id long, k string, q double")
    assert rows(curation.first_of(x, ["k"], F.asc("id"), where=F.col("q") > 0.5), "id") == [(2,)]


def test_near_duplicates_against_all_pairs(spark):
    texts = ["the quick brown fox jumps", "the quick brown fox jumped", "something else entirely different", "the quick brown fox jumps!", "short"]
    x = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert rows(curation.near_duplicates(x, "id"), "a", "b") == [(0, 1)]


def test_consistency(spark):
    j = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a")], "c long, w string")
    assert rows(evaluation.consistency(j, "c", "w")) == [(1, "a"), (2, "inconsistent"), (3, "incomplete")]


def test_bootstrap_interval_holds_the_mean(spark):
    x = spark.createDataFrame([(i % 20, float(i % 7)) for i in range(400)], "g long, v double")
    r = evaluation.bootstrap(x, "v", "g", rounds=200).first()
    assert r.low < r["mean"] < r.high


def test_leaves_share_out_exactly_as_many_draws_as_there_are_groups():
    sizes = [5, 0, 17, 1, 40]
    parts = np.stack([evaluation.leaf_draws(sizes, k, 4000, seed=3) for k in range(5)])
    assert (parts.sum(axis=0) == 63).all() and (parts[1] == 0).all()
    assert np.abs(parts.mean(axis=1) - sizes).max() < 0.3
    want = [63 * n / 63 * (1 - n / 63) for n in sizes]  # of a multinomial
    assert np.abs(parts.var(axis=1) - want).max() < 1.5


def test_resamples_are_of_fixed_size_and_the_same_on_every_run(spark):
    rng = np.random.default_rng(6)
    own = [(int(g), int(v * 4) / 4) for g, v in zip(rng.integers(0, 150, 2000), rng.exponential(10, 2000))] + [(None, 3.0), (7, None)]  # sums are exact in any order
    x = spark.createDataFrame(own, "g long, v double")
    a = sorted(tuple(r) for r in evaluation.resamples(x, "v", "g", rounds=3000, leaf=20).collect())
    b = sorted(tuple(r) for r in evaluation.resamples(x.repartition(7, "v"), "v", "g", rounds=3000, leaf=20).collect())
    assert a == b and [r[0] for r in a] == list(range(3000)) and {r[3] for r in a} == {151}
    s = {}
    for g, v in own:
        s.setdefault(g, []).append(v or 0.0)
    sums = np.array([sum(v) for v in s.values()])
    drawn = np.array([r[1] for r in a])
    assert abs(drawn.mean() / sums.sum() - 1) < 0.01 and abs(drawn.std() / (sums.std() * np.sqrt(151)) - 1) < 0.06
    assert evaluation.resamples(x.where("false"), "v", "g", rounds=5).count() == 0


def test_coverage_and_filters(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    assert rows(relational.coverage(a, b, "id")) == [(1, "missing"), (2, "both"), (3, "extra")]
    assert rows(relational.filtered(a, one=("id", "in", [1, 7]), none=None)) == [(1,)]


def test_sections_and_slices(spark):
    d = spark.createDataFrame([(1, "intro\n## a\nx\n## b\ny\nz"), (2, "")], "doc_id long, text string")
    found = extract.sections(d, "doc_id", "text", lambda line: line.startswith("## "))
    assert rows(found.where("doc_id = 1"), "section", "lines", "body") == [(1, 1, "intro"), (2, 2, "## a\nx"), (3, 3, "## b\ny\nz")]
    assert rows(extract.line_slice(d, "doc_id", "text", 2, 3).where("doc_id = 1"), "excerpt", "start_char") == [("## a\nx", 6)]


def test_postings(spark):
    d = spark.createDataFrame([(1, "Aa aa b bb"), (2, None), (3, "")], "doc_id long, text string")
    assert rows(index.postings(d)) == [(1, "aa", 2), (1, "bb", 1)]
    assert rows(index.statistics(d)) == [(3, 1.0)]


def test_generations(spark, tmp_path):
    g = tables.Generations(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="no generation"):
        g.read()
    one = spark.range(3)
    assert g.publish(g.stage(one), 3, dimensions=4) == 1
    with pytest.raises(ValueError, match="expected"):
        g.publish(g.stage(spark.range(5)), 6, dimensions=4)
    with pytest.raises(ValueError, match="differ"):
        g.publish(g.stage(spark.range(5)), 5, dimensions=8)
    assert g.read().count() == 3
    assert g.publish(g.stage(spark.range(5)), 5, dimensions=4) == 2
    assert g.read().count() == 5


def test_sources(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n')
    assert rows(tables.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", schema)) == [(1, "x"), (2, "y")]
    (tmp_path / "bad.jsonl").write_text('{"a": 1, "b": "x"}\n[broken\n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        tables.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", schema).collect()
    assert [r._corrupt_record for r in tables.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", schema, strict=False).cache().collect()] == [None, "[broken"]
    (tmp_path / "x.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert tables.read_json_array(spark, f"file://{tmp_path}/x.json", schema).count() == 2
    tables.write_csv(spark.createDataFrame([(1, 'say "hi"\nnow')], schema), f"file://{tmp_path}/csv")
    assert rows(tables.read_csv(spark, f"file://{tmp_path}/csv", schema)) == [(1, 'say "hi"\nnow')]
    tables.write_jsonl(spark.range(2), f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tables.write_jsonl(spark.range(2), f"file://{tmp_path}/out")
    (tmp_path / "files").mkdir()
    for name in ("A.md", "b.txt", "c.bin"):
        (tmp_path / "files" / name).write_text(name)
    known = spark.createDataFrame([("a.MD",)], "name string")
    assert rows(tables.list_files(spark, f"file://{tmp_path}/files", known=known), "name") == [("b.txt",)]


def test_stratified_sample_keeps_a_stratum_and_repeats(spark):
    from millrace.plans import conversation
    from tests.conftest import SMALL

    events = {r.event_id: r.event_type for r in spark.read.parquet(f"{SMALL}/events.parquet").collect()}
    found = sorted(r.event_id for r in conversation.f16_stratified_sample(spark, SMALL).collect())
    errors = sorted(i for i, t in events.items() if t == "error")
    assert [i for i in found if events[i] == "error"] == errors
    assert len(found) == len(set(found)) == len(errors) + min(200, len(events) - len(errors))
    assert found == sorted(r.event_id for r in conversation.f16_stratified_sample(spark, SMALL).collect())


@pytest.mark.parametrize("seed", range(3))
def test_diverse_selection_is_greedy_over_all_rows(spark, seed):
    import random

    r = random.Random(seed)
    hot = [(1, i, "hot", 1.0) for i in range(60)]  # more than any fixed pool of the smallest ids
    rest = [(1, 100 + i, r.choice(["a", "b", "c", None]), r.choice([1.0, 0.95, 0.9, 0.85])) for i in range(40)]
    many = [(2, i, r.choice([*"abcdefghijklmnop", None]), r.choice([1.0, 0.9, 0.75, 0.5])) for i in range(200)]
    data = hot + rest + many
    want = []
    for q in (1, 2):
        left, groups = [x for x in data if x[0] == q], set()
        for n in range(1, 11):
            cost = lambda x: x[3] - 0.1 * (x[2] in groups)
            best = min(left, key=lambda x: (-cost(x), x[1]))
            want.append((q, n, best[1], cost(best)))
            left.remove(best)
            groups |= {best[2]} - {None}
    s = spark.createDataFrame(data, "query_id long, id long, group_id string, score double")
    assert rows(rank.diverse(s, 10, 0.1), "query_id", "rank", "id", "score") == want


def test_near_duplicates_in_blocks_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(12, 60))) for _ in range(40)]
    texts = base + [t[:k] + rng.choice("xyz") + t[k + 1 :] for t in base for k in (3, len(t) - 1)] + [t + t[:2] for t in base] + ["ab" * 20, "ab" * 30, "日本語の文章がここにあります。", "日本語の文章がここにありました。"]
    x = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    plain = {}
    for i, t in enumerate(texts):
        plain.setdefault("".join(c for c in t if c.isalnum() or c == "_"), i)
    own = sorted((i, p) for p, i in plain.items() if len(p) >= 12)
    want = []
    for k, (a, p) in enumerate(own):
        for b, q in own[k + 1 :]:
            g, h = grams(p), grams(q)
            if len(g & h) >= 0.75 * len(g | h) and min(len(p), len(q)) >= 0.75 * max(len(p), len(q)):
                want.append((a, b))
    assert len(want) > 40
    assert rows(curation.near_duplicates(x, "id", block=7), "a", "b") == want


def test_equal_intervals_merge_the_same_in_any_order(spark):
    import random

    rng = random.Random(1)
    spans = [(k, s, s + rng.choice([0, 2, 2, 5])) for k in range(5) for s in [rng.randint(0, 30) for _ in range(20)]] * 2
    want = []
    for k in range(5):
        held = []
        for s, e in sorted((s, e) for key, s, e in spans if key == k):
            if held and s <= held[-1][1]:
                held[-1][1], held[-1][2] = max(held[-1][1], e), held[-1][2] + 1
            else:
                held.append([s, e, 1])
        want += [(k, *h) for h in held]
    for seed in range(3):
        random.Random(seed).shuffle(spans)
        assert rows(sequence.merge_intervals(spark.createDataFrame(spans, "k int, s int, e int"), "k", "s", "e")) == sorted(want)


@pytest.mark.parametrize("threads", [1, 2, 8])
def test_interval_sql_does_not_depend_on_threads(spark, threads):
    import __spark_entry__ as entry
    from tests import oracle
    from tests.conftest import SMALL

    con = oracle.connect(SMALL.replace("0.001", "0.01"))
    con.execute(f"SET threads = {threads}")
    oracle.compare(spark, con, entry.queries()["f10_interval_merge"], entry.oracle_sql()["f10_interval_merge"], SMALL.replace("0.001", "0.01"))


def test_chunks_cut_at_the_target_and_carry_the_last_units(spark):
    text = "".join(f"line number {i} of the text\n" for i in range(40))
    spans = chunks.chunk_spans(text, 180, 240, 50)
    assert len(spans) > 2 and all(b - a <= 240 for a, b in spans)
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)
    assert all(nxt[0] < prev[1] and prev[1] - nxt[0] <= 50 for prev, nxt in zip(spans, spans[1:]))  # the units carried over
    assert chunks.chunk_spans(" \n\n ") == []
    long = "a" * 700 + "。" + "b" * 900
    assert chunks.units(long, 1000) == [(0, 701), (701, 1601)]
    assert chunks.units("x\n\n \ny", 10) == [(0, 2), (5, 6)]


def test_revision_digest_follows_order_and_content(spark):
    own = [("a", i, f"h{i}") for i in range(2500)] + [("b", 5, "x"), ("b", 5, "y"), (None, 1, "z")]
    digest = lambda r: {x.k: (x.revision, x.n) for x in state.revision_digest(spark.createDataFrame(r, "k string, id long, h string"), "k", "id", "h", width=10).collect()}
    first = digest(own)
    assert first["a"][1] == 2500 and first == digest(own[::-1])
    changed = digest([("a", 7, "other") if r[:2] == ("a", 7) else r for r in own])
    assert changed["a"][0] != first["a"][0] and changed["b"] == first["b"]


def test_settings_with_conflicts_and_bounds(spark):
    specs = spark.createDataFrame([("a", 1.0, 0.0, 2.0), ("b", 1.0, 0.0, 2.0), ("c", 1.0, 0.0, 2.0), ("d", 1.0, 0.0, 2.0)], "name string, default double, low double, high double")
    given = spark.createDataFrame([(1, "a", 1.5), (2, "b", 1.5), (3, "b", 1.2), (4, "c", 9.0), (5, "z", 1.0)], "override_id long, name string, value double")
    assert [tuple(r) for r in rules.settings(specs, given).orderBy("name").collect()] == [("a", 1.5, 1, "override"), ("b", 1.0, None, "conflict"), ("c", 1.0, None, "above"), ("d", 1.0, None, ""), ("z", None, None, "unknown")]


def test_a_publisher_of_a_taken_revision_fails(spark, tmp_path):
    g = tables.Generations(spark, f"{tmp_path}/g")
    one, two = g.stage(spark.range(2).toDF("id")), g.stage(spark.range(3).toDF("id"))
    assert g.publish(one, 2) == 1
    late = tables.Generations(spark, f"{tmp_path}/g")
    late._current = lambda: None  # read before the other published
    with pytest.raises(Exception, match="already exists"):
        late.publish(two, 3)
    assert g.read().count() == 2 and g.publish(two, 3) == 2 and g.read().count() == 3


def test_percentiles_against_sorted_lists(spark):
    import random

    rng = random.Random(3)
    groups = {"a": [rng.random() for _ in range(3000)], "b": [1.0] * 500 + [2.0], "": [5.0], None: [rng.randint(0, 9) * 1.0 for _ in range(200)]}
    x = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    n = F.col("n")
    found = evaluation.percentiles_at(x, ["k"], "v", {"first": F.lit(1), "p95": F.ceil(n * 0.95), "last": n, "beyond": n + 1}).collect()
    want = {k: (s[0], s[math.ceil(len(s) * 0.95) - 1], s[-1], None) for k, s in ((k, sorted(v)) for k, v in groups.items())}
    assert {r.k: (r.first, r.p95, r.last, r.beyond) for r in found} == want


def test_chunks_go_out_in_bounded_batches():
    """Whatever a batch of texts holds, and within one long text as well."""
    import pyarrow as pa

    class Rows:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, schema: run

    text = "A line of words, and so on.\n" * 60_000
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([text, None, text, text[:500_000]])], names=["doc_id", "text"])
    found = list(chunks.chunks(Rows())(iter([batch])))
    assert len(found) > 1 and max(sum(map(len, b.column(2).to_pylist())) for b in found) <= chunks.TOGETHER + chunks.MOST
    got = [tuple(r.values()) for b in found for r in b.to_pylist()]
    want = [(i, k, t[a:b], a, b) for i, t in ((1, text), (3, text), (4, text[:500_000])) for k, (a, b) in enumerate(chunks.chunk_spans(t))]
    assert got == want


def test_near_duplicates_send_texts_only_where_sketches_meet(spark):
    """Unlike texts of one small alphabet, which share most trigrams, are not sent to each other's blocks; near ones are."""
    import glob
    import os
    import random

    from millrace.sources.tables import shared_dir

    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdef") for _ in range(rng.randint(80, 100))) for _ in range(200)]
    texts += [t[:40] + "x" + t[41:] for t in texts[:3]]
    x = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert rows(curation.near_duplicates(x, "id", block=20), "a", "b") == [(0, 200), (1, 201), (2, 202)]
    last = max(glob.glob(shared_dir(spark).removeprefix("file://") + "/trigrams-*"), key=os.path.getmtime)
    assert 6 <= spark.read.parquet(f"{last}/meetings").count() <= 30
    grams = [curation._trigram_codes(t) for t in texts]
    bits = [np.unpackbits(np.frombuffer(curation.sketch(g), np.uint8)) for g in grams]
    assert all((bits[i] != bits[j]).sum() <= len(np.setxor1d(grams[i], grams[j])) for i in range(len(texts)) for j in range(i))
