"""The whole pipeline and each stage against plain versions of what a stage must do."""

from collections import Counter

import corpus_pipeline as P
import __spark_entry__ as entry
from millrace.llm.common import stash
from tests.conftest import SMALL
from tests.llm import test_bpe, test_jaccard, test_mixing, test_pii


def test_stages_one_after_another(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    at, columns = docs, docs.columns
    for name, stage in P.STAGES[:-1]:
        out = stash(stage(spark, at, SMALL), name)
        assert out.columns == columns
        before, after = {r.doc_id: r for r in at.collect()}, out.collect()
        if name == "identify_language":
            assert all(before[r.doc_id] == r for r in after)
            gone = set(before) - {r.doc_id for r in after}
            assert all(not any(c.isalpha() for c in before[i].text or "") for i in gone)
        elif name == "join_near_duplicates":
            want = {c for _, _, _, c in test_jaccard.brute([(r.doc_id, r.text) for r in before.values()])}
            assert sorted(r.doc_id for r in after) == sorted(want)
        elif name == "redact_personal_data":
            assert len(after) == len(before)
            for r in after:
                assert len(r.text) == r.n_chars
                if not test_pii.brute(before[r.doc_id].text):
                    continue
                for k, a, b in test_pii.brute(before[r.doc_id].text):
                    assert f"[{k.upper()}]" in r.text
        else:
            copies = Counter(r.doc_id for r in after)
            assert max(copies.values()) <= 2
            taken = {i: n * len(test_jaccard.words(before[i].text)) for i, n in copies.items()}
            sizes = Counter()
            for r in before.values():
                sizes[r.source] += len(test_jaccard.words(r.text))
            want = test_mixing.brute_targets(dict(sizes))
            for s in sizes:
                most = max(len(test_jaccard.words(r.text)) for r in before.values() if r.source == s)
                assert abs(sum(n for i, n in taken.items() if before[i].source == s) - want[s]) < most + 1e-6
        at = out
    last = P.STAGES[-1][1](spark, at, SMALL).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    test_bpe.same(library, last, [(r.doc_id, r.text) for r in at.collect()])


def test_run_is_the_registered_query_and_repeats(spark):
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(entry.queries()["pipeline"](spark, SMALL)) == key(P.run(spark, SMALL))


def test_stages_survive_odd_and_empty_tables(spark, odd, empty):
    every = [r.doc_id for r in odd.collect()]
    kept = {"identify_language": [4, 4, 5, 6, 8, None], "join_near_duplicates": [1, 2, 3, 4, 6, 8, None], "redact_personal_data": every, "encode_tokens": every}
    for name, stage in P.STAGES:
        found = [r.doc_id for r in stage(spark, odd, SMALL).collect()]
        if name == "mix_sources":  # drawn: never more than twice
            assert {*found} & {4, 5, 6, 8} and all(n <= 2 * every.count(i) for i, n in Counter(found).items()) and found
        else:
            assert Counter(found) == Counter(kept[name]), name
        assert stage(spark, empty, SMALL).count() == 0


def test_redaction_needs_no_count_of_characters(spark, odd):
    found = P.redact_personal_data(spark, odd.drop("n_chars"), SMALL)
    assert found.columns == odd.drop("n_chars").columns and "ann@example.com" not in "".join(r.text or "" for r in found.collect())


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, copies string, rows string, size string, key string, place string, component_id string, words string"


def test_columns_with_an_operator_s_names_pass_through(spark, docs):
    """score, copies, rows and the like of the input come out of every stage but the last as they went in."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *(f"{n}{r.doc_id}" for n in range(9))) for r in docs.collect()]
    clashing = spark.createDataFrame(rows, CLASHING)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, clashing, SMALL)
        assert out.columns == clashing.columns
        found = out.collect()
        assert len(found) > 100
        assert all(tuple(r)[5:] == tuple(f"{n}{r.doc_id}" for n in range(9)) for r in found)
        if name != "redact_personal_data":
            plain = stage(spark, docs, SMALL)
            assert Counter(tuple(r)[:5] for r in found) == Counter(tuple(r) for r in plain.collect())
    assert P.encode_tokens(spark, clashing, SMALL).count() == len(rows)


def test_copies_of_repeated_rows_are_those_of_the_mix(spark, empty):
    """Two equal rows with three copies between them give three rows, and rows equal in id and words keep their texts."""
    text = lambda n, k: " ".join(f"{n}{i}" for i in range(k))
    rows = [(1, text("a", 9), "s"), (1, text("a", 9), "s"), (1, text("b", 9), "s"), (2, text("c", 40), "s"), (3, text("d", 7), "t"), (None, text("e", 7), None), (None, text("e", 7), None), (5, "", "t")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t), None, None) for i, t, s in rows], empty.schema)
    found = Counter((r.doc_id, r.source) for r in P.mix_sources(spark, docs, SMALL).collect())
    want: Counter = Counter()
    for r in test_mixing.M.mix(docs).collect():
        want[(r.doc_id, r.source)] += r.copies
    assert found == +want
    each = Counter(r.text for r in P.mix_sources(spark, docs, SMALL).collect())
    assert each[text("a", 9)] <= 4 and all(n <= 2 for t, n in each.items() if t not in (text("a", 9), text("e", 7)))


def test_an_id_with_two_texts_is_two_documents(spark, empty):
    text = lambda n: " ".join(f"{n}word{i}" for i in range(60))
    a, b, c, d = map(text, "abcd")
    near = a.rsplit(" ", 1)[0]
    rows = [(1, a), (1, b), (1, a), (2, near), (0, b), (5, c), (5, d), (6, d), (7, "short"), (7, ""), (8, None), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), None, None) for i, t in rows], empty.schema)
    found = [(r.doc_id, r.text) for r in P.join_near_duplicates(spark, docs, SMALL).collect()]
    assert Counter(found) == Counter([(1, a), (0, b), (5, c), (5, d), (7, "short"), (7, ""), (8, None), (None, b)])
