import re

import numpy as np
import pytest

from millrace.operators import patterns as P

RULES = "rule_id long, phrase string, label string, whole boolean"


def by_regex(rules, text: str) -> list[tuple]:
    """One regular expression a rule, and scopes by looking back in the clause."""
    low, found = P.lowered(text), []
    before, after = r"(?<![^\W\d_])", r"(?![^\W\d_])"
    compiled = [(i, label, re.compile("(?=" + before * whole + "(" + re.escape(P.lowered(p)) + ")" + after * whole + ")")) for i, p, label, whole in rules if p]
    for i, label, pattern in compiled:
        if label in P.SCOPES:
            continue
        for m in pattern.finditer(low):
            start, end = m.span(1)
            clause = max((e.end() for e in P.ENDS.finditer(text, 0, start)), default=0)
            inside = not P.ENDS.search(text, start, end)
            covered = [inside and any(s.end(1) <= start and not P.ENDS.search(text, s.start(1), start) for _, own, p in compiled if own == scope for s in p.finditer(low, clause)) for scope in P.SCOPES]
            found.append((i, label, start, end, *covered, len(P.QUOTES.findall(text[:start])) % 2 == 1))
    return sorted(found, key=lambda x: (x[2], x[3], x[0]))


def test_against_one_regex_a_rule():
    rng = np.random.default_rng(8)
    words = ["like", "cats", "tea", "not", "said", "never", "a", "İx", "喜欢", "no tea"]
    for _ in range(60):
        rules = [(int(k), str(rng.choice(words)), str(rng.choice(["x", "y", *P.SCOPES])), bool(rng.random() < 0.7)) for k in range(8)]
        text = "".join(str(rng.choice([*words, "catsx"])) + str(rng.choice([" ", " ", " ", ", ", '"', "\n", "-"])) for _ in range(25))
        assert P.Matcher(rules).matches(text) == by_regex(rules, text)


def test_ten_thousand_rules_at_once(spark):
    rules = [(k, f"w{chr(97 + k % 26)}{'abcdefghij'[k // 26 % 10]}{'klmnopqrst'[k // 260 % 10]}{'uvwxyz'[k // 2600 % 6]}", f"l{k % 7}", True) for k in range(10_000)] + [(-1, "not", "negation", True), (-2, "said", "reported", True)]
    rng = np.random.default_rng(3)
    texts = [" ".join("not" if rng.random() < 0.1 else "said" if rng.random() < 0.05 else rules[rng.integers(10_000)][1] + str(rng.choice(["", "", ".", '"'])) for _ in range(40)) for _ in range(20)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None), (None, texts[0]), (98, "")], "doc_id long, text string")
    table = spark.createDataFrame([*rules, (-3, None, "x", True), (-4, "", "x", None)], RULES)
    found = P.extract(docs, table)
    got = sorted(tuple(r)[1:] for r in found.where("doc_id = 3").collect())
    used = {w for w in re.findall(r"\w+", texts[3])}
    assert got == sorted(by_regex([r for r in rules if r[1] in used], texts[3])) != []
    assert found.where("doc_id IS NULL").count() == found.where("doc_id = 0").count()
    # more rules than one automaton holds: the same matches
    parts = P.extract(docs, table, most=3000)
    assert sorted(map(str, parts.collect())) == sorted(map(str, found.collect()))
    with pytest.raises(ValueError, match="scopes"):
        P.extract(docs, table, most=2)
    assert P.extract(docs, table.where("rule_id > 99999")).count() == 0


def test_scopes():
    m = P.Matcher([(1, "tea", "likes", True), (2, "not", "negation", True), (3, "she said", "reported", True), (4, "喝", "drinks", False)])
    flags = lambda t: [x[4:] for x in m.matches(t)]
    assert flags("I like tea, not milk") == [(False, False, False)]
    assert flags("I do not like TEA") == [(True, False, False)]
    assert flags("not now. tea") == [(False, False, False)]
    assert flags("she said no tea") == [(False, True, False)]
    assert flags('read "tea" teapot') == [(False, False, True)]
    assert flags("我要喝茶") == [(False, False, False)]
