import numpy as np
import pytest

from millrace.operators import derive as D

FACTS, RULES, CONDITIONS = "entity long, attribute string, value string", "rule_id long, priority int, attribute string, value string", "rule_id long, attribute string, op string, value string"


def number(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def met(value, op, bound) -> bool:
    if value is None or bound is None:
        return False
    if op in ("=", "<>"):
        return (value == bound) == (op == "=")
    a, b = number(value), number(bound)
    return a is not None and b is not None and (a >= b if op == ">=" else a < b)


def plain(facts, rules, conditions) -> set[tuple]:
    """Tries every rule on every entity again and again."""
    out = set()
    for e in {f[0] for f in facts if f[0] is not None and f[1] is not None}:
        known = {(a, v) for x, a, v in facts if x == e and a is not None}
        fired: dict[int, int] = {}
        turn = 0
        while True:
            turn += 1
            new = [r for r in rules if r[0] not in fired and all(any(a == c[1] and met(v, c[2], c[3]) for a, v in known) for c in conditions if c[0] == r[0])]
            if not new:
                break
            fired |= {r[0]: turn for r in new}
            known |= {(r[2], r[3]) for r in new}
        own = [r for r in rules if r[0] in fired]
        for r in own:
            rivals = [x for x in own if x[2] == r[2]]
            best = min(rivals, key=lambda x: (-x[1], x[0]))
            out.add((e, r[2], r[3], r[0], fired[r[0]], best is r, len({x[3] for x in rivals}) > 1))
    return out


def check(spark, facts, rules, conditions):
    got = D.derive(spark.createDataFrame(facts, FACTS), spark.createDataFrame(rules, RULES), spark.createDataFrame(conditions, CONDITIONS))
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(facts, rules, conditions)
    return got


@pytest.mark.parametrize("seed", [0, 1])
def test_against_a_plain_interpreter(spark, seed, monkeypatch):
    if seed:
        monkeypatch.setattr(D, "MOST_BROADCAST", 0)  # rules too many to broadcast
    rng = np.random.default_rng(seed)
    values = ["x", "y", "3", "11", None]
    pick = lambda xs: xs[rng.integers(len(xs))]
    facts = [(int(rng.integers(6)), f"a{rng.integers(4)}", pick(values)) for _ in range(25)] + [(None, "a1", "x"), (7, None, "x")]
    rules = [(k, int(rng.integers(3)), f"a{rng.integers(7)}", pick(values[:4])) for k in range(14)]
    conditions = [(int(rng.integers(13)), f"a{rng.integers(7)}", pick(["=", "=", "<>", ">=", "<"]), pick(values[:4])) for _ in range(24)]
    check(spark, facts, rules, conditions + conditions[:3])


def test_a_chain_takes_a_round_a_rule(spark):
    rules = [(k, 0, f"s{k + 1}", "1") for k in range(4)]
    conditions = [(k, f"s{k}", "=", "1") for k in range(4)]
    assert max(r[4] for r in check(spark, [(1, "s0", "1"), (2, "s2", "1")], rules, conditions)) == 4
    assert check(spark, [], rules, conditions) == []
