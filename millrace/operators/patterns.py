"""Extraction by many patterns at once, with scopes: rules are rows, and one automaton finds all of them in one pass.

A rule is a phrase with a label. Rules of whole words match between other characters than letters; others anywhere. Rules
whose label is a scope (negation, reported) do not match for themselves: each covers what follows it in its clause. A
match says which scopes cover it, and whether it stands between quotation marks, so a caller can tell "I like x" from
"she said I do not like x". Scopes are intervals of places in the text and are looked up by clause, not searched.

Rules reach the tasks as an automaton of at most MOST_RULES phrases; more rules are dealt into groups by their hash, and
texts are read once for each group, the scopes being part of every group.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RULES = 200_000
SCOPES = ("negation", "reported")
ENDS = re.compile('[.,;:!?\n"“”„。，；：！？]')
QUOTES = re.compile('["“”„]')
NO_LETTER = re.compile(r"[\W\d_]")
TOGETHER = 1 << 16  # matches of a batch that a task writes


def lowered(text: str) -> str:
    """Lower-cased with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Matcher:
    """Rules (rule_id, phrase, label, whole); the automata are built where the object arrives."""

    def __init__(self, rules: list[tuple[int, str, str, bool]]):
        self.rules = [(i, lowered(p), label, whole) for i, p, label, whole in rules if p]

    def __getstate__(self):
        return {"rules": self.rules}

    def _automata(self) -> list[tuple[bool, ahocorasick.Automaton]]:
        if not hasattr(self, "_built"):
            self._built = []
            for whole in (True, False):
                own: dict[str, list[int]] = {}
                for n, (_, phrase, _, w) in enumerate(self.rules):
                    if w == whole:
                        own.setdefault(f" {phrase} " if whole else phrase, []).append(n)
                if own:
                    found = ahocorasick.Automaton()
                    for phrase, at in own.items():
                        found.add_word(phrase, (len(phrase), at))
                    found.make_automaton()
                    self._built.append((whole, found))
        return self._built

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the rule) of every match, overlapping ones too."""
        low = lowered(text)
        for whole, automaton in self._automata():
            read = f" {NO_LETTER.sub(' ', low)} " if whole else low
            for last, (size, at) in automaton.iter(read):
                end = last - 1 if whole else last + 1  # without the spaces around a whole word, one of them before the text
                for n in at:
                    yield end - (size - 2 if whole else size), end, n

    def matches(self, text: str) -> list[tuple[int, str, int, int, bool, bool, bool]]:
        """(rule_id, label, start, end, negated, reported, quoted), by place and rule."""
        ends = [m.start() for m in ENDS.finditer(text)]
        quotes = [m.start() for m in QUOTES.finditer(text)]
        opened: list[dict[int, int]] = [{}, {}]  # scope: clause -> where its first scope begins
        plain = []
        for start, end, n in self.hits(text):
            label = self.rules[n][2]
            if label in SCOPES:
                scope, clause = opened[SCOPES.index(label)], bisect_right(ends, start)
                scope[clause] = min(scope.get(clause, end), end)
            else:
                plain.append((start, end, n))
        out = []
        for start, end, n in sorted(plain, key=lambda x: (x[0], x[1], self.rules[x[2]][0])):
            clause = bisect_right(ends, start)
            within = clause == bisect_left(ends, end)  # a match over a clause's end is in no scope
            covered = [within and scope.get(clause, end) <= start for scope in opened]
            out.append((self.rules[n][0], self.rules[n][2], start, end, *covered, bool(bisect_right(quotes, start) % 2)))
        return out


def extract(docs: DataFrame, rules: DataFrame, id: str = "doc_id", text: str = "text", most: int = MOST_RULES) -> DataFrame:
    """(id, rule_id, label, start, end, negated, reported, quoted): every match of rules (rule_id, phrase, label, whole) in docs.

    Null and empty texts and phrases match nothing; rules with one phrase match each; repeated rows give repeated
    matches. Scopes must be fewer than `most`, which also bounds what one automaton holds.
    """
    spark, kind = docs.sparkSession, docs.schema[id].dataType.simpleString()
    rules = rules.where("phrase IS NOT NULL AND phrase <> ''").select("rule_id", "phrase", "label", F.coalesce("whole", F.lit(True)).alias("whole"))
    scope = F.coalesce(F.col("label").isin(list(SCOPES)), F.lit(False))
    scopes, total = rules.agg(F.sum(scope.cast("int")), F.count("*")).head()
    scopes = scopes or 0
    if scopes >= most:
        raise ValueError(f"{scopes} scopes; fewer than {most} are possible")
    groups = max(1, -(-2 * (total - scopes) // (most - scopes)) if total > most else 1)  # half full on average
    schema = f"{id} {kind}, rule_id long, label string, start int, end int, negated boolean, reported boolean, quoted boolean"
    types = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())
    names = [f.split()[0] for f in schema.split(", ")]
    out = None
    for group in range(groups):
        own = rules.where(scope | (F.pmod(F.xxhash64("rule_id", "phrase"), F.lit(groups)) == group)).orderBy("rule_id", "phrase").collect()  # about half of most
        sent = spark.sparkContext.broadcast(Matcher([tuple(r) for r in own]))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def rows(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * len(types), types)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=names)

            for batch in it:
                found: list[tuple] = []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    found += [(k, *m) for m in sent.value.matches(t or "")]
                    if len(found) > TOGETHER:
                        yield rows(batch, found)
                        found = []
                yield rows(batch, found)

        part = docs.select(id, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
