"""Toxicity by a weighted finite-state grammar over clauses: insults, threats, targets, negation and reported speech.

A lexical transducer maps each word to a symbol: stems learned from labelled texts are insults, each with its log-odds
as weight, and short word lists give threats, targets (who is meant), negations and reporting verbs. Four small
transducers then read the symbols of a clause: one marks what a negation before it covers, one what a target stands near
to, one what is quoted or reported, one resets all at the clause's end. They are composed into one deterministic machine,
a table of states by symbols, which is run over the words that are symbols; the words between them only let scopes run
out. A match weighs its stem's log-odds, and a clause the sum of its matches; a text is scored by its matched clauses
(their total, number and largest, and what of it was aimed, negated, reported or a threat), not by its words, with a
logistic calibration.

At most MAX_TRAINING labelled documents that are not held out are fitted on; stems and calibration come from different
halves, which then change roles. Every text is scored in its whole length. Null texts count as empty and get the score
of a text without words. A document with several labels counts by their mean; with several texts, by the one with the
smallest hash. With labels of one class only, or none, STEMS and fixed weights score. An empty table gives no rows;
repeated rows give repeated results, equal texts equal scores; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import batches, bounded_sample, one_each, table, texts
from millrace.llm.op03_quality import logistic

MAX_TRAINING = 6000
THRESHOLD = 0.7
NEAR = 4  # words that a target or a negation reaches
STEM = (3, 9)  # letters of a learned stem
LEAST_DOCS = 4  # toxic documents that hold a stem
LEAST_WORDS = 3  # that begin with a stem in toxic texts; a stem of fewer is learned as whole words
LEAST_ODDS = math.log(3)
MOST_KNOWN = 1 << 19  # words whose symbols a task remembers

TOKEN = re.compile(r"[^\W\d_]+|[.,;:!?\n]|[\"“”«»„]")
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(1, 8)
#: Words of the closed classes, in English, German, French and Spanish.
LISTS = {
    THREAT: "kill hurt beat destroy shoot stab töten schlagen umbringen vernichten tuer frapper détruire blesser matar golpear destruir herir",
    TARGET: "you your yourself they them he she her him those du dich dir dein deine euch ihr sie tu toi ton vous votre ils elles usted ustedes tú ti ellos ellas",
    NEGATION: "not never no nobody isn aren don doesn didn nicht kein keine nie niemals pas jamais aucun nunca jamás ningún",
    REPORT: "said says told called wrote quoted claimed sagte sagt schrieb nannte behauptete dit disait écrit appelé dijo dice escribió llamó",
}
#: Insults that count where no labelled text has the word, with the weight UNSEEN.
UNSEEN = 3.0
STEMS = "idiot moron stupid trash scum loser pathetic worthless disgusting dumm abschaum trottel crétin ordure imbécile basura"
#: Weights of features() without labels: several matches in a short text are toxic, one in a long text is not.
UNTRAINED = (-4.0, 0.0, 0.5, 0.0, 1.0, 0.0, 0.5, -0.5, -0.5, 0.5)

NEGATED, AIMED, REPORTED, AIMS_BACK = 1, 2, 4, 8


class Transducer(NamedTuple):
    """Deterministic: step(state, symbol) gives the next state and the marks that it puts on the symbol; 0 is the start."""

    states: int
    step: object


def _reach(opens: int, mark: int, back: int = 0) -> Transducer:
    """Marks insults and threats within NEAR words after a symbol; with `back` also that symbol within NEAR words after them."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        after, hit = divmod(state, NEAR + 1)  # words left since the symbol, and since a match
        after, hit = max(after - 1, 0), max(hit - 1, 0)
        marks = 0
        if symbol in (INSULT, THREAT):
            marks, hit = (mark if state >= NEAR + 1 else 0), NEAR
        elif symbol == opens:
            marks, after = (back if state % (NEAR + 1) else 0), NEAR
        elif symbol == END:
            after = hit = 0
        return after * (NEAR + 1) + (hit if back else 0), marks

    return Transducer((NEAR + 1) ** 2, step)


def _reported() -> Transducer:
    """Marks insults and threats between quotation marks, and after a reporting verb up to the clause's end."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        quoted, told = divmod(state, 2)
        marks = REPORTED if state and symbol in (INSULT, THREAT) else 0
        if symbol == QUOTE:
            quoted = 1 - quoted
        elif symbol == REPORT:
            told = 1
        elif symbol == END:
            told = 0
        return quoted * 2 + told, marks

    return Transducer(4, step)


class Machine(NamedTuple):
    follow: list[list[int]]  # state, symbol -> state
    marks: list[list[int]]
    waited: list[list[int]]  # state, up to NEAR plain words -> state


def compose(*parts: Transducer) -> Machine:
    """One machine whose marks are those of all parts: the states that can be reached, and tables over them."""
    start = (0,) * len(parts)
    number, order, follow, marks = {start: 0}, [start], [], []
    for state in order:  # grows as states are found
        row, put = [], []
        for symbol in range(END + 1):
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
            put.append(sum(m for _, m in steps))
        follow.append(row)
        marks.append(put)
    waited = []
    for s in range(len(order)):
        row = [s]
        for _ in range(NEAR):
            row.append(follow[row[-1]][0])
        waited.append(row)
    return Machine(follow, marks, waited)


GRAMMAR = compose(_reach(NEGATION, NEGATED), _reach(TARGET, AIMED, AIMS_BACK), _reported())


class Lexicon:
    """The lexical transducer: an acceptor of stems by their letters, and of the listed words as a whole."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.listed = {w: k for k, ws in LISTS.items() for w in ws.split()} | dict.fromkeys(".,;:!?\n", END) | dict.fromkeys('"“”«»„', QUOTE)
        self.longest = max(map(len, stems), default=0)
        self.known: dict[str, tuple[int, float] | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def symbol(self, word: str) -> tuple[int, float] | None:
        """A word's symbol and weight, None for a plain word. The longest stem counts; a stem ending in $ is a whole word."""
        if (own := self.listed.get(word)) is not None:
            return own, 0.0
        if (weight := self.stems.get(word + "$")) is not None:
            return INSULT, weight
        for n in range(min(self.longest, len(word)), STEM[0] - 1, -1):
            if (weight := self.stems.get(word[:n])) is not None:
                return (INSULT, weight) if weight > 0 else None
        return None

    def read(self, text: str) -> tuple[int, list[tuple[int, tuple[int, float]]]]:
        """The number of words, and the symbols among a text's tokens with their places."""
        tokens = TOKEN.findall(text.lower())
        new = set(tokens).difference(self.known)
        if new:
            if len(self.known) > MOST_KNOWN:
                self.known = {}
                new = set(tokens)
            self.known.update((w, self.symbol(w)) for w in new)
        found = [(k, s) for k, s in enumerate(map(self.known.__getitem__, tokens)) if s is not None]
        return len(tokens) - sum(s[0] >= QUOTE for _, s in found), found


class Matches(NamedTuple):
    words: int
    clauses: list[float]  # weights of the matched clauses
    aimed: float
    negated: float
    reported: float
    threats: float


def match(lexicon: Lexicon, text: str, machine: Machine = GRAMMAR) -> Matches:
    """The matched clauses of a text. A threat matches where it has a target, and weighs 1."""
    words, found = lexicon.read(text)
    follow, marks, waited = machine
    state, last, own, clauses = 0, -1, 0.0, []
    aimed = negated = reported = threats = 0.0
    for k, (symbol, weight) in found:
        state = waited[state][min(k - last - 1, NEAR)]
        last, put = k, marks[state][symbol]
        state = follow[state][symbol]
        if symbol == INSULT:
            own += weight
            if put:
                aimed += weight * (put & AIMED > 0)
                negated += weight * (put & NEGATED > 0)
                reported += weight * (put & REPORTED > 0)
        elif symbol == THREAT and put & AIMED:
            own += 1
            threats += 1
        elif symbol == END and own:
            clauses.append(own)
            own = 0.0
    return Matches(words, [*clauses, own] if own else clauses, aimed, negated, reported, threats)


def features(m: Matches) -> list[float]:
    total, n = sum(m.clauses), m.words + 10
    rate = 100 * total / n
    return [1.0, math.log(rate + 0.1), min(rate, 40) / 10, math.log1p(len(m.clauses)), math.log1p(total), math.log(n) - 5, *(min(100 * x / n, 20) / 10 for x in (m.aimed, m.negated, m.reported, m.threats))]


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, docs: list[str]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        x = np.array([features(match(self.lexicon, t)) for t in docs])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def stems_of(word: str) -> Iterator[str]:
    yield word + "$"
    for n in range(STEM[0], min(STEM[1], len(word)) + 1):
        yield word[:n]


class Counts:
    """By label: texts, words, the texts that hold each stem, and the occurrences of each word; those of two samples add up."""

    def __init__(self, rows: list[tuple[str, int]]):
        listed = {w for ws in LISTS.values() for w in ws.split()}
        self.texts = Counter(y for _, y in rows)
        self.held, self.words = (Counter(), Counter()), (Counter(), Counter())
        stems: dict[str, list[str]] = {}
        for text, y in rows:
            own = Counter(w for w in TOKEN.findall(text.lower()) if len(w) >= STEM[0] and w not in listed)
            self.words[y].update(own)
            found: set[str] = set()
            for w in own:
                if w not in stems:
                    stems[w] = [*stems_of(w)]
                found.update(stems[w])
            self.held[y].update(found)

    def __add__(self, other: Counts) -> Counts:
        both = Counts([])
        both.texts = self.texts + other.texts
        both.held, both.words = (tuple(a + b for a, b in zip(x, y)) for x, y in ((self.held, other.held), (self.words, other.words)))
        return both


def learn_stems(counts: Counts) -> dict[str, float]:
    """Stems that toxic texts hold more often, by the log-odds of a word to begin with them; LEAST_DOCS toxic texts must hold each.

    A stem that says no more than a shorter one is left out. Words of the lists are no stems.
    """
    odds = {}
    for s, d in counts.held[1].items():
        if d >= LEAST_DOCS:
            p, q = (counts.held[1][s] + 0.5) / (counts.texts[1] + 1), (counts.held[0][s] + 0.5) / (counts.texts[0] + 1)
            odds[s] = math.log(p / q) - 2.5 * math.sqrt(1 / (counts.held[1][s] + 0.5) + 1 / (counts.held[0][s] + 0.5))
    sure = {s for s, x in odds.items() if x > 0}
    often, kinds = (Counter(), Counter()), Counter()
    for y in (0, 1):
        for w, n in counts.words[y].items():
            for s in stems_of(w):
                if s in sure:
                    often[y][s] += n
                    kinds[s] += y
    sure = {s for s in sure if s[-1] == "$" or kinds[s] >= LEAST_WORDS}
    total = [1 + sum(x.values()) for x in counts.words]
    out: dict[str, float] = {}
    for s in sorted(sure, key=lambda x: (len(x), x)):
        weight = math.log((often[1][s] + 0.5) / total[1] / ((often[0][s] + 0.5) / total[0]))
        shorter = next((out[s[:n]] for n in range(len(s) - 1, STEM[0] - 1, -1) if s[:n] in out), LEAST_ODDS - 0.3)
        if weight > shorter + 0.3:
            out[s] = weight
    return out | {w: UNSEEN for w in STEMS.split() if not counts.words[0][w] + counts.words[1][w]}


def fit(rows: list[tuple[str, int]]) -> Model:
    """Stems from one half of the rows, the calibration from the other; then the roles change, and the calibrations are averaged."""
    halves = rows[::2], rows[1::2]
    if any(len({y for _, y in half}) < 2 for half in halves):
        return Model(Lexicon(dict.fromkeys(STEMS.split(), UNSEEN)), np.array(UNTRAINED))
    counts = [Counts(half) for half in halves]
    weights = []
    for own, other in zip(counts, halves[::-1]):
        lexicon = Lexicon(learn_stems(own))
        x = np.array([features(match(lexicon, t)) for t, _ in other])
        weights.append(logistic(x, np.array([y for _, y in other], dtype=float), ridge=0.1))
    return Model(Lexicon(learn_stems(counts[0] + counts[1])), np.mean(weights, axis=0))


def held_out(column="doc_id"):
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> Model:
    """A model from at most `most` labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg("toxic").alias("y"))
    ids = bounded_sample(known, most, seed=5)
    if not ids:
        return fit([])
    own = known.where(F.col("doc_id").isin(ids))
    rows = docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).select("doc_id", "text")
    rows = one_each(rows, "doc_id", "text").join(own, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return fit([(r.text, int(r.y >= 0.5)) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # stems of a bounded sample

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(texts(batch)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
