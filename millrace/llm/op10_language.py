"""Language identification by a linear-chain conditional random field over words.

Each line of a text is a chain of its words (runs of letters, lower-cased). A word's score for each language sums
the weights of its features: prefixes and suffixes of one to three letters, letter pairs and triples with word
boundaries, and lexicon features (the word itself, and the language in which the training words hold it most
often). Learned transitions join neighbouring words, and forward-backward gives each word's probabilities, so that
code-switched texts are labelled word by word. A document's language is the one with the largest expected share of
letters; the score is that share.

Learning uses at most MAX_TRAINING documents that are not held out, in numpy: the lexicon all their words, the weights
MOST_CHAINS of their chains of at most CHAIN words, drawn by a seeded permutation. Of several texts with one id the one
with the smallest hash is learned from. Every document is then labelled in its whole length, however long. Null texts and
texts without a letter give `und` with score 0; of equal shares the language first in code-point order wins. If nothing
can be learned from, every prediction is `und`; an empty table gives no rows. Repeated rows give repeated results. Of
other columns only those the caller keeps are read; one named lang_pred or score gives way to the model's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import batches, bounded_sample, held_out, one_each, settle, table, texts
from millrace.llm.shingles import mix

#: Most documents to learn from, chains for the weights and words of each, hashed feature space, and most word types remembered by one Python worker.
MAX_TRAINING = 1200
MOST_CHAINS, CHAIN = 6000, 60
SPACE = 1 << 15
MEMO = 100_000
_WORDS = re.compile(r"[^\W\d_]+|[\n\x00]")
_P = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of all words together, and the place in `words` that each belongs to.

    Letter pairs and triples include the word boundaries, so they hold the affixes of one and two letters; the
    first and the last three letters, the whole word and its lexicon entry follow.
    """
    text = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(text))  # letters to the word's end
    padded = np.concatenate([text, np.zeros(3, np.uint64)])
    n = len(text)
    two = (padded[:n] * _P + padded[1 : n + 1]) * _P
    three = (two + padded[2 : n + 2]) * _P
    four = (three + padded[3 : n + 3]) * _P
    at = np.arange(n) - np.repeat(start, size)
    ends = (left >= 4) & ((at == 0) | (left == 4))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(text + (at.astype(np.uint64) << np.uint64(32))))])
    whole = total[start + size] - total[start]
    known = np.fromiter((lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words)).astype(np.uint64)
    hashes = np.concatenate([mix(two[left >= 2] + np.uint64(1)), mix(three[left >= 3] + np.uint64(2)), mix(four[ends] + np.uint64(3)), mix(whole + np.uint64(4)), mix(known + np.uint64(5))])
    places = np.concatenate([owner[left >= 2], owner[left >= 3], owner[ends], np.arange(len(words)), np.arange(len(words))])
    return (hashes % np.uint64(SPACE)).astype(np.int64), places


class Model:
    """Labels, a lexicon, hashed feature weights (SPACE x labels) and transitions (labels x labels)."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((SPACE, k), dtype=np.float32)
        self.move = np.zeros((k, k))

    def emissions(self, words: list[str]) -> np.ndarray:
        slots, places = features(words, self.lexicon)
        return np.stack([np.bincount(places, self.weights[slots, c], len(words)) for c in range(len(self.labels))], axis=1).astype(np.float32)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word probabilities (rows of `scores`, chain after chain) and summed transition probabilities."""
    n, k = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    t = np.exp(move)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = lengths[order]
    longest = int(sorted_lengths[0]) if len(order) else 0
    alive = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")  # chains longer than each step
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    state = None
    for i in range(longest):
        at = starts[: alive[i]] + i
        state = e[at] if i == 0 else (state[: alive[i]] @ t) * e[at]
        state /= state.sum(axis=1, keepdims=True)
        alpha[at] = state
    pair = np.zeros((k, k))
    state = np.zeros((0, k))
    for i in range(longest - 1, -1, -1):
        at = starts[: alive[i]] + i
        now = np.ones((len(at), k))
        m = len(state)
        if m:
            right = e[at[:m] + 1] * state
            now[:m] = right @ t.T
            scale = (alpha[at[:m]] * now[:m]).sum(axis=1, keepdims=True)
            pair += (alpha[at[:m]] / scale).T @ right * t
            now[:m] /= now[:m].sum(axis=1, keepdims=True)
        beta[at] = now
        state = now
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    return gamma, pair


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.4, seed: int = 7) -> Model | None:
    """Maximum conditional likelihood by AdaGrad over chains; chains of two languages are joined from lines."""
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    chains: list[tuple[list[str], int]] = []
    seen: dict[str, Counter] = {}
    for text, lang in rows:
        y = labels.index(lang)
        for line in text.lower().split("\n"):
            words = _WORDS.findall(line)
            for at in range(0, len(words), CHAIN):
                piece = words[at : at + CHAIN]
                chains.append((piece, y))
                for w in piece:
                    seen.setdefault(w, Counter())[y] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in seen.items() if sum(c.values()) >= 5 and c.most_common(1)[0][1] >= 0.9 * sum(c.values())}
    model = Model(labels, lexicon)
    if not chains:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(chains))[:MOST_CHAINS]
    mixed: list[tuple[list[str], np.ndarray]] = []
    for a, b in zip(order, np.roll(order, 1)):
        (u, yu), (v, yv) = chains[a], chains[b]
        if rng.random() < 0.3:  # code-switched
            mixed.append((u + v, np.array([yu] * len(u) + [yv] * len(v))))
        else:
            mixed.append((u, np.full(len(u), yu)))
    types = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(m[0] for m in mixed)))}
    flat, places = features(list(types), lexicon)
    by_place = np.argsort(places, kind="stable")
    flat, counts_of = flat[by_place], np.bincount(places, minlength=len(types))
    rows_of = np.split(flat, np.cumsum(counts_of)[:-1])
    k = len(labels)
    g2, m2 = np.full((SPACE, k), 1e-6, dtype=np.float32), np.full((k, k), 1e-6)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(mixed)), max(1, len(mixed) // 128)):
            ids = np.array([types[w] for j in part for w in mixed[j][0]], dtype=np.int64)
            if not len(ids):
                continue
            gold = np.concatenate([mixed[j][1] for j in part])
            lengths = np.array([len(mixed[j][0]) for j in part if mixed[j][0]])
            used, where = np.unique(ids, return_inverse=True)
            flat = np.concatenate([rows_of[u] for u in used])
            counts = np.array([len(rows_of[u]) for u in used])
            score = np.add.reduceat(model.weights[flat], np.cumsum(counts) - counts, axis=0)
            gamma, pair = forward_backward(score[where], lengths, model.move)
            error = -gamma
            error[np.arange(len(gold)), gold] += 1
            by_type = np.zeros((len(used), k))
            np.add.at(by_type, where, error)
            slots, inverse = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(slots), k))
            np.add.at(grad, inverse, np.repeat(by_type, counts, axis=0))
            grad = grad / len(part) - 1e-5 * model.weights[slots]
            g2[slots] += grad**2
            model.weights[slots] += rate * grad / np.sqrt(g2[slots])
            inner = np.ones(len(gold), dtype=bool)
            inner[np.cumsum(lengths) - lengths] = False
            seen_moves = np.zeros((k, k))
            np.add.at(seen_moves, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
            step = (seen_moves - pair) / len(part)
            m2 += step**2
            model.move += 0.1 * step / np.sqrt(m2)
    return model


class Labeller:
    """Labels batches of texts; remembers the scores of word types between batches."""

    def __init__(self, model: Model):
        self.model, self.types = model, {"\n": 0, "\x00": 1}
        self.scores = np.zeros((2, len(model.labels)), dtype=np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.types) > MEMO:
            self.types, self.scores = {"\n": 0, "\x00": 1}, self.scores[:2]
        new = list(dict.fromkeys(w for w in words if w not in self.types))
        if new:
            at = len(self.types)
            self.types.update(zip(new, range(at, at + len(new))))
            self.scores = np.concatenate([self.scores[:at], *(self.model.emissions(new[i : i + 20000]) for i in range(0, len(new), 20000))])
        return np.fromiter(map(self.types.__getitem__, words), dtype=np.int32, count=len(words))

    def label(self, docs: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        k, n = len(self.model.labels), len(docs)
        words = _WORDS.findall("\x00".join(d.replace("\x00", " ") for d in docs).lower())
        ids = self._ids(words)
        cut = ids < 2
        doc = np.cumsum(ids == 1)
        real = np.flatnonzero(~cut)
        shares = np.zeros((n, k))
        if len(real):
            new = np.ones(len(real), dtype=bool)
            new[1:] = np.diff(real) > 1
            at = np.flatnonzero(new)
            gamma, _ = forward_backward(self.scores[ids[real]], np.diff(np.append(at, len(real))), self.model.move)
            letters = np.fromiter(map(len, words), dtype=np.int64, count=len(words))[real]
            which = doc[real]
            first = np.flatnonzero(np.append(True, np.diff(which) > 0))
            shares[which[first]] = np.add.reduceat(gamma * letters[:, None], first, axis=0)
        total = shares.sum(axis=1)
        best = shares.argmax(axis=1)
        score = np.divide(shares[np.arange(n), best], total, out=np.zeros(n), where=total > 0)
        return [self.model.labels[b] if t else "und" for b, t in zip(best, total)], np.clip(score, 0, 1)


def learn(docs: DataFrame, most: int = MAX_TRAINING) -> Model | None:
    """A model from at most `most` documents with a known language that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    ids = bounded_sample(known, most)
    rows = one_each(known.where(F.col("doc_id").isin(ids)).select("doc_id", "text", "lang"), "doc_id", "text").orderBy("doc_id").collect() if ids else []
    return train([(r.text, r.lang) for r in rows])


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns named in `keep` (all by default); needs a column text."""
    keep = docs.columns if keep is None else keep
    rest = [c for c in keep if c not in ("lang_pred", "score")]
    schema = docs.select(rest).schema.add("lang_pred", "string").add("score", "double")
    names = schema.names
    read = docs.select(*dict.fromkeys([*rest, "text"]))
    if model is None:
        return read.select(*rest, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: SPACE x labels, and a lexicon of the sample

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        labeller = Labeller(sent.value)
        for batch in batches(it, most=1 << 19):
            lang, score = labeller.label(texts(batch))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score)], names=names)

    return read.mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
