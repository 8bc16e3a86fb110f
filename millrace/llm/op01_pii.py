"""Personal data in whole texts: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers; their spans always stay. The
network reads characters by class and adds spans of the same four kinds that the patterns miss (grouped or
mistyped cards, local phone numbers, spelt-out addresses). It is trained here in numpy, from labelled spans: those
of the patterns in a bounded sample of texts, and made-up values in several forms set into lines of that sample,
with other numbers as counter-examples.

All four kinds need a digit or an at-sign (or its spelling in brackets), so windows without one cannot hold a span
and are not decoded. The others, of WIDTH characters every STEP, overlap; their label scores are averaged with the
most weight at a window's middle, and one Viterbi pass over each run of joined windows reconciles them globally.
Learning uses at most MAX_TRAINING texts; of them filler words come from FILLER_LINES lines and at most PATTERN_SPANS
spans of the patterns, both drawn by a seeded permutation. Of several texts with one id the one with the smallest hash is
learned from. Null texts count as empty and have no spans; an empty table gives no rows. Very long texts are decoded
whole, in groups of windows. Spans that start together are ordered by kind, then by end. Repeated rows give repeated
results; extra columns, whatever their names, are read and returned by redact() only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import batches, bounded_sample, one_each, settle, table, texts
from millrace.llm.op10_language import forward_backward

KINDS = ("email", "ip", "card", "phone")
MAX_TRAINING = 300  # texts of the sample
FILLER_LINES, PATTERN_SPANS = 400, 1000  # of these texts
WIDTH, STEP = 64, 32
HIDDEN, EMBED = 20, 12
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]", re.I)
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def patterns(text: str) -> list[Span]:
    """The base spans, ordered by start, then kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


# The network.
LABELS = 1 + 2 * len(KINDS)  # outside; beginning and inside of each kind
_SYMBOLS = " \n0abcdefghijklmnopqrstuvwxyz@.,:;-+_%()[]{}=\"'/#*$&|!?<>~^`\\"
_CODE = np.full(128, len(_SYMBOLS) + 1, dtype=np.int8)
for _i, _c in enumerate(_SYMBOLS):
    _CODE[ord(_c)] = _i
for _c in range(26):
    _CODE[65 + _c] = _CODE[97 + _c]
_CODE[48:58] = _CODE[48]
VOCABULARY = len(_SYMBOLS) + 3  # a letter or sign beyond ASCII, another control sign, past the end


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], len(_SYMBOLS)).astype(np.int8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.embed = rng.normal(0, 0.3, (VOCABULARY, EMBED))
        self.wx = rng.normal(0, 0.25, (2, EMBED, 4 * h))
        self.wh = rng.normal(0, 0.2, (2, h, 4 * h))
        self.b = np.zeros((2, 1, 4 * h))
        self.b[:, :, h : 2 * h] = 1
        self.out = rng.normal(0, 0.2, (2 * h, LABELS))
        self.bias = np.zeros(LABELS)
        self.move = np.zeros((LABELS, LABELS))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.wh, self.b, self.out, self.bias, self.move]

    def run(self, x: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Label scores (windows, width, labels) and hidden states of coded windows."""
        n, width = x.shape
        h = HIDDEN
        into = np.einsum("ve,dek->dvk", self.embed, self.wx) + self.b  # what each symbol adds to the gates
        state, cell = np.zeros((2, n, h)), np.zeros((2, n, h))
        hidden = np.empty((n, width, 2 * h))
        for t in range(width):
            z = state @ self.wh
            z[0] += into[0][x[:, t]]
            z[1] += into[1][x[:, width - 1 - t]]
            i, f, o, g = _sigmoid(z[..., :h]), _sigmoid(z[..., h : 2 * h]), _sigmoid(z[..., 2 * h : 3 * h]), np.tanh(z[..., 3 * h :])
            before, old = cell, state
            cell = f * cell + i * g
            shape = np.tanh(cell)
            state = o * shape
            hidden[:, t, :h], hidden[:, width - 1 - t, h:] = state[0], state[1]
            if keep is not None:
                keep.append((i, f, o, g, before, shape, old))
        return hidden @ self.out + self.bias, hidden

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Of the conditional log-likelihood of labels y (windows, width)."""
        n, width = x.shape
        h = HIDDEN
        keep: list = []
        scores, hidden = self.run(x, keep)
        gamma, pair = forward_backward(scores.reshape(-1, LABELS), np.full(n, width), self.move)
        error = -gamma
        error[np.arange(n * width), y.ravel()] += 1
        error = error.reshape(n, width, LABELS) / n
        moves = -pair
        np.add.at(moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d_out = hidden.reshape(-1, 2 * h).T @ error.reshape(-1, LABELS)
        d_hidden = error @ self.out.T
        d_wh, d_into = np.zeros_like(self.wh), np.zeros((2, VOCABULARY, 4 * h))
        d_state, d_cell = np.zeros((2, n, h)), np.zeros((2, n, h))
        symbols = np.arange(VOCABULARY)[:, None]
        for t in range(width - 1, -1, -1):
            i, f, o, g, before, shape, old = keep[t]
            d_state = d_state + np.stack([d_hidden[:, t, :h], d_hidden[:, width - 1 - t, h:]])
            d_cell = d_cell + d_state * o * (1 - shape**2)
            z = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_state * shape * o * (1 - o), d_cell * i * (1 - g**2)], axis=2)
            d_wh += old.transpose(0, 2, 1) @ z
            d_into[0] += (x[:, t] == symbols).astype(float) @ z[0]
            d_into[1] += (x[:, width - 1 - t] == symbols).astype(float) @ z[1]
            d_state = z @ self.wh.transpose(0, 2, 1)
            d_cell = d_cell * f
        d_embed = np.einsum("dvk,dek->ve", d_into, self.wx)
        d_wx = np.einsum("ve,dvk->dek", self.embed, d_into)
        return float((gamma[np.arange(n * width), y.ravel()]).mean()), [d_embed, d_wx, d_wh, d_into.sum(axis=1, keepdims=True), d_out, error.sum(axis=(0, 1)), moves / n]


def viterbi(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels of chains that stand one after another."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    labels = np.zeros(len(scores), dtype=np.int64)
    if not len(lengths):
        return labels
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    best, back = np.empty_like(scores), np.zeros(scores.shape, dtype=np.int8)
    for t in range(lengths[0]):
        at = starts[: alive[t]] + t
        if t == 0:
            best[at] = scores[at]
        else:
            each = best[at - 1][:, :, None] + move
            back[at] = each.argmax(axis=1)
            best[at] = each.max(axis=1) + scores[at]
    ends = starts + lengths - 1
    labels[ends] = best[ends].argmax(axis=1)
    for t in range(lengths[0] - 1, 0, -1):
        at = starts[: alive[t]] + t
        labels[at - 1] = back[at, labels[at]]
    return labels


# Labelled spans.
def _value(kind: int, rng: np.random.Generator, words: list[str]) -> str:
    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return words[rng.integers(len(words))]

    form = rng.integers(6)
    if kind == 0:
        user = (word() + [".", "_", "", "-"][rng.integers(4)] + (number(2) if rng.random() < 0.6 else word()))[:20]
        site, end = (word() + (number(1) if rng.random() < 0.5 else ""))[:14], ["com", "org", "net", "example.com", "io"][rng.integers(5)]
        at, dot = [("@", "."), ("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", ".")][form]
        return (f"{user}{at}{site}{dot}{end}").upper() if rng.random() < 0.15 else f"{user}{at}{site}{dot}{end}"
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        gap = ["", "", "", " ", "-", "."][form]
        return gap.join([number(4) for _ in range(4)]) if rng.random() < 0.8 else f"{number(4)}{gap}{number(6)}{gap}{number(5)}"
    a, b, c = number(3), number(3), number(4)
    return [f"+1 ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {number(2)} {c} {number(4)}", f"{a}.{b}.{c}"][form]


def _other(rng: np.random.Generator) -> str:
    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    form = rng.integers(8)
    hexes = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40))
    return [f'token = "{hexes}"', f'TOKEN = "{hexes.upper()}"', f"Version {number(1)}.{number(1)}.", f"20{number(2)}", number(int(rng.integers(1, 9))), f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}:{number(2)}", f"{number(3)},{number(3)}.{number(2)}"][form]


def labelled(sample: list[str], n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Coded windows and their labels."""
    rng = np.random.default_rng(seed)
    lines = [x for t in sample for x in t.split("\n") if len(x) > 20] or ["nothing to see in this plain line of words here"]
    words = [w for w in re.findall(r"[a-zA-Z]{2,8}", " ".join(lines[k] for k in np.random.default_rng(seed).permutation(len(lines))[:FILLER_LINES]))] or ["name"]
    signs = ["", "", "", "", "!!", "***", "&&&", "%%%", "$$$", "###", ",", "."]
    x, y = np.full((n, WIDTH), VOCABULARY - 1, dtype=np.int8), np.zeros((n, WIDTH), dtype=np.int64)
    for row in range(n):
        line = lines[rng.integers(len(lines))]
        cut = int(rng.integers(max(1, len(line) - WIDTH)))
        before, after = line[cut : cut + WIDTH], lines[rng.integers(len(lines))][:WIDTH]
        kind = int(rng.integers(len(KINDS) + 2))
        value = _value(kind, rng, words) if kind < len(KINDS) else _other(rng)
        gap = " | " if rng.random() < 0.05 else "\n" if rng.random() < 0.1 else " "
        before = before[: int(rng.integers(WIDTH + 1))] + gap
        text = before + value + signs[rng.integers(len(signs))] + gap + after
        start = len(before)
        shift = int(rng.integers(0, max(1, start)))
        piece = codes(text[shift : shift + WIDTH])
        x[row, : len(piece)] = piece
        if kind < len(KINDS):
            a, b = max(0, start - shift), min(WIDTH, start - shift + len(value))
            if b > a:
                y[row, a:b] = 2 + 2 * kind
                if start >= shift:
                    y[row, a] = 1 + 2 * kind
    return x, y


def train(sample: list[str], windows: int = 3000, epochs: int = 8, seed: int = 5) -> Network:
    """Adam over labelled windows; the patterns' own spans in the sample join the made-up ones."""
    x, y = labelled(sample, windows)
    extra = []
    for text in sample:
        for kind, start, end in patterns(text):
            low = max(0, start - 20)
            piece = codes(text[low : low + WIDTH])
            labels = np.zeros(WIDTH, dtype=np.int64)
            for k, a, b in patterns(text):
                a, b = max(0, a - low), min(WIDTH, b - low)
                if b > a:
                    labels[a:b] = 2 + 2 * k
                    labels[a] = 1 + 2 * k
            extra.append((np.pad(piece, (0, WIDTH - len(piece)), constant_values=VOCABULARY - 1), labels))
    if extra:
        drawn = [extra[k] for k in np.random.default_rng(seed).permutation(len(extra))[:PATTERN_SPANS]]
        x, y = np.concatenate([x, np.array([e[0] for e in drawn])]), np.concatenate([y, np.array([e[1] for e in drawn])])
    net, rng = Network(seed), np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 100)):
            step += 1
            _, grads = net.gradients(x[part], y[part])
            for p, g, m, v in zip(net.parameters(), grads, first, second):
                g = np.clip(g, -5, 5)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += 0.02 * 0.75**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Finder:
    """spans(texts): for each text its base spans, and all spans with those that the network adds."""

    def __init__(self, net: Network):
        self.net = net
        half = np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1]) + 1.0
        self.weight = half / half.max()

    def _decode(self, found: list[str]) -> list[list[Span]]:
        runs, windows = [], []  # (text, start, windows) of joined windows
        for k, text in enumerate(found):
            hits = np.fromiter((m.start() for m in _TRIGGER.finditer(text)), dtype=np.int64)
            near = np.unique(np.concatenate([hits // STEP + d for d in (-2, -1, 0, 1)]))
            near = near[(near >= 0) & (near * STEP < len(text))]
            coded = codes(text)
            for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
                runs.append((k, int(run[0]) * STEP, len(run)))
                for w in run.tolist():
                    piece = coded[w * STEP : w * STEP + WIDTH]
                    windows.append(np.pad(piece, (0, WIDTH - len(piece)), constant_values=VOCABULARY - 1))
        out: list[list[Span]] = [[] for _ in found]
        at = 0
        while at < len(runs):
            end, count = at, 0
            while end < len(runs) and (count == 0 or count + runs[end][2] <= 2048):
                count += runs[end][2]
                end += 1
            own = runs[at:end]
            done = sum(r[2] for r in runs[:at]) if at else 0
            scores = np.concatenate([self.net.run(np.array(windows[i : min(i + 2048, done + count)], dtype=np.int64))[0] for i in range(done, done + count, 2048)])
            lengths = np.array([(r[2] - 1) * STEP + WIDTH for r in own])
            total, weight = np.zeros((lengths.sum(), LABELS)), np.zeros(lengths.sum())
            base, w = np.cumsum(lengths) - lengths, 0
            for b, (_, _, n) in zip(base.tolist(), own):
                for i in range(n):
                    here = slice(b + i * STEP, b + i * STEP + WIDTH)
                    total[here] += scores[w] * self.weight[:, None]
                    weight[here] += self.weight
                    w += 1
            labels = viterbi(total / weight[:, None], lengths, self.net.move)
            for b, n, (k, start, _) in zip(base.tolist(), lengths.tolist(), own):
                out[k] += [(kind, start + s, min(start + e, len(found[k]))) for kind, s, e in _spans(labels[b : b + n])]
            at = end
        return out

    def spans(self, docs: list[str]) -> list[tuple[list[Span], list[Span]]]:
        base = [patterns(t) for t in docs]
        waiting = [i for i, t in enumerate(docs) if _TRIGGER.search(t)]
        added: dict[int, list[Span]] = {}
        if waiting:
            for i, own in zip(waiting, self._decode([docs[i] for i in waiting])):
                added[i] = [s for s in (_trimmed(docs[i], x) for x in own) if s and plausible(docs[i], s) and not any(s[1] < b[2] and b[1] < s[2] for b in base[i])]
        return [(b, sorted({*b, *added.get(i, [])}, key=lambda s: (s[1], s[0], s[2]))) for i, b in enumerate(base)]


def _spans(labels: np.ndarray) -> list[Span]:
    out, i = [], 0
    for i in np.flatnonzero((labels % 2 == 1)).tolist():
        end = i + 1
        while end < len(labels) and labels[end] == labels[i] + 1:
            end += 1
        out.append((int(labels[i] - 1) // 2, i, end))
    return out


def _trimmed(text: str, span: Span) -> Span | None:
    kind, a, b = span
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return (kind, a, b) if b > a else None


def plausible(text: str, span: Span) -> bool:
    """What a span of a kind must hold whatever the network says; it may not cut a word or number in two."""
    kind, a, b = span
    value = text[a:b]
    digits = sum(c in "0123456789" for c in value)
    if (a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(@|[\[({] ?at ?[\])}]) ?[\w-]+(( ?[\[({] ?dot ?[\])}] ?|\.)[\w-]+)+", value, re.I))
    if re.search(r"[^0-9 ().+-]", value):
        return False
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}([. ] ?[0-9]{1,3}){3}", value))
    return 13 <= digits <= 19 if kind == 2 else 7 <= digits <= 15 and bool(re.search(r"[ ().+-]", value))


def learn(docs: DataFrame, most: int = MAX_TRAINING) -> Network:
    """A network from at most `most` texts of docs (doc_id, text)."""
    ids = bounded_sample(docs.where(F.col("text").isNotNull()), most, seed=1)
    rows = one_each(docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).select("doc_id", "text"), "doc_id", "text").orderBy("doc_id").collect() if ids else []
    return train([r.text for r in rows if r.text])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        finder = Finder(sent.value)
        for batch in batches(it):
            found = finder.spans(texts(batch))
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([listed(s) for _, s in found], pa.string())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, net: Network) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; other columns, and null texts, stay."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        finder = Finder(sent.value)
        for batch in batches(it):
            out = []
            for text, (_, spans) in zip(batch.column(at).to_pylist(), finder.spans(texts(batch))):
                if spans:
                    parts, done = [], 0
                    for kind, a, b in spans:
                        if a >= done:
                            parts += [text[done:a], f"[{KINDS[kind].upper()}]"]
                        done = max(done, b)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, learn(docs))
