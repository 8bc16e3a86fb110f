"""Words of texts without spaces: the cheapest path over the lattice of all words that a dictionary finds in a run of letters.

A dictionary gives each word the cost of its share among all words; a trie with failure links finds every occurrence of
every word in one pass, ordered by its end, so the cheapest path to each place is settled when the pass reaches it. Words
of a user's dictionary cost less than any way to split them. Characters that no word covers cost UNKNOWN more than the
rarest word, and those that follow one another are one word.

The dictionary is a table of counts, made from texts that have spaces or given. It reaches the tasks whole, so it holds
its MOST_WORDS most frequent words, ties by the word; that is the model's documented size, whatever the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 500_000
UNKNOWN = 10.0
TOGETHER = 1 << 16  # words of a batch that a task writes
RUN = re.compile(r"[^\W_]+")
WORD = r"[\p{L}\p{N}]+"


class Segmenter:
    """Costs of words; the trie is built where the object arrives."""

    def __init__(self, counts: dict[str, int], user: Iterable[str] = ()):
        total = max(1, sum(counts.values()))
        self.costs = {w: -math.log(n / total) for w, n in counts.items() if w and n > 0}
        self.unknown = max(self.costs.values(), default=0.0) + UNKNOWN
        for word in dict.fromkeys(w.lower() for w in user if w):
            path = self.path(word)  # under the words so far, itself perhaps among them
            split = sum(self.costs.get(word[a:b], self.unknown * (b - a)) for a, b in path)
            self.costs[word] = min(self.costs.get(word, math.inf), split) - 1e-6
            self.__dict__.pop("_trie", None)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_trie"}

    @property
    def trie(self) -> ahocorasick.Automaton:
        if "_trie" not in self.__dict__:
            self._trie = ahocorasick.Automaton()
            for w, cost in self.costs.items():
                self._trie.add_word(w, (len(w), cost))
            self._trie.make_automaton()
        return self._trie

    def path(self, run: str) -> list[tuple[int, int]]:
        """Spans of the cheapest words of a run; of equally cheap paths the one whose last word is longest."""
        n, unknown = len(run), self.unknown
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        settled = 0  # places up to here may also be reached by an unknown character
        for last, (size, cost) in self.trie.iter(run) if self.costs else ():
            while settled < last:
                settled += 1
                c = best[settled - 1] + unknown
                if c < best[settled]:
                    best[settled], back[settled] = c, -1
            end = last + 1
            c = best[end - size] + cost
            if c < best[end]:
                best[end], back[end] = c, size
        for place in range(settled + 1, n + 1):
            c = best[place - 1] + unknown
            if c < best[place]:
                best[place], back[place] = c, -1
        out: list[tuple[int, int]] = []
        end = n
        while end:
            size = back[end]
            start = end - abs(size)
            if size < 0:
                while start and back[start] < 0:
                    start -= 1
            out.append((start, end))
            end = start
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans of all words of a text; only runs of letters and digits are cut."""
        return [(m.start() + a, m.start() + b) for m in RUN.finditer(text) for a, b in self.path(m[0].lower())]


def dictionary(docs: DataFrame, text: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """(word, n): the most frequent words of texts that have spaces, lower-cased."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def segmenter(counts: DataFrame, user: Iterable[str] = (), most: int = MOST_WORDS) -> Segmenter:
    """From a table (word, n): the `most` most frequent words. Null words and counts below 1 are passed over, equal words add up."""
    own = counts.where("word IS NOT NULL AND n > 0").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    rows = own.orderBy(F.desc("n"), "word").limit(most).toArrow()
    return Segmenter(dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist())), user)


def segment(docs: DataFrame, model: Segmenter, id: str = "doc_id", text: str = "text", stop: Iterable[str] = (), least: int = 2) -> DataFrame:
    """(id, place, token, start, end): the words of each text in order, lower-cased; `place` counts what stays.

    Stop words and words of fewer than `least` characters go. Null and empty texts have no words; repeated rows give
    repeated words; ids may be null.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, frozenset(stop)))  # at most MOST_WORDS words
    kind = docs.schema[id].dataType.simpleString()

    names = [id, "place", "token", "start", "end"]
    types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, left_out = sent.value

        def rows(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 5, types)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=names)

        for batch in it:
            found: list[tuple] = []
            for k, t in enumerate(batch.column(1).to_pylist()):
                own = ((a, b, t[a:b].lower()) for a, b in known.spans(t or ""))
                found += [(k, place, w, a, b) for place, (a, b, w) in enumerate(x for x in own if len(x[2]) >= least and x[2] not in left_out)]
                if len(found) > TOGETHER:
                    yield rows(batch, found)
                    found = []
            yield rows(batch, found)

    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, place int, token string, start int, end int")


def recovery(docs: DataFrame, joined: DataFrame, model: Segmenter, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, words, found, hits): the words of docs, those that segmentation finds in joined, the same texts without spaces,
    and how many agree, each word as often as both have it. Texts without a word have zeros; rows of one id count together."""
    true = docs.select(id, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("token")).groupBy(id, "token").agg(F.count("*").alias("words"))
    own = segment(joined, model, id, text, least=1).groupBy(id, "token").agg(F.count("*").alias("found"))
    every = docs.select(id, F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("found"), F.lit(0).cast("long").alias("hits"))
    both = true.join(own, [id, "token"], "full").na.fill(0, ["words", "found"]).withColumn("hits", F.least("words", "found"))
    return every.unionByName(both).groupBy(id).agg(*[F.sum(c).alias(c) for c in ("words", "found", "hits")])
