"""Chunks of texts for retrieval: lines become units, and chunks are ranges of units found by bisection.

Units and their places are arrays, so a chunk is settled by two searches: for the first unit that reaches the target from
the chunk's start, and for the first unit of the stretch that the next chunk repeats. One document's chunks follow from
one another and stay in its row's task; documents are spread over tasks by Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Sizes in characters, and the marks that a long line may end at, with the white space after them.
TARGET, MOST, OVERLAP = 800, 1000, 120
MARKS = "。！？!?；;：:\n"
TOGETHER = 1 << 21  # characters of a batch that a task writes, each chunk counting ROW more
ROW = 100

_UP_TO_LAST_MARK = re.compile(rf"(?s:.*)[{MARKS}]\s*")


def line_cuts(text: str, start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """A line as stretches of at most `most` characters: each ends behind its last mark if that lies in its second half."""
    while end - start > most:
        found = _UP_TO_LAST_MARK.match(text, start, start + most)
        stop = found.end() if found and 2 * (found.end() - start) >= most - most % 2 else start + most
        yield start, stop
        start = stop
    yield start, end


def units(text: str, most: int = MOST) -> list[tuple[int, int]]:
    """Spans of the lines of a text, with their line ends, cut to size; a blank line, or a line's blank rest, is left out."""
    ends = [*(m.end() for m in re.finditer("\n", text)), len(text)]
    lines = ((a, b) for a, b in zip([0, *ends], ends) if text[a:b].rstrip("\n"))
    cut = ((a, b, line[1]) for line in lines for a, b in line_cuts(text, *line, most))
    return [(a, b) for a, b, end in cut if b < end or not text[a:b].isspace()]


def ranges(spans: list[tuple[int, int]], target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The ranges of units that chunks hold.

    A chunk ends with the unit that reaches the target, or before it if that unit would carry the chunk over `most`; such
    a unit then goes into the next chunk whatever its size. The next chunk repeats as many last units as fit in `overlap`
    characters. What is left at the end is a chunk too, even if it only repeats, unless it is the last chunk itself.
    """
    if not 0 <= overlap < target <= most:
        raise ValueError("the overlap must be below the target, and the target no more than the most")
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    out: list[tuple[int, int]] = []
    first, fresh, owed = 0, 0, False  # of the open chunk; the first unit no chunk has yet; it must go into this chunk
    while first < len(spans):
        k = max(bisect_left(ends, starts[first] + target), fresh)
        if k == len(spans):
            break
        over = k > first and ends[k] - starts[first] > most and not (owed and k == fresh)
        stop = k if over else k + 1
        out.append((first, stop))
        first, fresh, owed = min(max(bisect_left(starts, ends[stop - 1] - overlap), first), stop), stop, over
    if first < len(spans):
        out.append((first, len(spans)))
    return out


def chunk_spans(text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of a text's chunks, without white space at either end."""
    spans = units(text, most)
    out: list[tuple[int, int]] = []
    found = ranges(spans, target, most, overlap)
    for n, (i, j) in enumerate(found):
        a, b = spans[i][0], spans[j - 1][1]
        if n == len(found) - 1 and out and out[-1] == (a, b):
            break
        if not text[a:b].isspace():
            out.append((a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())))
    return out


def chunks(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, chunk_index, text, start_char, end_char) of every text of docs; null, empty and blank texts have no chunk.

    Repeated rows give repeated chunks. how: target, most and overlap.
    """
    names = [id, "chunk_index", "text", "start_char", "end_char"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One text at a time; what is found goes out whenever it holds TOGETHER characters or rows enough, within a text too."""

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=names)

        for batch in it:
            rows: list[tuple] = []
            size = 0
            for n in range(batch.num_rows):
                i, t = batch.column(0)[n].as_py(), batch.column(1)[n].as_py() or ""
                for k, (a, b) in enumerate(chunk_spans(t, **how)):
                    rows.append((i, k, t[a:b], a, b))
                    size += b - a + ROW
                    if size >= TOGETHER:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)

    return docs.select(id, text).mapInArrow(run, f"{id} long, chunk_index long, text string, start_char long, end_char long")
