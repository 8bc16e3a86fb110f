"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

Candidates must pass prefix filters under several global token orders. Under any one order of all shingles, two
sets with similarity t share a shingle among the first n - ceil(t n) + 1 of each. The order that generates candidates
puts frequent shingles last and the rest by hash. A pair's sketches (parities of the hashes that fall on each of n to 2 n
bits) then bound its overlap: sets differ in no fewer shingles than their sketches do in bits, so sketches, a quarter of a
byte or less for each shingle, travel in place of sets. Pairs that pass must also share a shingle among the
prefixes under further orders (other hashes) before they are compared in full.

Equal sets are one class from the start. Groups that share a prefix shingle are handled by size: small ones list
their pairs within the length filter; large ones (families of near copies) first link each member to their few
most connected members within the length filter, and after those links are verified and merged, list only pairs of members that are still in
different components; the largest are compared in blocks by matrix products that return links only. So no group is
expanded into all its pairs, and no link that changes a component is lost; full sets travel only for members that the
sketches leave.

Joins that carry sketches and sets are merge joins at every size: both sides grow with the corpus, so a broadcast that a
small table would get says nothing of a large one. Nothing that grows with the corpus reaches the driver: the list of frequent shingles and the Bloom filter of
candidates have fixed sizes; beyond them the join is slower, with the same result. A shingle's members are held by one
task when its group is first read, 20 bytes a member; from then on hot shingles are dealt into parts and blocks.

Sets are known by 64-bit hashes, among n different sets n * n / 2**65 of which are expected to be wrongly equal (three
among 10**10), and compared by 48 bits of each shingle's hash, which can shift a count only where a pair stands at the
threshold by one shingle.

Null and empty texts have no shingles and link with nothing; an empty table gives no rows. Texts of any length are
shingled whole, one at a time where they are long. A similarity of the threshold itself links; of a group's documents the
smallest id names it. Repeated rows give repeated rows. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import batches, settle, stash, table
from millrace.llm.components import components, forest
from millrace.llm.shingles import column_bytes, mix, shingle_sets

THRESHOLD = (75, 100)  # similarity as a fraction
FREQUENT = 16  # a shingle of this many classes goes last in the order ...
MOST_FREQUENT = 1 << 18  # ... for so many shingles at most
LOCAL = 3  # counts below this within one task (or MOST_COUNTED shingles of it) are not reported
MOST_COUNTED = 1 << 21
TOGETHER = 1 << 20  # bytes of texts that are hashed at once: their arrays take some 40 bytes each
SMALL_GROUP = 4
HUBS = 2
HUB_GROUP = 1 << 16  # members that share their hubs
SALTS = 16  # ways to deal a shingle's members where they are joined by it
LARGE_GROUP = 64  # groups beyond this are compared in blocks of
BLOCK = 512  # members, as matrix products
BLOOM_BITS = 1 << 25
ORDERS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
BYTES = 6  # of each hash, kept for the comparison in full


def need(n, threshold=THRESHOLD):
    """ceil(t n), for integers or integer arrays."""
    return (threshold[0] * n + threshold[1] - 1) // threshold[1]


def signature(s: np.ndarray) -> int:
    """One signed 64-bit number for a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s + np.uint64(len(s))).sum(dtype=np.uint64)], dtype=np.uint64)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return shingle_sets(*column_bytes(batch.column(batch.schema.get_field_index("text"))), width)


def _text_hashes(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index("text")))
    raw = memoryview(data)
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], dtype=np.uint64).view(np.int64)


def _record(schema: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema)


def sketch(s: np.ndarray) -> bytes:
    """For each bit p of a power of two of bits, at least as many as the set has hashes, whether an odd number of them is p modulo that power."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch's bytes as the sketch of `size` bytes of the same set."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(x: bytes, y: bytes, nx: int, ny: int, threshold=THRESHOLD) -> bool:
    """Whether two sets' sketches allow the threshold: each bit in which they differ stands for a shingle that only one set has."""
    if min(nx, ny) < need(max(nx, ny), threshold):
        return False
    size = min(len(x), len(y))
    p, q = (fold(np.frombuffer(v, np.uint8), size) if len(v) > size else v for v in (x, y))
    differ = (int.from_bytes(p, "little") ^ int.from_bytes(q, "little")).bit_count()
    return (threshold[1] - threshold[0]) * (nx + ny) >= (threshold[1] + threshold[0]) * differ


def _scan(width: int):
    """Rows (kind 0: doc_id, n, sig, sketch) for texts and (kind 1: shingle, count) for those frequent in a task."""
    names = ["kind", "doc_id", "n", "sig", "sketch", "hash"]

    def frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(sets)
        sets.clear()
        every.sort()
        token = np.unique(every[LOCAL - 1 :][every[LOCAL - 1 :] == every[: len(every) - LOCAL + 1]])
        count = np.searchsorted(every, token, side="right") - np.searchsorted(every, token)
        return _record(names, np.ones(len(token), np.int32), token.view(np.int64), count.astype(np.int64), pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.binary()), pa.nulls(len(token), pa.int64()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        seen, held, size = set(), [], 0
        for batch in batches(it, most=TOGETHER):
            sets = _sets(batch, width)
            sigs = [signature(s) if len(s) else None for s in sets]
            sketches = []
            for s, g in zip(sets, sigs):
                if g is not None and g not in seen:
                    seen.add(g)
                    held.append(s)
                    size += len(s)
                    sketches.append(sketch(s))
                else:
                    sketches.append(None)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            yield _record(names, np.zeros(len(n), np.int32), batch.column(0), n, pa.array(sigs, pa.int64()), pa.array(sketches, pa.binary()), _text_hashes(batch))
            if size >= MOST_COUNTED:
                yield frequent(held)
                held, size = [], 0
        if held:
            yield frequent(held)

    return run


def _order(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set in the generating order: frequent shingles last, otherwise by hash."""
    if not len(frequent):
        return s
    last = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    return np.concatenate([s[~last], s[last]]) if last.any() else s


def _prefixes(width: int, threshold, frequent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        seen, hot = set(), frequent.value
        for batch in batches(it, most=TOGETHER):
            tokens, sigs, sizes = [], [], []
            for s in _sets(batch, width):
                if not len(s) or (g := signature(s)) in seen:
                    continue
                seen.add(g)
                p = len(s) - need(len(s), threshold) + 1
                tokens.append(_order(s, hot)[:p])
                sigs.append(np.full(p, g, dtype=np.int64))
                sizes.append(np.full(p, len(s), dtype=np.int32))
            if tokens:
                yield _record(["token", "sig", "n"], np.concatenate(tokens).view(np.int64), np.concatenate(sigs), np.concatenate(sizes))

    return run


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of rows sorted by token that never split a token's rows between two blocks."""
    rest: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        edge = int(np.searchsorted(token, token[-1]))
        if edge == 0 and rest and rest[-1].column(0)[-1].as_py() == token[-1]:
            rest.append(batch)
            continue
        if edge:
            rest.append(batch.slice(0, edge))
        if rest:
            yield _merged(rest)
        rest = [batch.slice(edge)]
    if rest:
        yield _merged(rest)


def _merged(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(parts)
    return {c: t.column(c).to_numpy() if not pa.types.is_nested(t.schema.field(c).type) else np.array([*t.column(c).to_pylist(), None], dtype=object)[:-1] for c in t.column_names}


def _pairs(threshold):
    """From rows (token, sig, n) sorted by token: pairs (sig, other) of small groups, and hot rows (token, sig, n, group size) of large ones."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "sig", "n", "other"]
        for rows in _groups(it):
            token, sig, n = rows["token"], rows["sig"], rows["n"]
            same = np.zeros(len(token), dtype=bool)
            same[1:] = token[1:] == token[:-1]
            keep = same.copy()
            keep[:-1] |= same[1:]
            if not keep.any():
                continue
            token, sig, n = token[keep], sig[keep], n[keep]
            order = np.lexsort((sig, token))
            token, sig, n = token[order], sig[order], n[order]
            new = np.append(True, (token[1:] != token[:-1]) | (sig[1:] != sig[:-1]))  # one class may come from two tasks
            token, sig, n = token[new], sig[new], n[new]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(first, len(token)))
            group = np.repeat(np.arange(len(first)), size)
            at = np.arange(len(token)) - first[group]
            out = []
            for gap in range(1, SMALL_GROUP):
                a = np.flatnonzero((size[group] <= SMALL_GROUP) & (at + gap < size[group]))
                b = a + gap
                fit = np.minimum(n[a], n[b]) >= need(np.maximum(n[a], n[b]), threshold)
                out.append((sig[a[fit]], sig[b[fit]]))
            x, y = (np.concatenate(v) for v in zip(*out))
            yield _record(names, pa.nulls(len(x), pa.int64()), x, pa.nulls(len(x), pa.int32()), y)
            hot = size[group] > SMALL_GROUP
            if hot.any():
                token, sig, n = token[hot], sig[hot], n[hot]
                yield _record(names, token, sig, n, size[group][hot])

    return run


def _hub_pairs(threshold):
    """From rows (token, sig, n, weight) sorted by token: each member with the heaviest members of its group within the length filter."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(it):
            order = np.lexsort((rows["sig"], -rows["weight"], rows["token"]))
            token, sig, n = rows["token"][order], rows["sig"][order], rows["n"][order].astype(np.int64)
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(first, len(token)))
            start, last = np.repeat(first, size), np.repeat(first + size, size)
            left = np.full(len(token), HUBS)
            out = []
            for k in range(4 * HUBS):
                hub = start + k
                ok = np.flatnonzero((hub < last) & (left > 0))
                hub = hub[ok]
                ok = ok[(sig[hub] != sig[ok]) & (np.minimum(n[hub], n[ok]) >= need(np.maximum(n[hub], n[ok]), threshold))]
                hub = start[ok] + k
                left[ok] -= 1
                out.append((sig[ok], sig[hub]))
            x, y = (np.concatenate(v) for v in zip(*out))
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            yield _record(["a", "b"], both[:, 0].copy(), both[:, 1].copy())

    return run


def _late_pairs(threshold):
    """From rows (token, sig, n, component, before) sorted by token: pairs of different components, at their first common token only."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(it):
            first = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
            for a, b in zip(first, np.append(first[1:], len(rows["token"]))):
                sig, n, comp = rows["sig"][a:b], rows["n"][a:b], rows["component"][a:b]
                order = np.lexsort((sig, n))
                sig, n, comp = sig[order], n[order], comp[order]
                held = rows["before"][a:b]
                before = [set(held[i]) for i in order]
                for i in range(len(sig)):
                    end = int(np.searchsorted(n, n[i] * threshold[1] // threshold[0], side="right"))
                    j = i + 1 + np.flatnonzero((comp[i + 1 : end] != comp[i]) & (sig[i + 1 : end] != sig[i]))
                    j = [k for k in j.tolist() if before[i].isdisjoint(before[k])]
                    if j:
                        yield _record(["a", "b"], np.full(len(j), sig[i]), sig[j])

    return run


def bloom_slots(x: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(x.view(np.uint64) + np.uint64(k)) % np.uint64(bits) for k in (11, 12, 13)]


def bloom(keys: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of `bits` bits over a long column; only its set words come to the driver (at most bits / 8 bytes)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(bits // 64, dtype=np.uint64)
        for batch in it:
            for slot in bloom_slots(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(flat, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(flat)
        yield _record(["at", "word"], at.astype(np.int32), flat[at].view(np.int64))

    found = keys.select(column).mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    flat = np.zeros(bits // 64, dtype=np.int64)
    flat[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return flat.view(np.uint64)


def in_bloom(x: np.ndarray, flat: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for slot in bloom_slots(x, len(flat) * 64):
        ok &= (flat[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def _wanted_sets(width: int, wanted):
    """(sig, hashes) of classes whose text's hash the filter may hold; six bytes of each shingle's hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        seen: set[int] = set()
        for batch in batches(it, most=TOGETHER):
            hit = in_bloom(_text_hashes(batch), wanted.value)
            sets = [s for s in _sets(batch.filter(pa.array(hit)), width) if len(s)] if hit.any() else []
            out = []
            for s in sets:
                if (g := signature(s)) not in seen:
                    seen.add(g)
                    out.append((g, s.view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()))
            if out:
                yield _record(["sig", "hashes"], pa.array([g for g, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary()))

    return run


def _unpack(b: bytes) -> np.ndarray:
    flat = np.frombuffer(b, dtype=np.uint8).reshape(-1, BYTES)
    out = np.zeros((len(flat), 8), dtype=np.uint8)
    out[:, 8 - BYTES :] = flat
    return out.view(np.uint64).ravel()


def linked(x: np.ndarray, y: np.ndarray, threshold=THRESHOLD, orders=ORDERS[1:]) -> bool:
    """Whether two sorted sets reach the threshold: prefix filters under further orders first, then the full count."""
    if min(len(x), len(y)) < need(max(len(x), len(y)), threshold):
        return False
    for seed in orders:
        p, q = mix(x ^ np.uint64(seed)), mix(y ^ np.uint64(seed))
        a, b = len(x) - need(len(x), threshold), len(y) - need(len(y), threshold)
        p, q = (p if a + 1 >= len(p) else np.partition(p, a)[: a + 1]), (q if b + 1 >= len(q) else np.partition(q, b)[: b + 1])
        if not len(np.intersect1d(p, q)):
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return threshold[1] * both >= threshold[0] * (len(x) + len(y) - both)


def _verify(threshold):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last, keep = (None, None), np.zeros(len(a), dtype=bool)
            for i in range(len(a)):
                x = batch.column(2)[i].as_buffer()
                if last[0] != a[i]:
                    last = (a[i], _unpack(x))
                keep[i] = linked(last[1], _unpack(batch.column(3)[i].as_buffer()), threshold)
            yield _record(["a", "b"], a[keep], b[keep])

    return run


def _filter(threshold):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = batch.column(0), batch.column(1)
            n, m = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep = pa.array([may_link(*v, threshold) for v in zip(x, y, n, m)], pa.bool_())
            yield _record(["a", "b"], a.filter(keep), b.filter(keep))

    return run


def _near(pairs: DataFrame, classes: DataFrame, threshold, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose sketches allow the threshold."""
    left = classes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = classes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    near = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "na", "nb", "x", "y")
    return stash(near.mapInArrow(_filter(threshold), "a long, b long"), name)


def _fetch(docs: DataFrame, keys: DataFrame, classes: DataFrame, width: int, name: str) -> DataFrame | None:
    """(sig, hashes) of the classes in keys (sig) and perhaps a few more; None for no keys."""
    flat = bloom(classes.select("sig", "hash").join(keys, "sig", "left_semi"), "hash")
    if not flat.any():
        return None
    wanted = docs.sparkSession.sparkContext.broadcast(flat)
    return stash(docs.mapInArrow(_wanted_sets(width, wanted), "sig long, hashes binary"), name).dropDuplicates(["sig"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig")))


def _compare(near: DataFrame, sets: DataFrame | None, threshold) -> DataFrame:
    """The pairs (a, b) that reach the threshold, compared in full."""
    if sets is None:
        return near.limit(0)
    right, left = sets.select(F.col("sig").alias("b"), F.col("hashes").alias("y")), sets.select(F.col("sig").alias("a"), F.col("hashes").alias("x"))
    both = near.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(_verify(threshold), "a long, b long")


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share."""
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner, inverse = owner[count[inverse] > 1], inverse[count[inverse] > 1]
    columns, inverse = np.unique(inverse, return_inverse=True)
    total = np.zeros((len(rows), len(rows)), dtype=np.float32)
    for low in range(0, len(columns), 4096):
        here = (inverse >= low) & (inverse < low + 4096)
        m = np.zeros((len(rows), min(4096, len(columns) - low)), dtype=np.float32)
        m[owner[here], inverse[here] - low] = 1
        total += m @ m.T
    return total


def _wanted(rows: dict[str, np.ndarray], threshold) -> np.ndarray:
    """Which pairs of one block pair's rows are to be compared: other components, like sizes, no earlier common token."""
    n, comp = rows["n"].astype(np.int64), rows["component"]
    want = np.triu(comp[:, None] != comp[None, :], 1)
    want &= np.minimum(n[:, None], n[None, :]) >= need(np.maximum(n[:, None], n[None, :]), threshold)
    if rows["low"][0] != rows["high"][0]:
        want &= rows["block"][:, None] != rows["block"][None, :]
    if want.any():
        want &= _counts([np.asarray(x, dtype=np.int64) for x in rows["before"]]) == 0
    return want


def _by_key(it: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for rows in _groups(it):
        first = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
        for a, b in zip(first, np.append(first[1:], len(rows["key"]))):
            yield {c: x[a:b] for c, x in rows.items()}


_DEALT = "key long, block int, low int, high int, sig long, n int, component long, before array<long>"


def _chosen(rows: dict[str, np.ndarray], want: np.ndarray, names: list[str]) -> pa.RecordBatch | None:
    """The rows of a block pair that take part in a wanted comparison."""
    use = np.flatnonzero(want.any(axis=0) | want.any(axis=1))
    if not len(use):
        return None
    kinds = {"before": pa.list_(pa.int64()), "sketch": pa.binary()}
    return _record(names, *(pa.array([rows[c][i] for i in use], kinds[c]) if c in kinds else rows[c][use] for c in names))


def _needed(threshold):
    """The rows of block pairs (sorted by key) that take part in a comparison: most groups repeat an earlier one and drop out."""
    names = [x.split()[0] for x in _DEALT.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(it):
            if (out := _chosen(rows, _wanted(rows, threshold), names)) is not None:
                yield out

    return run


def _differ(sketches: list[bytes]) -> np.ndarray:
    """In how many bits each two sketches differ, at the smaller one's size."""
    sizes = np.array([len(x) for x in sketches])
    total = np.zeros((len(sketches), len(sketches)), dtype=np.float32)
    for size in np.unique(sizes):
        use = np.flatnonzero(sizes >= size)
        flat = np.stack([fold(np.frombuffer(sketches[i], np.uint8), size) for i in use])
        same = np.zeros((len(use), len(use)), dtype=np.float32)
        for low in range(0, size, 512):
            m = 2 * np.unpackbits(flat[:, low : low + 512], axis=1).astype(np.float32) - 1
            same += m @ m.T
        here = np.minimum(sizes[use, None], sizes[None, use]) == size
        at = np.ix_(use, use)
        total[at] = np.where(here, (8 * size - same) / 2, total[at])
    return total


def _may_link_matrix(rows: dict[str, np.ndarray], want: np.ndarray, threshold) -> np.ndarray:
    """may_link() for the wanted pairs of a block pair."""
    if not want.any():
        return want
    n = rows["n"].astype(np.int64)
    most = (threshold[1] - threshold[0]) * (n[:, None] + n[None, :])
    return want & (most >= (threshold[1] + threshold[0]) * _differ(list(rows["sketch"])).astype(np.int64))


def _filtered(threshold):
    """The needed rows that still take part where sketches allow the threshold."""
    names = [x.split()[0] for x in (_DEALT + ", sketch binary").split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(it):
            if (out := _chosen(rows, _may_link_matrix(rows, _wanted(rows, threshold), threshold), names)) is not None:
                yield out

    return run


def _blocks(threshold):
    """From the needed rows with hashes, sorted by key: links, thinned to a spanning forest of each block pair."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(it):
            i, j = np.nonzero(_may_link_matrix(rows, _wanted(rows, threshold), threshold))
            if not len(i):
                continue
            n, sig = rows["n"].astype(np.int64), rows["sig"]
            shared = _counts([_unpack(x) for x in rows["hashes"]])
            both = shared[i, j].astype(np.int64)
            ok = threshold[1] * both >= threshold[0] * (n[i] + n[j] - both)
            if ok.any():
                yield _record(["a", "b"], *forest(sig[i[ok]], sig[j[ok]]))

    return run


def _merge_labels(first: DataFrame, again: DataFrame) -> DataFrame:
    """Labels of nodes after components of components were joined; a component's own smallest node is in neither table of labels before."""
    both = first.join(again.select(F.col("node").alias("component"), F.col("component").alias("lower")), "component", "left")
    moved = both.select("node", F.coalesce("lower", "component").alias("component"))
    alone = again.join(first.select("node"), "node", "left_anti")
    return moved.unionByName(alone.select("node", "component")).distinct()


def jaccard_components(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    scan = stash(docs.mapInArrow(_scan(width), "kind int, doc_id long, n long, sig long, sketch binary, hash long"), "shingle-scan")
    counted = scan.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = counted.orderBy(F.desc("n"), "doc_id").limit(MOST_FREQUENT).select("doc_id").toArrow().column(0).to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(top.view(np.uint64)))
    classes = scan.where("kind = 0 and sketch is not null").groupBy("sig").agg(F.first("n").alias("n"), F.min("sketch").alias("sketch"), F.min("hash").alias("hash"))
    prefixes = docs.mapInArrow(_prefixes(width, threshold, frequent), "token long, sig long, n int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = prefixes.repartition(parts, "token").sortWithinPartitions("token")
    found = stash(dealt.mapInArrow(_pairs(threshold), "token long, sig long, n int, other long"), "prefix-groups")
    hot = found.where("token is not null")
    # The original of a family shares more of its shingles, with more members, than its copies do.
    weight = hot.groupBy("sig").agg((F.sum("other") / F.max("n")).alias("weight"))
    part = F.pmod(F.xxhash64("sig"), F.ceil(F.col("other") / F.lit(float(HUB_GROUP))))  # a hot shingle's members look for hubs in parts
    members = hot.join(weight.hint("merge"), "sig").select(F.xxhash64("token", part).alias("token"), "sig", "n", "weight").repartition(parts, "token").sortWithinPartitions("token")
    hubs = members.mapInArrow(_hub_pairs(threshold), "a long, b long")
    pairs = found.where("token is null").select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b")).unionByName(hubs)
    pairs = stash(pairs.distinct(), "pairs")
    near = _near(pairs, classes, threshold, "near")
    links = stash(_compare(near, _fetch(docs, _ends(near), classes, width, "sets"), threshold), "links")
    labels = stash(components(links), "labels")

    at = hot.select("token", "sig", "n").join(labels.select(F.col("node").alias("sig"), "component").hint("merge"), "sig", "left").select("token", "sig", "n", F.coalesce("component", "sig").alias("component"))
    mixed = at.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high").select("token", "size")
    salted = at.withColumn("salt", F.pmod(F.xxhash64("sig", F.lit(3)), F.lit(SALTS)))
    spread = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    lists = salted.join(spread.hint("merge"), ["token", "salt"]).groupBy("sig", "n", "component").agg(F.array_sort(F.collect_list(F.struct("token", "size"))).alias("tokens"))
    each = lists.select("sig", "n", "component", "tokens", F.posexplode("tokens").alias("place", "own"))
    each = stash(each.select("own.token", "own.size", "sig", "n", "component", F.expr("slice(tokens.token, greatest(1, place - 15), least(16, place))").alias("before")), "open-groups")
    small = each.where(F.col("size") <= LARGE_GROUP).drop("size").repartition(parts, "token").sortWithinPartitions("token")
    late = small.mapInArrow(_late_pairs(threshold), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    late = _near(late.join(pairs, ["a", "b"], "left_anti"), classes, threshold, "late-near")
    large = each.where(F.col("size") > LARGE_GROUP)
    blocks = F.ceil(F.col("size") / F.lit(float(BLOCK))).cast("int")
    large = large.withColumn("block", F.pmod(F.xxhash64("sig"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = large.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.select(F.xxhash64("token", "low", "high").alias("key"), "block", "low", "high", "sig", "n", "component", "before")
    dealt = stash(dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_needed(threshold), _DEALT), "blocks")
    dealt = dealt.join(classes.select("sig", "sketch").hint("merge"), "sig").select(*dealt.columns, "sketch").repartition(parts, "key").sortWithinPartitions("key")
    dealt = stash(dealt.mapInArrow(_filtered(threshold), f"{_DEALT}, sketch binary"), "near-blocks")
    sets = _fetch(docs, _ends(late).unionByName(dealt.select("sig")).distinct(), classes, width, "late-sets")
    late_links = _compare(late, sets, threshold)
    if sets is not None:
        full = dealt.join(sets.hint("merge"), "sig").select("key", "block", "low", "high", "sig", "n", "component", "before", "sketch", "hashes")
        late_links = late_links.unionByName(full.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_blocks(threshold), "a long, b long"))
    late_links = stash(late_links, "late-links")
    lifted = late_links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    again = components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    labels = _merge_labels(labels, again)

    rows = scan.where("kind = 0")
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("low"))
    lows = classes.join(labels.select(F.col("node").alias("sig"), "component").hint("merge"), "sig", "left").select("sig", "low", F.coalesce("component", "sig").alias("component"))
    least = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    named = lows.join(least.hint("merge"), "component").select("sig", "component_id")
    out = rows.join(named.hint("merge"), "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
