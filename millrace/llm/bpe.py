"""Byte-level BPE over whole texts with the tokenizers library, one call for each distinct piece of text.

A boundary before a single space between two visible characters is always a boundary of the tokenizer's pieces, so
texts fall into units (a space and what follows it) that encode alone as they do in context. Arrow splits the texts of
a batch at spaces and numbers their distinct units, so Python looks at each distinct unit of a batch once, and ids are
gathered by number. Each worker remembers units it has seen (2 * MEMO or the 2 * `most` it was asked for, and one batch's: when
one generation is full, the one before it goes). New units go to the library many to a string, and the ids are cut apart where a token begins with a
space: only a unit's first one does. Texts where a space stands between other white space, or that spell an added
token, go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.common import KEPT

MEMO = 200_000
TOGETHER = 256  # new units in one string
_APART = re.compile(r"\s (?:\s|\Z)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 letters are themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """encode(text) gives the ids as little-endian uint32 bytes; decode(ids) the text."""

    @classmethod
    def of(cls, path: str | None = None, most: int | None = None) -> Encoder:
        """One encoder for each file and worker; later tasks of the worker find its memory warm. `most` units (MEMO if
        not given) are a generation of its memory."""
        path = path or default_path()
        if (cls, path) not in KEPT:
            KEPT[cls, path] = cls(path)
        KEPT[cls, path].most = most
        return KEPT[cls, path]

    def __init__(self, path: str):
        self.most: int | None = None
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}  # units that no space stands before
        letters = byte_of_letter()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.sizes = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.spaced = np.array([p[:1] == b" " for p in self.pieces])
        self.decimals = [str(i).encode() for i in range(len(self.pieces))]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """Remembers the ids of units after a space."""
        joined, odd = [], []
        for u in units:
            (joined if u and u.strip() == u else odd).append(u)
        blocks = [joined[k : k + TOGETHER] for k in range(0, len(joined), TOGETHER)]
        for block, ids in zip(blocks, self._whole([" " + " ".join(b) for b in blocks])):
            edges = [*(4 * np.flatnonzero(self.spaced[np.frombuffer(ids, dtype="<u4")])).tolist(), len(ids)]
            if len(edges) == len(block) + 1 and edges[0] == 0:
                self.memo.update(zip(block, [ids[a:b] for a, b in zip(edges, edges[1:])]))
            else:
                odd += block
        if odd:
            self.memo.update(zip(odd, self._whole([" " + u for u in odd])))

    def _units(self, units: list[str]) -> list[bytes]:
        """The ids of units after a space."""
        if len(self.memo) > (self.most or MEMO):
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        out = [*map(memo.get, units)]
        new = [i for i, ids in enumerate(out) if ids is None]
        if older:
            memo.update((units[i], older[units[i]]) for i in new if units[i] in older)
        self._learn([units[i] for i in new if units[i] not in memo])
        for i in new:
            out[i] = memo[units[i]]
        return out

    def _heads(self, units: list[str]) -> list[bytes]:
        """The ids of units that begin a text."""
        if len(self.firsts) > MEMO // 4:
            self.firsts = {}
        new = [u for u in units if u not in self.firsts]
        self.firsts.update(zip(new, self._whole(new)))
        return [*map(self.firsts.__getitem__, units)]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if _APART.search(t) or any(a in t for a in self.added)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        apart = {*whole}
        rest = [i for i, t in enumerate(texts) if t and i not in apart]
        if not rest:
            return out
        split = pc.split_pattern(pa.array([texts[i] for i in rest], pa.large_string()), " ")
        offsets = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        units, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        heads, where = np.unique(at[offsets[:-1]], return_inverse=True)  # no space stands before a text's first unit
        found = self._units(units) + self._heads([units[h] for h in heads.tolist()])
        at[offsets[:-1]] = len(units) + where
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        start = (np.cumsum(size) - size)[at]
        size = size[at]
        ends = np.cumsum(size)
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.arange(ends[-1]) + np.repeat(start - ends + size, size)]
        edges = 4 * ends[offsets[1:] - 1]
        flat, low = ids.tobytes(), 0
        for i, high in zip(rest, edges.tolist()):
            out[i] = flat[low:high]
            low = high
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
