import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from millrace.llm import op05_tokens as T
from millrace.llm.bpe import Encoder
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(library, docs):
    at, out = 0, {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out[d.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def test_query_against_the_library(spark, docs, library):
    rows = entry.queries()["op5_tokens"](spark, SMALL).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == expected(library, docs.collect())
    assert len(rows) == docs.count()


def test_block_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 4000):
        tokens = rng.zipf(1.3, n).clip(0, 70000).astype(np.uint32)
        counts = np.array([n // 2, n - n // 2])
        ids, c, back = T.unpack(T.pack([3, 9], counts, tokens))
        assert ids.tolist() == [3, 9] and c.tolist() == counts.tolist() and (back == tokens).all()
    wide = np.arange(70000, dtype=np.uint32)
    assert (T.unpack(T.pack([1], np.array([70000]), wide))[2] == wide).all()
    with pytest.raises(ValueError):
        T.unpack(b"nope")


def test_encoder_against_the_library(library):
    import random

    r = random.Random(2)
    letters = [" ", " ", "a", "B", "'", "s", "\n", "\t", "1", "é", "。", " ", "\x1f", "-", "<|endoftext|>"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Encoder.of().encode_batch(texts) == want
    assert Encoder.of().encode_batch(texts) == want  # from memory


def test_odd_rows(odd, empty, monkeypatch):
    rows = T.read_tokens(T.write_tokens(odd)).collect()
    assert len(rows) == odd.count()
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, 1, 2, 3, 4, 4, 5, 6, 8]
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    assert [r.n_tokens for r in ordered if r.doc_id in (1, 2)] == [1, 1]
    assert T.read_tokens(T.write_tokens(empty)).count() == 0


def test_memory_of_units_is_as_large_as_asked_for():
    """Units that come back after more others than MEMO are not encoded again where the memory is asked to hold them, and ids stay the same."""
    import random

    from millrace.llm import bpe

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(3000)]
    parts = [" ".join(words[k : k + 300]) for k in range(0, 3000, 300)] * 2
    learned, ids = {}, {}
    for most in (100, 4000):
        encoder = bpe.Encoder(bpe.default_path())
        encoder.most, learn, learned[most] = most, encoder._learn, 0

        def counted(units, learn=learn, most=most):
            learned[most] += len(units)
            learn(units)

        encoder._learn = counted
        ids[most] = [encoder.encode(p) for p in parts]
    assert learned[100] > 5500 and learned[4000] <= 3000
    assert ids[100] == ids[4000] == [encoder._whole([p])[0] for p in parts]
    assert bpe.Encoder.of(most=7).most == 7 and bpe.Encoder.of().most is None
