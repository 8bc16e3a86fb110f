import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from millrace.llm import op09_bpe as B
from millrace.llm.bpe import Encoder
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def same(library, found, rows):
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    have = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found), key=key)
    assert have == sorted(((i, *expected(library, t)) for i, t in rows), key=key)


def test_query_against_the_library(spark, docs, library):
    same(library, entry.queries()["op9_bpe"](spark, SMALL).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_shared_chunks_are_repaired_at_their_joins(spark, library):
    rng = np.random.default_rng(1)
    vocabulary = ["the", "river", "and", "élan", "it's", "  ", "\n\n", "1234", "naïve", "$$", "日本", "of", "<|endoftext|>"]
    passages = [" ".join(rng.choice(vocabulary, 1500)) for _ in range(4)]
    texts = [f"own {i} " + "".join(rng.choice(passages, 2)) + str(i) for i in range(30)] + passages + passages + ["x" * 5000, "x" * 5000 + "y", " " * 6000, " " * 6000 + "a"]
    rows = list(enumerate(texts))
    same(library, B.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_joined_chunks_equal_the_whole():
    rng = np.random.default_rng(2)
    encoder = Encoder.of()
    for _ in range(20):
        text = " ".join("".join(rng.choice(list("abcde é1'\n"), rng.integers(1, 9))) for _ in range(2000)).encode()
        data = np.frombuffer(text, dtype=np.uint8)
        edges = B.chunks(data)
        ids = [np.frombuffer(encoder.encode(text[a:b].decode()), dtype="<u4") for a, b in zip(edges[:-1], edges[1:])]
        assert B.assemble(data, edges, ids, encoder).tobytes() == encoder.encode(text.decode())
        assert len(edges) > 2


def test_odd_rows(odd, empty, library):
    same(library, B.encode(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert B.encode(empty).count() == 0
    kept = {r.doc_id: r.ids for r in B.encode(odd, keep_ids=True).collect()}
    assert np.frombuffer(kept[5], dtype="<u4").tolist() == library.encode(odd.where("doc_id = 5").first().text, add_special_tokens=False).ids
