"""Long regular words that a polynomial hash gives one name, and texts drawn alone and in company."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def twins():
    """A Thue-Morse word of 1024 letters and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_names_differ(twins):
    from quotalens.llm.hashing import byte_prefix, stretch_names

    data = np.frombuffer("".join(twins).encode(), np.uint8)
    begin, end = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(byte_prefix(data).names(begin, end - begin).tolist())) == 1  # the reason for the digest
    assert len(set(stretch_names(data, begin, end).tolist())) == 2


def test_tokens(twins):
    from quotalens.llm.tokens import Encoder, tokenizer_path

    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        want = Tokenizer.from_file(tokenizer_path(name))
        for _, ids, begins in Encoder(name, words).encode(pa.array(list(twins))):
            assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [want.encode(t, add_special_tokens=False).ids for t in twins]


def test_operators_tell_them_apart(spark, twins):
    from quotalens.llm.host_rules import judge
    from quotalens.llm.ngram_join import ngram_components
    from quotalens.llm.packing import best_fit_packing
    from quotalens.llm.substring_dedup import substring_dedup
    from quotalens.llm.tokens import tokenizer_path
    from quotalens.llm.wavelet import read_documents, write_shards

    a, b = twins
    docs = spark.createDataFrame([(1, a, "x"), (2, b, "x"), (3, f"{a}\n{b}\n{a}", "x")], SCHEMA)
    assert {r.doc_id: r.component_id for r in ngram_components(docs).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.n_dup_lines for r in judge(docs).collect()} == {1: 0, 2: 0, 3: 1}
    many = spark.createDataFrame([(1, " ".join([a] + list("cdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQ")), "x"), (2, " ".join([b] + list("cdefghijklmnopqrstuvwxyzABCDEFGHIJ")), "x")], SCHEMA)
    assert {r.doc_id: r.n_removed for r in substring_dedup(many, window=35).collect()} == {1: 0, 2: 0}
    byte, word = (Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    texts = {1: a, 2: b, 3: f"{a}\n{b}\n{a}"}
    assert {r.doc_id: r.ids_crc32 for r in read_documents(write_shards(docs)).collect()} == {d: crc(byte.encode(t, add_special_tokens=False).ids + [2]) for d, t in texts.items()}
    whole = {r.doc_id: r.ids_crc32 for r in best_fit_packing(docs).collect() if r.length < 2048}
    assert all(whole[d] == crc(word.encode(texts[d], add_special_tokens=False).ids + [0]) for d in whole) and whole


def test_a_text_is_drawn_alike_alone_and_in_company(spark, twins):
    from quotalens.llm.lattice import decoded, sampled_pieces

    texts = [(i, f"the quick brown fox {i} jumps over é ü lazy dogs " * (1 + i % 3), "x") for i in range(300)] + [(900, twins[0], "x"), (901, twins[1], "x")]
    drawn = lambda rows: {r.doc_id: (r.ids_crc32, r.text) for r in decoded(sampled_pieces(spark.createDataFrame(rows, SCHEMA).coalesce(1))).collect()}
    whole, mixed = drawn(texts), drawn(texts[::-1])
    assert whole == mixed and {i: t for i, (_, t) in whole.items()} == {i: t for i, t, _ in texts}
    for row in (texts[0], texts[150], texts[299], texts[301]):
        assert drawn([row]) == {row[0]: whole[row[0]]}
