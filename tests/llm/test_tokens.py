"""Encoding, packing and wavelet files against the tokenizer itself and plain lists."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import AWKWARD, by_text, rows_of
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quotalens.llm.packing import best_fit_packing, packed_sequences, plan_sequences
from quotalens.llm.tokens import Encoder, tokenizer_path
from quotalens.llm.wavelet import WaveletMatrix, read_documents, shard_starts, token_counts, write_shards


def plain(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name,words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_units_give_the_same_ids(name, words):
    want, own = plain(name), Encoder(name, words)

    def check(texts):
        got = []
        for _, ids, begins in own.encode(pa.array(texts, pa.string())):
            got += [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]
        assert got == [want(t) for t in texts]

    check([t or "" for _, t, _ in AWKWARD])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.sampled_from("aB é'sI\t\n\r\x0b  　\x85\x1c1!Σ́<|>x"), max_size=30), min_size=1, max_size=4))
    def drawn(texts):
        check(texts)

    drawn()


def test_wavelet_operations():
    rnd = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.zeros(3, np.uint32), rnd.integers(0, 50257, 3000).astype(np.uint32), rnd.integers(0, 3, 1500).astype(np.uint32), np.array([70000, 2, 2], np.uint32)):
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
        assert m.decode().tolist() == ids.tolist()
        for i in range(0, len(ids), 97):
            token = int(ids[i])
            places = np.flatnonzero(ids == token)
            assert m.access(i) == token and m.rank(token, i) == int((places < i).sum())
            assert [m.select(token, k) for k in range(min(5, len(places)))] == places[:5].tolist()
        assert m.rank(99999999, len(ids)) == 0


def test_shards_round_trip(made):
    want, encode, start = [], plain("byte_bpe_50k.json"), 0
    for d, t in sorted(by_text(made), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*encode(t), 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    shards = write_shards(made, shard_tokens=700)
    assert sorted(rows_of(read_documents(shards)), key=lambda r: r[1]) == want
    assert sum(r[2] for r in rows_of(token_counts(shards, 2))) >= len(want)
    assert shard_starts(shards).count() > 8
    assert rows_of(read_documents(write_shards(made.limit(0)))) == []


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_packing(made):
    encode = plain("word_bpe_49k.json")
    for capacity in (64, 2048):
        rows = best_fit_packing(made, capacity).collect()
        want = Counter()
        for d, t in by_text(made):
            ids = [*encode(t), 0]
            for piece, a in enumerate(range(0, len(ids), capacity)):
                part = ids[a : a + capacity]
                want[d, piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        used, total = check_packing(rows, capacity)
        assert used <= -(-total // capacity) * 1.02 + 1
    placed = best_fit_packing(made, 64)
    sequences = packed_sequences(made, placed, 64).collect()
    assert sorted(len(r.ids) for r in sequences) == sorted(r["n"] for r in placed.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect())
    assert rows_of(best_fit_packing(made.limit(0))) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 200), max_size=40))
def test_plan_uses_every_piece_once(counts):
    plan, used = plan_sequences(counts, 40), Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 40 and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)


def loaded(name):
    """The tokenizer as its file gives it."""
    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name,words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_special_literals_get_their_ids(name, words):
    want, own = loaded(name), Encoder(name, words, special=True)

    def check(texts):
        got = []
        for _, ids, begins in own.encode(pa.array(texts, pa.string())):
            got += [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]
        assert got == [want(t) for t in texts]

    check([t or "" for _, t, _ in AWKWARD])
    assert want("<|endoftext|>") != plain(name)("<|endoftext|>")
    piece = st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "endoftext", "A", "b", "É", " ", "  ", "\n", "\u3000", "'S"])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(piece, max_size=9).map("".join), min_size=1, max_size=4))
    def drawn(texts):
        check(texts)

    drawn()


def test_queries_give_special_literals_their_ids(spark, tmp_path):
    from corpus_pipeline import packing
    from quotalens.llm.queries import QUERIES

    texts = ["plain words first", "The End  <|endoftext|> x", "A<|ENDOFTEXT|>b", "more words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want, start = [], 0
    for d, t in enumerate(texts):
        ids = [*loaded("byte_bpe_50k.json")(t), 2]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(rows_of(QUERIES["op6_wavelet_matrix"](spark, str(tmp_path)))) == want
    want = [(d, crc([*loaded("word_bpe_49k.json")(t), 0])) for d, t in enumerate(texts)]
    for out in (QUERIES["op10_best_fit_packing"](spark, str(tmp_path)), packing(spark, docs, "")):
        assert sorted((r.doc_id, r.ids_crc32) for r in out.collect()) == want


def test_an_encoder_takes_little_beside_its_words():
    encoder = Encoder.of("word_bpe_49k.json", words=True)
    texts = pa.array(["word and other words " * 10_000] * 16)
    list(encoder.encode(texts))
    tracemalloc.start()
    list(encoder.encode(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000  # 86 MB with slices of 2 MB


def test_slices_and_memory_change_no_ids():
    want, texts = plain("byte_bpe_50k.json"), [t or "" for _, t, _ in AWKWARD] * 3
    small = Encoder.of("byte_bpe_50k.json", words=False, slice_bytes=64, remembered=40)
    assert small is not Encoder.of("byte_bpe_50k.json", words=False)
    got, forgot = [], small.forget
    times = []
    small.forget = lambda: (times.append(1), forgot())
    for _, ids, begins in small.encode(pa.array(texts, pa.string())):
        got += [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]
    assert got == [want(t) for t in texts] and times
