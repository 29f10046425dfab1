"""Sampling over the piece lattice against enumerating all segmentations."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from conftest import rows_of
from hypothesis import given, settings, strategies as st

from quotalens.llm import lattice
from quotalens.llm.hashing import text_bytes
from quotalens.llm.lattice import MODEL, Pieces, Sampler, decoded, sampled_pieces
from quotalens.llm.tokens import tokenizer_path


def draw(texts, keys=None, smoothing=1.0, seed=0):
    data, at = text_bytes(pa.array(texts, pa.string()))
    ids, begins = Sampler(MODEL, smoothing, seed).slice(data, at, np.arange(len(texts)) if keys is None else np.array(keys))
    return [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]


def joined(ids):
    return b"".join(Pieces.of(MODEL).text[i] for i in ids).decode()[1:]


def segmentations(raw):
    own = Pieces.of(MODEL)
    found = {t: i for i, t in enumerate(own.text) if t and i not in set(own.byte_id.tolist())}
    out = []

    def go(at, path, weight):
        if at == len(raw):
            out.append((tuple(path), math.exp(weight)))
        for k in range(1, 17):
            i = found.get(raw[at : at + k])
            if i is not None and at + k <= len(raw):
                go(at + k, [*path, i], weight + own.log_weight[i])

    go(0, [], 0.0)
    total = sum(w for _, w in out)
    return {p: w / total for p, w in out}


def test_shares_are_exact():
    want = segmentations(b" thenre")
    n = 20_000
    got = Counter(map(tuple, draw(["thenre"] * n)))
    assert set(got) <= set(want) and len(want) > 10
    for path, share in want.items():
        assert abs(got[path] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_reproducible_and_lossless():
    texts = ["", " ", "  two  spaces ", "a▁b", "tab\tand\nline", "éñ 漢字 😀 \x00", "word " * 50, "x" * 2000, "Thstinnt thndhain. Onhalyti"]
    ids = draw(texts)
    assert [joined(i) if i else "" for i in ids] == texts
    assert draw(texts) == ids and draw(texts, seed=1) != ids
    assert draw(texts[::-1], list(range(len(texts)))[::-1]) == ids[::-1]  # neighbours don't matter
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    assert sp.decode(ids[8]) == texts[8] and sp.decode(ids[6]) == texts[6]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é▁ \n漢😀xThe"), max_size=25), min_size=1, max_size=4))
def test_round_trip(texts):
    assert [joined(i) if i else "" for i in draw(texts)] == texts


def test_query_shape(made):
    pieces = sampled_pieces(made)
    back = decoded(pieces)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, made.selectExpr("doc_id", "coalesce(text, '') AS text").collect()))
    assert sorted(map(str, rows_of(sampled_pieces(made.repartition(2))))) == sorted(map(str, rows_of(pieces)))
    assert rows_of(decoded(sampled_pieces(made.limit(0)))) == []


def test_equal_units_are_drawn_side_by_side(monkeypatch):
    first, real = [], lattice._draw

    def seen(rows, ordinal, step):
        first.append(ordinal.tolist())
        return real(rows, ordinal, step)

    monkeypatch.setattr(lattice, "_draw", seen)
    draw(["xyq jkv " * 40])
    kinds = [n % 2 for n in first[0] if n < 80]
    assert sorted(first[0]) == list(range(len(first[0]))) and sum(a != b for a, b in zip(kinds, kinds[1:])) == 1
