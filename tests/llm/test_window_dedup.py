"""Window deduplication against counting every window in plain Python."""

import re
from collections import Counter

from conftest import by_text, rows_of

from quotalens.llm.substring_dedup import substring_dedup
from quotalens.llm.suffix_dedup import suffix_dedup


def covered(sequences, size):
    seen = Counter(tuple(s[i : i + size]) if isinstance(s, list) else s[i : i + size] for s in sequences for i in range(len(s) - size + 1))
    for s in sequences:
        marks = [False] * len(s)
        for i in range(len(s) - size + 1):
            if seen[tuple(s[i : i + size]) if isinstance(s, list) else s[i : i + size]] > 1:
                marks[i : i + size] = [True] * size
        yield marks


def want_words(docs, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in docs]
    return sorted(((d, " ".join(w for w, m in zip(ws, ms) if not m), len(ws), sum(ms)) for (d, _), ws, ms in zip(docs, words, covered(words, size))), key=str)


def want_bytes(docs, size):
    out = []
    texts = [t.encode() for _, t in docs]
    for (d, _), t, ms in zip(docs, texts, covered(texts, size)):
        out.append((d, bytes(b for b, m in zip(t, ms) if not m), len(t), sum(ms), sum(m and not p for m, p in zip(ms, [False, *ms]))))
    return sorted(out, key=str)


def test_words(made):
    for size in (13, 35):
        got = sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup(made, size).collect()), key=str)
        assert got == want_words(by_text(made), size)
        assert sum(r[3] for r in got) > 500


def test_bytes(made):
    for size in (50, 200):
        got = sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(made, size).collect()), key=str)
        assert got == want_bytes(by_text(made), size)
        assert sum(r[3] for r in got) > 2000


def test_many_chunks(made, monkeypatch):
    from quotalens.llm import chunks

    real = chunks.chunked
    monkeypatch.setattr(chunks, "chunked", lambda docs, carry=None: real(docs, carry, 3000, 2000))
    got = sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(made, 200).collect()), key=str)
    assert got == want_bytes(by_text(made), 200)
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup(made, 35).collect()), key=str)
    assert got == want_words(by_text(made), 35)


def test_empty_and_carried(made):
    assert rows_of(suffix_dedup(made.limit(0))) == [] and rows_of(substring_dedup(made.limit(0))) == []
    got = substring_dedup(made, carry=["source", "chunk", "n_words"]).select("doc_id", "rest.*").collect()
    assert sorted(map(str, got)) == sorted(map(str, made.select("doc_id", "source", "chunk", "n_words").collect()))
