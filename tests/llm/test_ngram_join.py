"""The n-gram join against comparing all pairs."""

import random
import re

import pytest
from conftest import by_text, rows_of

from quotalens.llm import ngram_join
from quotalens.llm.components import components
from quotalens.llm.ngram_join import ngram_components


def brute(docs, k=5, percent=80):
    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    by_id = {}
    for i, (d, _) in enumerate(docs):
        if d in by_id and sets[i] and sets[i] == sets[by_id[d]]:
            up[find(i)] = find(by_id[d])
        by_id.setdefault(d, i)
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def chain(seed, n=260):
    """Copies of a few texts with edits, and chains of edits, with a very common line."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    docs, bases = [], [[rnd.choice(words) for _ in range(size)] for size in (6, 9, 24, 40, 90, 160, 300)]
    for i in range(n):
        text = list(rnd.choice(bases)) if i % 3 else list(docs[-1][1]) if docs else list(bases[0])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6, 9])):
            at = rnd.randrange(len(text))
            text[at : at + 1] = rnd.choice([[], [rnd.choice(words)], [text[at], rnd.choice(words)]])
            text = text or ["x"]
        docs.append((i, text))
    line = "one very common line of words in many many texts".split()
    return [(d, " ".join(t + (line if d % 2 else []))) for d, t in docs]


@pytest.mark.parametrize("seed,boundary", [(1, None), (2, 0), (3, 10**9), (4, 60), (5, None)])
def test_against_all_pairs(spark, monkeypatch, seed, boundary):
    if boundary is not None:
        monkeypatch.setattr(ngram_join, "size_boundary", lambda sets, percent: boundary)
    docs = chain(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = sorted(rows_of(ngram_components(df)), key=str)
    want = brute(docs)
    assert got == want
    assert len({c for _, _, c in want}) < 200


def test_odd_texts(made):
    assert sorted(rows_of(ngram_components(made)), key=str) == brute(by_text(made))
    assert rows_of(ngram_components(made.limit(0))) == []
    assert sorted(rows_of(ngram_components(made, 3, 60)), key=str) == brute(by_text(made), 3, 60)


def test_components_of_long_chains(spark):
    rnd = random.Random(2)
    order = list(range(200))
    rnd.shuffle(order)
    links = list(zip(order, order[1:])) + [(1000, 1001), (1002, 1001)] + [(2000, 2000 + i) for i in range(1, 90)]
    got = dict(rows_of(components(spark.createDataFrame(links, "a long, b long"))))
    assert all(got[i] == 0 for i in range(200)) and got[1002] == 1000 and got[2089] == 2000
