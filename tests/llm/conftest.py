import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))

AWKWARD = [
    (0, None, "a"), (1, "", "a"), (2, " \t\n ", None), (3, "one", "b"), (None, "no id here but words", "b"),
    (4, "word " * 300, "a"), (5, "x" * 3000, "a"), (6, "é ü ñ " * 90, "b"), (7, "a b c d", "b"), (7, "a b c d", "b"),
    (8, "A b C d E f\n\nG h\r\nI j " * 20, None), (9, "a b  c 　 d e  \n\n f", "a"), (10, "the 'll don't <|endoftext|> x  ", "a"),
]


@pytest.fixture(scope="session")
def made(spark):
    """Texts with copies, near copies, shared passages and odd cases; extra columns clash with internal names."""
    import random

    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeéXY") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(70)]
    rows = list(AWKWARD)
    base = [rnd.choice(vocabulary) for _ in range(150)]
    for i in range(100, 220):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 30, 120, 400]))]
        if i % 4 == 0:
            at = rnd.randrange(len(words))
            words[at:at] = passage[rnd.randrange(20) : 70 - rnd.randrange(20)]
        if i % 5 == 0:
            words = list(base)
            for _ in range(rnd.randrange(9)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        if i % 17 == 0:
            words += words[: len(words) // 2]
        text = "".join(w + rnd.choice([" ", " ", " ", "\n", ". "]) for w in words)
        rows.append((i, rows[-1][1] if i % 13 == 0 else text, "ab"[i % 2]))
    rows.append((500, rows[40][1], "a"))
    data = [(d, t, s, "en", "clash", "clash") for d, t, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, chunk string, n_words string").repartition(5)


@pytest.fixture(scope="session")
def spark():
    from quotalens.session import local_session

    session = local_session(4, 4, "4g")
    yield session
    session.stop()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def by_text(made):
    return [(r.doc_id, r.text or "") for r in made.collect()]
