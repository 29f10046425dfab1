"""Reply trees, structure repair and vector codes against brute-force versions."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

MESSAGES = "tree_id long, message_id long, parent_id long, role string, text string, score double, tree string, node string, above int"


def chat(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def paths_by_hand(rows):
    """{tree: {leaf: [message ids from the root]}} of rows with unique ids and without cycles."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values() if r[2] in own}
        for leaf in own:
            if leaf not in parents:
                path = [leaf]
                while own[path[-1]][2] in own:
                    path.append(own[path[-1]][2])
                out.setdefault(tree, {})[leaf] = path[::-1]
    return out


@pytest.fixture(scope="module")
def trees():
    rnd = random.Random(3)
    rows = []
    for tree in range(6):
        for i in range(40 if tree else 130):
            parent = None if i == 0 else rnd.choice([i - 1, i - 1, rnd.randrange(i), 999 if i % 17 == 0 else i - 1])
            text = rnd.choice(["plain", "<|im_end|>", "<\\|", "<\\\\|x|>", "a\nb", "", "é <", "| % %25"])
            rows.append((tree, i, parent, rnd.choice(["user", "assistant", "sys|tem\n%7C"]), text, float(rnd.randrange(4)), "clash", "clash", 1))
    return rows


def test_paths_and_formats(spark, trees):
    from quotalens.llm.reply_trees import format_trees, read_chats

    chats = read_chats(format_trees(spark.createDataFrame(trees, MESSAGES).repartition(3), paths_per_tree=None)).collect()
    expected = paths_by_hand(trees)
    by_id = {(r[0], r[1]): r for r in trees}
    assert {(c.tree_id, c.leaf_id) for c in chats} == {(t, leaf) for t, own in expected.items() for leaf in own}
    for c in chats:
        own = [by_id[c.tree_id, i] for i in expected[c.tree_id][c.leaf_id]]
        assert [(t.role, t.text) for t in c.turns] == [(r[3], r[4]) for r in own]
        assert c.learnt == [r[4] for r in own if r[3] == "assistant"]
        assert c.score == pytest.approx(np.mean([r[5] for r in own]))
        assert sum(s.end - s.start for s in c.loss) == sum(len(c.formatted[s.start : s.end]) for s in c.loss)
    for tree in expected:
        ranked = sorted((c for c in chats if c.tree_id == tree), key=lambda c: c.rank)
        assert [c.rank for c in ranked] == list(range(1, len(ranked) + 1))
        assert ranked == sorted(ranked, key=lambda c: (-c.score, f"i{c.leaf_id}"))
    best = format_trees(spark.createDataFrame(trees, MESSAGES), paths_per_tree=2).select("tree_id", "leaf_id", "rank").collect()
    assert {tuple(r) for r in best} == {(c.tree_id, c.leaf_id, c.rank) for c in chats if c.rank <= 2}


def test_best_replies_cut_whole_branches(spark):
    from quotalens.llm.reply_trees import format_trees

    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 3, "user", "under bad", 9.0), (1, 5, 2, "user", "under good", 0.0)]
    got = format_trees(spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double"), best_replies=1, paths_per_tree=None).collect()
    assert [g.formatted for g in got] == [chat([("user", "q"), ("assistant", "good"), ("user", "under good")])]


def test_awkward_messages(spark):
    from quotalens.llm.reply_trees import format_trees, read_chats

    rows = [
        (None, 1, None, None, None, None, "", "", 0), (None, 2, 1, "assistant", "in no tree", float("nan"), "", "", 0),
        (7, 1, 2, "user", "cycle", 1.0, "", "", 0), (7, 2, 1, "user", "cycle", 1.0, "", "", 0), (7, 3, 2, "user", "below it", 1.0, "", "", 0),
        (8, 1, None, "user", "twice", 1.0, "", "", 0), (8, 1, None, "user", "twice", 1.0, "", "", 0), (8, 1, None, "user", "better", 2.0, "", "", 0),
        (9, None, 1, "assistant", "no id", 0.0, "", "", 0), (9, 1, None, "user", "long " * 40000, 0.0, "", "", 0), (9, 5, 5, "user", "own parent", 0.0, "", "", 0),
    ]
    got = read_chats(format_trees(spark.createDataFrame(rows, MESSAGES), paths_per_tree=None)).collect()
    assert {(g.tree_id, g.leaf_id): [tuple(t) for t in g.turns] for g in got} == {
        (None, 2): [("", ""), ("assistant", "in no tree")], (8, 1): [("user", "better")], (9, None): [("user", "long " * 40000), ("assistant", "no id")]}
    none = format_trees(spark.createDataFrame([], MESSAGES))
    assert none.collect() == [] and none.columns == ["tree_id", "leaf_id", "rank", "score", "formatted", "loss"]


def test_a_deep_chain(spark):
    from quotalens.llm.reply_trees import conversation_messages, format_trees, read_chats

    turns = [(5, i, "ua"[i % 2], f"t{i}") for i in range(700)] + [(5, None, "first", None), (6, 1, "b", "x"), (6, 1, "a", "x"), (6, 1, "a", "x")]
    got = {g.tree_id: [tuple(t) for t in g.turns] for g in read_chats(format_trees(conversation_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))).collect()}
    assert got == {5: [("first", "")] + [("ua"[i % 2], f"t{i}") for i in range(700)], 6: [("a", "x"), ("a", "x"), ("b", "x")]}


# --- repair -----------------------------------------------------------------------------------


def legal(roles):
    rest = roles[1:] if roles.startswith("s") else roles
    return roles == "" or (rest != "" and rest == "ua" * (len(rest) // 2) and len(rest) % 2 == 0)


def repair_by_hand(initials, faults):
    """All edits of the rows and all places of up to as many insertions as can pay."""
    best = None
    n = len(initials)
    for edits in itertools.product("DKR", repeat=n):
        if any(f in (1, 2) and e != "D" for e, f in zip(edits, faults)):
            continue
        base = sum(2 if e == "D" else (e == "R") + 5 * (f == 3) for e, f in zip(edits, faults))
        for extra in range(3):
            cost = base + 5 * extra
            if best and cost > best[0]:
                continue
            for places in itertools.combinations_with_replacement(range(n + 1), extra):
                audit = "".join("I" * places.count(i) + (edits[i] if i < n else "") for i in range(n + 1))
                kept = [("I", "") if a == "I" else (a, i) for a, i in zip(audit, [initials[sum(c != "I" for c in audit[:k])] if audit[k] != "I" else "" for k in range(len(audit))]) if a != "D"]
                for start in ("", "s"):
                    roles = (start + "ua" * len(kept))[: len(kept)]
                    if legal(roles) and all(a != "K" or i == r for (a, i), r in zip(kept, roles)) and all(a == "K" or r in "ua" for (a, i), r in zip(kept, roles)):
                        if best is None or (cost, audit) < best:
                            best = (cost, audit)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=6))
def test_search_finds_the_cheapest_edits(rows):
    from quotalens.llm.structure_repair import best_edits

    initials, faults = [r for r, _ in rows], [f for _, f in rows]
    assert best_edits(initials, faults)[:2] == repair_by_hand(initials, faults)


def fold(initials, faults):
    """Least (cost, audit) by dynamic programming."""
    never = (1 << 60, "")
    plus = lambda s, c, l: (s[0] + c, s[1] + l)
    close = lambda s: (lambda three: [s[0], s[1], three, min(s[3], plus(three, 5, "I"))])(min(s[2], *(plus(s[k], 5, "I") for k in (0, 1, 3))))
    at = close([(0, ""), never, never, never])
    for role, fault in zip(initials, faults):
        new = [plus(s, 2, "D") for s in at]
        if fault in (0, 3):
            extra = 5 * (fault == 3)
            if role == "s":
                new[1] = min(new[1], plus(at[0], extra, "K"))
            for to, awaited, sources in ((2, "u", (0, 1, 3)), (3, "a", (2,))):
                for k in sources:
                    new[to] = min(new[to], plus(at[k], extra + 1, "R"), *([plus(at[k], extra, "K")] if role == awaited else []))
        at = close(new)
    return min(at[0], at[3])


def test_search_on_long_conversations():
    from quotalens.llm.structure_repair import best_edits

    rnd = random.Random(9)
    for n, letters, faults in ((400, "sua", [0]), (400, "ua", [0, 1, 2, 3]), (400, "s", [0]), (1500, "suat", [0, 0, 3]), (3000, "ua", [0]), (400, "a", [0]), (60, "sssu", [0, 3])):
        for _ in range(4):
            initials, own = [rnd.choice(letters) for _ in range(n)], [rnd.choice(faults) for _ in range(n)]
            cost, audit, opened = best_edits(initials, own)
            assert (cost, audit) == fold(initials, own)
            assert opened <= 8 * n + 8  # bounds and tables keep the search near one prefix a row


def test_repair_of_awkward_conversations(spark):
    from quotalens.llm.structure_repair import repair_conversations

    schema = "conv_id long, turn long, role string, text string, present boolean, rows string, audit string"
    rows = [
        (1, 0, "user", "Hi.", True), (1, 1, "assistant", "Yes.", True), (2, 0, "user", "gone", False), (None, 0, None, None, True), (None, None, "user", "Cut", True),
        (3, 4, "user", "A.", True), (3, 4, "user", "A.", True), (3, 9, "assistant", "B! \n", True), (4, 0, "user", "x" * 200000 + ".", True),
    ]
    got = {r.conv_id: r for r in repair_conversations(spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)).collect()}
    short = lambda r: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [tuple(x) for x in r.repaired])
    assert short(got[1]) == (0, 0, 0, 0, 0, 0, "KK", [("user", "Hi."), ("assistant", "Yes.")])
    assert short(got[2]) == (0, 0, 0, 0, 0, 0, "", [])
    assert short(got[None]) == (0, 1, 0, 1, 1, 4, "DD", [])
    assert short(got[3]) == (4, 0, 1, 0, 1, 2, "KDK", [("user", "A."), ("assistant", "B! \n")])
    assert short(got[4]) == (0, 0, 0, 0, 0, 2, "D", [])
    assert repair_conversations(spark.createDataFrame([], schema)).collect() == []


# --- codes ------------------------------------------------------------------------------------


def codes_by_hand(rows, parts, entries, rounds):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = np.array([[int(np.floor(np.float64(np.float32(x)) * 4096)) for x in r[1]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = q[:entries].transpose(1, 0, 2).copy()

    def near():
        d = ((q[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        a, _ = near()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = q[a[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    a, d = near()
    return {(r[0], tuple(r[1])): (tuple(c), int(e)) for r, c, e in zip(kept, a.tolist(), d.sum(1))}, books


@pytest.mark.parametrize("n, spread", [(5, 1.0), (400, 0.05), (400, 3.0)])
def test_codes(spark, n, spread):
    from quotalens.llm.code_books import code_text, vector_codes, with_label_error

    rnd = np.random.default_rng(n)
    centres = rnd.normal(size=(7, 16))
    rows = [(i * 3, [float(np.float32(x)) for x in centres[i % 7] + spread * rnd.normal(size=16)], i % 3 or None, "clash", [1.0]) for i in range(n)]
    rows += [(1, rows[0][1], 1, "", []), (1, rows[0][1], 1, "", []), (2, None, 1, "", []), (4, [1.0] * 15 + [float("nan")], 1, "", []), (5, [None] * 16, 1, "", []), (None, [0.5] * 16, None, "", [])]
    rows += [(10000 + i, [0.25, -0.25] * 8, 2, "", []) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, q string, codes array<double>").repartition(4)
    table, books = vector_codes(df, parts=4, entries=16)
    expected, last = codes_by_hand(rows, 4, 16, 6)
    got = with_label_error(table.withColumn("code", code_text("codes"))).collect()
    assert (books.last == last).all()
    assert books.sha256() == hashlib.sha256(",".join(str(x) for x in last.ravel()).encode()).hexdigest()
    kept = [r for r in rows if (r[0], tuple(r[1] or ())) in expected]
    assert len(got) == len(kept)
    sums = {}
    for r in kept:
        sums[r[2]] = sums.get(r[2], 0) + expected[r[0], tuple(r[1])][1]
    of = {}
    for (i, _), v in expected.items():
        of.setdefault(i, set()).add(v)
    for g in got:
        assert (tuple(g.codes), g.error) in of[g.vec_id] and g.label_error == sums[g.label]
        assert g.code == "".join(f"{c:02x}" for c in g.codes)


def test_bounds_spare_scans(spark):
    from quotalens.llm.code_books import vector_codes

    rnd = np.random.default_rng(1)
    centres = 10 * rnd.normal(size=(16, 16))
    rows = [(i, [float(x) for x in centres[i % 16] + 0.01 * rnd.normal(size=16)], None) for i in range(800)]
    _, books = vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), parts=4)
    assert books.work[0] == (3200, 3200)
    assert sum(measured for _, measured in books.work[1:]) < 0.1 * 3200 * 5


def test_codes_of_nothing_and_of_unfit_vectors(spark):
    from quotalens.llm.code_books import vector_codes, with_label_error

    schema = "vec_id long, embedding array<float>, label int"
    empty, books = vector_codes(spark.createDataFrame([], schema))
    assert with_label_error(empty).collect() == [] and books is None
    with pytest.raises(ValueError, match="one length"):
        vector_codes(spark.createDataFrame([(1, [1.0] * 16, 0), (2, [1.0] * 8, 0)], schema))
    with pytest.raises(ValueError, match="too large"):
        vector_codes(spark.createDataFrame([(1, [1e20] * 8, 0)], schema))
