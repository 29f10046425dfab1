"""The pipeline against a composition of brute-force stages."""

import zlib
from collections import Counter

import numpy as np
import corpus_pipeline
from quotalens.llm.line_chunks import line_chunks
from test_ngram_join import brute
from test_rules_and_media import plain_counts
from test_tokens import check_packing, plain
from test_window_dedup import covered


def rows_by_hand(spark, docs):
    kept = []
    for d, t in docs:
        n_words, _, _, _, repeated = plain_counts(t or "")
        if not (n_words < 20 or 100 * repeated > 30 * n_words):
            kept.append((d, t))
    cut = {(r.doc_id, r.text): r.c for r in spark.createDataFrame(kept, "doc_id long, text string").select("doc_id", "text", line_chunks("text").alias("c")).collect()}
    first = {}
    for (d, _), own in cut.items():
        for k, c in enumerate(own):
            if c.n_lines > 1:
                first[c.chunk] = min(first.get(c.chunk, (d, k)), (d, k))
    lined = []
    for d, t in kept:
        left = [c.chunk for k, c in enumerate(cut[d, t]) if c.n_lines < 2 or first[c.chunk] == (d, k)]
        if len(left) == len(cut[d, t]) or "\n".join(left).strip(" "):
            lined.append((d, "\n".join(left)))
    least = {d: c for d, _, c in brute(lined)}
    single = [(d, t) for d, t in lined if least[d] == d]
    texts = [t.encode() for _, t in single]
    encode, out = plain("word_bpe_49k.json"), Counter()
    for (d, _), t, marks in zip(single, texts, covered(texts, 200)):
        ids = [*encode(bytes(b for b, m in zip(t, marks) if not m).decode(errors="ignore")), 0]
        for piece, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            out[d, piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out, (len(docs), len(kept), len(lined), len(single))


def test_stages_and_run(spark, made, tmp_path):
    shared = [f"line {i} that several documents share here" for i in range(9)]
    docs = [(r.doc_id, r.text) for r in made.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    docs += [(3000 + i, "\n".join([f"own words {i} {j} at the start" for j in range(4)] + shared + [f"own words {i * j + 7} at the end {j}" for j in range(5)])) for i in range(12)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", "ab"[d % 2], 7) for d, t in docs], columns).write.parquet(f"{tmp_path}/documents.parquet")
    want, sizes = rows_by_hand(spark, docs)
    assert sizes[0] > sizes[1] > sizes[3] > 20
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_packing(rows, 2048)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        if name != "best-fit packing":
            assert out.dtypes == empty.dtypes


def test_one_row_of_each_component_stays(spark, tmp_path):
    def text(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))

    near = text("a") + " end"
    docs = [
        (1, text("a"), "x"), (5, near, "x"), (5, text("clean"), "x"),  # 5 is a copy of 1, and a text of its own
        (7, text("b"), "z"), (7, text("b"), "y"), (7, text("b"), "y"),  # equal rows of one id
        (None, text("c"), "x"), (None, text("c"), "y"), (None, text("c") + " end", "x"),  # copies without ids
        (None, text("a"), "x"), (None, text("alone"), "x"),
        (None, "", "x"), (None, "", "x"), (8, None, "x"), (9, " ", "x"),  # nothing to compare
    ]
    df = spark.createDataFrame([(d, t, "en", s, 7) for d, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    without = [r for r in got if r[0] is None and (r[1] or "").startswith("c0 ")]
    assert len(without) == 1 and without[0] in docs
    want = [(1, text("a"), "x"), (5, text("clean"), "x"), (7, text("b"), "y"), (None, text("alone"), "x"), *without, *docs[-4:]]
    assert sorted(got, key=str) == sorted(want, key=str)
