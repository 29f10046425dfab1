"""Content-defined chunks of lines: repeated multi-line chunks are removed after comparing their bytes.

DataFrame functions only.  A rolling hash over the hashes of two neighbouring lines chooses where a chunk
begins, so lines inserted above do not move the cuts below.  Chunk hashes are counted without text; only
chunks whose hash repeats are compared byte by byte with the first of them, and dropped if equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A chunk begins at one line in so many.
ONE_IN = 4


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's argument is not evaluated anew at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_chunks(text: Column, one_in: int = ONE_IN) -> Column:
    """Array of (chunk, n_lines) of a text, in order; joined by line breaks the chunks give the text.

    n_lines counts the lines with something but white space.
    """

    def begins(hashes: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(hashes) - 1),
            lambda i: (i == 0) | (F.pmod(F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)), F.lit(one_in)) == 0),
        )

    def cut(lines: Column) -> Column:
        at = _bound(F.transform(lines, lambda line: F.xxhash64(line)), begins)

        def chunk(own: Column) -> Column:
            return F.named_struct(F.lit("chunk"), F.array_join(own, "\n"), F.lit("n_lines"), F.size(F.filter(own, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))))

        return _bound(at, lambda b: F.transform(b, lambda low, k: _bound(F.slice(lines, low + 1, F.coalesce(F.get(b, k + 1), F.size(lines)) - low), chunk)))

    return _bound(F.split(text, "\n", -1), cut)


def line_dedup(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """Remove chunks of two or more lines that occur earlier in the corpus; the first by doc_id and place stays.

    ``docs`` needs doc_id and text; all its columns come back with text replaced, and n_removed_chunks
    (long) is added.  Blank lines do not count as lines of a chunk.  A null text stays null and an empty
    one empty.  Rows that share a doc_id are one document for the choice of the first: the same chunk at
    the same place of both stays in both.  Otherwise they are told apart by a hash of their text, as
    are rows without an id: each loses only chunks of its own that were compared.  A null doc_id comes before all others.  Line breaks around a
    removed chunk go with it.  Two different chunks of one hash both stay.  An empty table gives an
    empty table.
    """
    columns = docs.columns
    row_id, text_column = f"c{columns.index('doc_id')}", f"c{columns.index('text')}"
    rows = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # no name of the caller's can clash
    chunks = line_chunks(F.col(text_column), one_in)

    # a row is known by its id and its text's hash, as an id may be null or shared
    rows = rows.withColumn("key", F.xxhash64(text_column))

    # (id, key, place, hash) of each chunk of several lines, without its text
    marks = F.transform(chunks, lambda c, k: F.named_struct(F.lit("k"), k, F.lit("h"), F.when(c["n_lines"] > 1, F.xxhash64(c["chunk"]))))
    hashed = rows.where(F.col(text_column).contains("\n")).select(F.col(row_id).alias("id"), "key", F.explode(marks).alias("s")).select("id", "key", "s.k", "s.h").where("h IS NOT NULL")
    repeated = hashed.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "k")).alias("first")).where("n > 1").drop("n")
    suspects = (
        hashed.join(repeated, "h").select("id", "key", F.struct("k", "h", "first").alias("s"))
        .groupBy(F.col("id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set("s").alias("suspects"))  # at most the chunks of one text
    )

    # the text of suspected chunks, and of the first of each hash
    same_row = F.col(row_id).eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    texts = rows.join(suspects, same_row).select(F.col(row_id).alias("id"), "key", "suspects", chunks.alias("chunks"))
    shown = texts.select("id", "key", "chunks", F.inline("suspects")).select("id", "key", "k", "h", "first", F.get("chunks", F.col("k"))["chunk"].alias("chunk"))
    is_first = F.struct("id", "k").eqNullSafe(F.col("first"))
    firsts = shown.where(is_first).groupBy("h").agg(F.max("chunk").alias("first_chunk"))
    gone = (
        shown.where(~is_first).join(firsts, "h").where(F.col("chunk") == F.col("first_chunk"))
        .groupBy(F.col("id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set("k").alias("gone"))
    )
    cut = rows.join(gone, same_row, "left")
    kept = F.array_join(F.filter(chunks, lambda c, k: ~F.array_contains("gone", k))["chunk"], "\n")
    text = F.when(F.col("gone").isNull(), F.col(text_column)).otherwise(kept)
    out = [(text if name == "text" else F.col(f"c{i}")).alias(name) for i, name in enumerate(columns)]
    return cut.select(*out, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"))
