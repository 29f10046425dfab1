"""A corpus from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.  Empty tables give empty tables, nulls are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quotalens.llm.host_rules import judge
from quotalens.llm.line_chunks import line_dedup
from quotalens.llm.ngram_join import linked_documents
from quotalens.llm.packing import best_fit_packing
from quotalens.llm.store import saved
from quotalens.llm.suffix_dedup import suffix_dedup


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order; n_chars follows the text."""
    return rows.select(*[F.length("text").cast(kind).alias(name) if name == "n_chars" else F.col(name) for name, kind in docs.dtypes])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    out = judge(docs).where(~F.col("kept")).select(F.col("doc_id").alias("of"), "text_key").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(out["of"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == out["text_key"])
    return docs.join(out, same, "left_anti")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; a document of which nothing is left goes with them."""
    cut = line_dedup(docs).where((F.col("n_removed_chunks") == 0) | (F.trim("text") != ""))
    return _with_text(docs, cut)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row stays, the least by doc_id (null last) and hash of its text.

    Of rows equal in both the least by all columns stays.  Texts without words are similar to nothing and stay.
    """
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key"))
    seen = linked_documents(docs).where("first_key IS NOT NULL").groupBy(F.col("doc_id").alias("of"), "text_key").agg(F.max(first).alias("first"), F.count("*").alias("n"))
    out = saved(seen.where("NOT first OR n > 1").drop("n"), "verdicts")
    of, key = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(out, of.eqNullSafe(out["of"]) & (key == out["text_key"]), "left_anti")
    copied = out.where("first")
    if copied.isEmpty():
        return kept
    copies = docs.join(copied, of.eqNullSafe(copied["of"]) & (key == copied["text_key"]), "left_semi")
    return kept.union(copies.groupBy(of, key).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that repeat are cut from every document."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = suffix_dedup(docs, carry=others or None, as_text=True)
    return _with_text(docs, cut.select("doc_id", F.col("kept").alias("text"), *(["rest.*"] if others else [])))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2048 tokens."""
    return best_fit_packing(docs, special=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("best-fit packing", packing),
]

#: Tokens and byte strings are beyond SQL; tests/llm/test_pipeline.py holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = saved(docs, f"stage-{number}")
    return docs
