"""The corpus pipeline: five stages from raw documents to SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.  Each works on all rows that its predecessor kept.

Defined results: a null or empty text fails the quality rules; a null source has
no host verdict; rows with equal ids and texts are one document to lines and near-
duplicates, and one of them stays; null ids are ids like any other; very long texts
are taken whole; extra columns of any name are carried; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, lines, neardup, pieces, quality
from gridloom.llm.common import Scratch


def _carried(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, and the whole row as ``row``, so that no name in it can clash."""
    return docs.select(*[docs[f"`{c}`"] for c in columns], F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither their own rules nor their host's verdict reject."""
    return quality.drop_rejected(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of lines with a word go, and documents of which nothing but white space is left."""
    cut = lines.dedup_lines(_carried(docs, "doc_id", "text"))
    gone = (F.col("n_removed") > 0) & (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.where(~gone).select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, 0.8)."""
    return neardup.deduplicate(docs, p=neardup.MinHash(percent=80, bands=30))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces (ids) and n_pieces, and whether decoding gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    marked = docs.select("doc_id", "text", F.md5("text").alias("of_text"))
    back = pieces.encode(marked, path, keep=["doc_id", "of_text"], decoded=True, memo=100_000)
    return back.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), (F.md5("decoded") == F.col("of_text")).alias("round_trip"))


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = docs
    return docs


#: Near-duplicate groups and SentencePiece have no SQL form: the pipeline is tested against a brute-force version of all stages.
ORACLE_SQL = None
