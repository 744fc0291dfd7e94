"""A training corpus from raw documents: the stages, and a run of all of them.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``docs``, whatever they are besides ``doc_id, text,
lang``; names that an operator uses itself may be among them. Empty tables give
empty tables, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgrid.llm.bpe_trie import encode_and_decode
from stepgrid.llm.decontaminate import keep_clean
from stepgrid.llm.exact_dedup import DigestIndex, keep_distinct
from stepgrid.llm.near_dedup import keep_one
from stepgrid.llm.quality import keep_good
from stepgrid.llm.queries import tokenizer_path
from stepgrid.session import configure, fresh_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under models of trusted text is not above their language's threshold.

    Repeated rows are judged each, rows without an id or a language too; null
    and empty texts have no perplexity and are kept.
    """
    configure(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; a null text equals an empty one.

    Of rows that repeat text and id one stays; a null id is the smallest, and
    rows that share a text but all lack an id stay.
    """
    configure(spark)
    return keep_distinct(docs, DigestIndex(spark))


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near-duplicates (five-word shingles, similarity 0.8) the one with the smallest id.

    Documents without words are linked with nothing.
    """
    configure(spark)
    return keep_one(docs, size=5, percent=80)


def unseen_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark, in whatever order of passages.

    Null and empty texts and items match nothing; repeated rows are judged each.
    """
    configure(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of every document; a null text counts as empty."""
    configure(spark)
    coded = encode_and_decode(docs, tokenizer_path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("MinHash near-dedup", distinct_contents),
    ("benchmark decontamination", unseen_tests),
    ("BPE encoding and decoding", encoded),
]

# no SQL: a language model, a tokenizer and greedy tiling are beyond it
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
