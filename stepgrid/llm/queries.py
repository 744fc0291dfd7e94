"""Registered queries of the package with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgrid.llm.bpe_trie import encode_and_decode
from stepgrid.llm.decontaminate import contamination
from stepgrid.llm.exact_dedup import DigestIndex, deduplicate
from stepgrid.llm.language import identify
from stepgrid.llm.near_dedup import near_duplicates
from stepgrid.llm.phrases import COLLOCATIONS_SQL, collocations
from stepgrid.llm.quality import quality
from stepgrid.llm.secrets import find_secrets
from stepgrid.llm.surrogates import with_surrogates
from stepgrid.llm.token_counts import token_counts
from stepgrid.llm.token_files import token_file_round_trip
from stepgrid.llm.urls import RULES, URLS_SQL, judge_pages, rule_table
from stepgrid.llm.whitening import whiten
from stepgrid.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; the same path on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_token_files")
def _(spark, sf_dir):
    return token_file_round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


@query(
    "op5_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def _(spark, sf_dir):
    return deduplicate(documents(spark, sf_dir), DigestIndex(spark))


@query("op8_token_counts")
def _(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@query("op9_bpe_round_trip")
def _(spark, sf_dir):
    coded = encode_and_decode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


NEAR_SQL = r"""
    WITH RECURSIVE lowered AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    split AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lowered),
    shingles AS (
      SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
          ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s FROM split)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    pairs AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (
      SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
    least AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY 1)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id,
      coalesce(l.component, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)"""


@query("op3_near_dedup", NEAR_SQL)
def _(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), size=4, percent=80)


@query("op10_decontamination")
def _(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark).select("doc_id", "contaminated", "coverage", "item_id", "n_items")


@query("op2_secret_scan")
def _(spark, sf_dir):
    # a source is an owner, its documents of one language a repository
    return find_secrets(documents(spark, sf_dir), F.concat_ws("/", "source", "lang"), F.col("source"))


@query("op6_quality_perplexity")
def _(spark, sf_dir):
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op7_language_id")
def _(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return identify(documents(spark, sf_dir), held_out)


@query("op4_surrogates")
def _(spark, sf_dir):
    return with_surrogates(documents(spark, sf_dir), key="stepgrid surrogate key")


@query("op11_embedding_whitening")
def _(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_url_filter", URLS_SQL)
def _(spark, sf_dir):
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


@query("op13_collocations", COLLOCATIONS_SQL)
def _(spark, sf_dir):
    return collocations(documents(spark, sf_dir))
