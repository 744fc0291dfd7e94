"""Quality classifier: perplexity under a model of trusted text.

An interpolated modified Kneser-Ney model of bytes is counted over all trusted
documents of each language but every fifth, and of all languages together. The
perplexity of every document under the model of its language is compared with
the spread of the trusted documents that were left out, so the threshold
is that of unseen text. Documents above it are rejected. For that comparison a
text counts with 64 bytes of average text added, as the perplexity of a few
words says little.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgrid.llm.near_dedup import BROADCAST_IDS, with_ids
from stepgrid.llm.ngrams import SCORE_BYTES, Model, Units, bytes_of, estimate, gram_counts, log_probabilities, store
from stepgrid.llm.textbytes import own_worker, slices
from stepgrid.session import settle

UNITS = Units(bytes_of, bits=8, order=5, alphabet=256)
ANY = "*"  # the group of all languages, for documents of a language without a model
HELD_OUT = 5  # one trusted document in so many sets the thresholds
QUANTILE = 0.9  # its distance to the median of log perplexity is the spread of a language; wrong labels under a tenth hardly move it
SPREADS = 2.5  # the threshold lies so many spreads over the median, chosen on labelled documents outside the models (README)
LEAST_SPREAD = 1e-6  # of log perplexity, where the trusted documents left out are all alike
PRIOR_BYTES = 64  # average text added to each document for the decision
MIN_TRUSTED = 50  # trusted documents a language needs for a model of its own


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, row, group, n_units, perplexity`` of rows ``doc_id, row, group, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("models")
        for batch in slices(batches, size=SCORE_BYTES):
            groups = batch.column("group").dictionary_encode()
            codes = groups.indices.to_numpy()
            total, n_units = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for code, group in enumerate(groups.dictionary.to_pylist()):
                mine = np.flatnonzero(codes == code)
                grams, at = model.units.grams(batch.column("text").take(pa.array(mine)))
                kinds, back = np.unique(grams, return_inverse=True)
                running = np.concatenate([[0.0], np.cumsum(log_probabilities(model, kinds, group)[back])])
                total[mine] = running[at[1:]] - running[at[:-1]]
                n_units[mine] = np.diff(at)
            value = pa.array(np.exp(-total / np.maximum(n_units, 1)), mask=n_units == 0)
            columns = [batch.column("doc_id"), batch.column("row"), batch.column("group"), pa.array(n_units), value]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "group", "n_units", "perplexity"])

    rows = docs.select("doc_id", "row", "group", "text")
    return rows.mapInArrow(run, "doc_id long, row long, group string, n_units long, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and never labelled toxic or bad."""
    bad = (F.col("quality") != 1) | (F.coalesce("toxic", F.lit(0)) != 0)
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return good.agg(F.max(bad).alias("bad")).where("NOT bad").select("doc_id")


def _judged(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    """The columns of :func:`quality` and ``row``, a hash of the text that tells rows of one id apart."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(lang_column).cast("string").alias("lang"), text.alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    ids = settle(trusted_ids(labels), "trusted")
    trusted = with_ids(rows, ids)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT))
    sizes = with_ids(rows.select("doc_id", "lang"), ids).where(fold != 0).groupBy("lang").count()
    langs = [r.lang for r in sizes.where(F.col("lang").isNotNull() & (F.col("lang") != ANY) & (F.col("count") >= MIN_TRUSTED)).orderBy("lang").collect()]
    own = F.when(F.col("lang").isin(langs), F.col("lang")).otherwise(F.lit(ANY)) if langs else F.lit(ANY)

    counts = settle(gram_counts(trusted.where(fold != 0).select(F.coalesce("lang", F.lit("")).alias("group"), "text"), UNITS), "gram-counts")
    if counts.isEmpty():
        none = [F.lit(ANY).alias("lang_model"), F.octet_length("text").cast("long").alias("n_bytes")]
        return rows.select("doc_id", "row", *none, *(F.lit(None).cast("double").alias(c) for c in ("perplexity", "threshold")), F.lit(True).alias("kept"))
    everything = counts.groupBy(F.lit(ANY).alias("group"), "gram").agg(F.sum("n").alias("n"))
    counts = settle(counts.where(F.col("group").isin(langs)).union(everything) if langs else everything, "gram-counts")
    model = store(estimate(counts, UNITS, modified=True), [ANY, *langs], UNITS)

    scored = settle(perplexities(rows.select("doc_id", "row", own.alias("group"), "text"), model), "perplexities")
    held = with_ids(scored.where(fold == 0), ids)
    pooled = perplexities(trusted.where(fold == 0).select("doc_id", "row", F.lit(ANY).alias("group"), "text"), model)
    held = held.where(F.col("group") != ANY).union(pooled).where("perplexity IS NOT NULL")
    entropy = F.log("perplexity") * F.col("n_units")
    average = settle(held.groupBy("group").agg((F.sum(entropy) / F.sum("n_units")).alias("average")), "averages")
    steady = (entropy + PRIOR_BYTES * F.col("average")) / (F.col("n_units") + PRIOR_BYTES)  # log perplexity
    held = held.join(F.broadcast(average), "group").withColumn("steady", steady)  # a row for each of few languages
    middle, high = (F.percentile_approx("steady", F.lit(q), F.lit(10_000)) for q in (0.5, QUANTILE))
    limit = F.exp(middle + SPREADS * F.greatest(high - middle, F.lit(LEAST_SPREAD)))
    limits = settle(held.groupBy("group").agg(limit.alias("threshold")), "thresholds")
    out = scored.join(F.broadcast(average), "group", "left").join(F.broadcast(limits), "group", "left")
    kept = F.coalesce(F.exp(steady) <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "row", F.col("group").alias("lang_model"), F.col("n_units").alias("n_bytes"), "perplexity", "threshold", kept.alias("kept"))


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Columns ``doc_id, lang_model, n_bytes, perplexity, threshold, kept``, one row per input row.

    ``labels`` (``doc_id, quality, toxic``) names the trusted documents; an id
    labelled both ways is not trusted, a null toxic label counts as not toxic.
    Documents whose language is null or has fewer than 50 trusted documents
    use the model of all languages (``*``). Null and empty texts have no
    perplexity and are kept, as are all documents when nothing is trusted.
    Repeated rows are judged each; rows without an id are never trusted. Only
    id, text and language are read from ``docs``.
    """
    return _judged(docs, labels, id_column, text_column, lang_column).drop("row")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, whole. Only the rejected ids meet the documents."""
    rejected = settle(_judged(docs, labels, "doc_id", "text", "lang").where("NOT kept").select("doc_id", "row").distinct(), "rejected")
    few = rejected.count() <= BROADCAST_IDS
    row = f"_row_{uuid.uuid4().hex[:8]}"
    d, r = docs.withColumn(row, F.xxhash64(F.coalesce("text", F.lit("")))).alias("d"), rejected.alias("r")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.col(f"d.{row}") == F.col("r.row"))
    return d.join(F.broadcast(r) if few else r.hint("merge"), same, "left_anti").drop(row)
