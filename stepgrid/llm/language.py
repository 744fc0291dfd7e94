"""Language identification by character models.

One interpolated Kneser-Ney model of letters for each language is counted over
all its training texts and stored in sorted hash arrays. A text gets the
language under which its cross-entropy per letter is lowest. It is marked as
rejected when even that lies above what nearly all texts of the language stay
below. Those are texts of a fold that the models are not counted from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.llm.ngrams import SCORE_BYTES, Model, Units, estimate, gram_counts, letters_of, log_probabilities, store
from stepgrid.llm.textbytes import own_worker, slices
from stepgrid.session import settle

UNITS = Units(letters_of, bits=16, order=4, alphabet=1 << 16)
UNKNOWN = "und"
MOST_LANGUAGES = 4096  # names of languages go to the driver; more than this is not a language column
SHARPNESS = 24.0  # letters' worth of evidence in the score
REJECT = 0.99  # quantile of cross-entropy from which a text is rejected, over learnable texts left out of the models
FOLD = 5  # every fifth distinct text is left out for that
LEAST = 99  # texts of a language without which that quantile says nothing of others


def train(docs: DataFrame) -> Model | None:
    """A model of each language over all rows ``lang, text``; none without a language."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").alias("group"), "text")
    counts = settle(gram_counts(rows, UNITS), "gram-counts")
    langs = [r.group for r in counts.select("group").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return store(estimate(counts, UNITS, modified=False), sorted(langs), UNITS) if langs else None


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a ``text``) and ``lang_pred, score, entropy``, the text left out."""
    langs = sorted(model.groups)
    own = [c for c in docs.columns if c != "text"]
    fields = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("models")
        for batch in slices(batches, size=SCORE_BYTES):
            grams, at = model.units.grams(batch.column("text"))
            letter = (grams & np.uint64(0xFFFF)) != 0x20
            n = np.add.reduceat(np.append(letter, False), at[:-1]) * (np.diff(at) > 0)
            kinds, back = np.unique(grams, return_inverse=True)
            entropy = np.zeros((batch.num_rows, len(langs)))
            for k, lang in enumerate(langs):
                running = np.concatenate([[0.0], np.cumsum(log_probabilities(model, kinds, lang)[back])])
                entropy[:, k] = -(running[at[1:]] - running[at[:-1]]) / np.maximum(np.diff(at), 1)
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(len(best)), best]
            weight = np.exp(-(entropy - least[:, None]) * np.minimum(np.maximum(n, 1), SHARPNESS)[:, None])
            known = n > 0
            names = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            columns = [batch.column(c) for c in own]
            columns += [pa.array(names, pa.string()), pa.array(np.where(known, 1 / weight.sum(axis=1), 0.0)), pa.array(least, mask=~known)]
            yield pa.RecordBatch.from_arrays(columns, [*own, "lang_pred", "score", "entropy"])

    schema = docs.select(*[F.col(f.name) for f in fields]).withColumns(
        {"lang_pred": F.lit(""), "score": F.lit(0.0), "entropy": F.lit(None).cast("double")}
    ).schema
    return docs.select(*own, "text").mapInArrow(run, schema)


def identify(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Columns ``doc_id, held_out, lang_pred, score, entropy, rejected``, one row per input row.

    Models are learned from text and language of the rows that ``held_out``
    leaves; only the text enters a prediction. Texts that are null or have no
    letter get ``und`` with score 0, as does everything when nothing can be
    learned; rows without a language are predicted, not learned from. Of the
    learnable texts every ``FOLD``-th, by its hash, is left out of the models
    and sets the limit of its language; a language with fewer than ``LEAST`` of
    them rejects nothing. A row whose ``held_out`` is null is held out. Equal entropies go to the language
    first in order. Repeated rows get equal predictions. Other columns are not
    read.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
        F.col(lang_column).cast("string").alias("lang"),
        F.col(text_column).alias("text"),
    )
    left_out = F.pmod(F.xxhash64("text"), F.lit(FOLD)) == 0
    model = train(rows.where(~F.col("held_out") & ~left_out))
    if model is None:  # so few texts that all were left out
        model = train(rows.where("NOT held_out"))
    if model is None:
        nothing = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected")]
        return rows.select("doc_id", "held_out", *nothing)
    found = settle(scored(rows.withColumn("left_out", F.coalesce(left_out, F.lit(False))), model), "languages")
    learned = found.where("NOT held_out AND left_out AND lang = lang_pred")
    limit = F.when(F.count("entropy") >= LEAST, F.percentile_approx("entropy", F.lit(REJECT), F.lit(10_000)))
    limits = settle(learned.groupBy("lang_pred").agg(limit.alias("limit")), "limits")
    out = found.join(F.broadcast(limits), "lang_pred", "left")  # a row for each of few languages
    rejected = F.coalesce(F.col("entropy") > F.col("limit"), F.col("lang_pred") == UNKNOWN)
    return out.select("doc_id", "held_out", "lang_pred", "score", "entropy", rejected.alias("rejected"))
