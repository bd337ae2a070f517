"""Language identification as a mixture of languages in each document.

Learning counts hashed character trigrams by language over all labelled documents; each
task adds its documents up first. A document's trigrams are then taken as drawn from a
mixture of the languages; expectation-maximisation gives the proportions. Languages are
taken up in falling order of their proportion as long as the penalised likelihood
(log-likelihood minus half of log n for each further language) grows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlens.llm.common import free_name, prepare

BUCKETS = 2**15
GAIN = 0.01  # of the log-likelihood in a round: a fit that gains less has settled
UNKNOWN = "und"
MIXTURE = T.StructType().add("lang_pred", "string").add("score", "double").add("languages", T.ArrayType(T.StringType())).add("proportions", T.ArrayType(T.DoubleType()))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of a lower-cased text with a space at both ends."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(49)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def count_trigrams(batches):
    """(lang, text) → (lang, bucket, n) of this task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if has_letter(text):
                into = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                into += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, into in counts.items():
        (at,) = into.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(into[at], pa.int64())], names=["lang", "bucket", "n"])


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the smoothed probability of each bucket in each: a model of
    fixed size per language, from all rows whose text and language are not null."""
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(lang, text)
    found = rows.mapInArrow(count_trigrams, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    table = np.full((len(names), BUCKETS), 0.5)
    if names:
        index = {x: i for i, x in enumerate(names)}
        table[[index[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return names, table / table.sum(axis=1, keepdims=True)


def fit(likelihood: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``likelihood`` (trigram × language) and the log-likelihood, iterated until a round
    gains less than ``GAIN``. No round lowers it, so this ends."""
    share = np.full(likelihood.shape[1], 1.0 / likelihood.shape[1])
    total = likelihood @ share
    value = float(times @ np.log(total))
    while len(share) > 1:
        share = share * ((times / total) @ likelihood) / times.sum()
        total = likelihood @ share
        value, before = float(times @ np.log(total)), value
        if value - before < GAIN:
            break
    return share, value


def mixture(text: str | None, names: list[str], table: np.ndarray):
    """(best language, its proportion, selected languages, their proportions)."""
    if not names or not has_letter(text):
        return UNKNOWN, 0.0, [], []
    counts = np.bincount(trigrams(text), minlength=BUCKETS)
    (at,) = counts.nonzero()
    times, likelihood = counts[at].astype(float), table[:, at].T
    share, _ = fit(likelihood, times)
    order = np.argsort(-share, kind="stable")
    penalty = 0.5 * np.log(times.sum())
    chosen, (best, value) = order[:1], fit(likelihood[:, order[:1]], times)
    for size in range(2, len(order) + 1):
        more, gained = fit(likelihood[:, order[:size]], times)
        if gained - penalty * (size - 1) <= value:
            break
        chosen, best, value = order[:size], more, gained - penalty * (size - 1)
    top = int(np.argmax(best))
    return names[chosen[top]], min(max(float(best[top]), 0.0), 1.0), [names[i] for i in chosen], best.tolist()


def identified(text: Column, names: list[str], shared) -> Column:
    @F.pandas_udf(MIXTURE)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mixture(x, names, shared.value) for x in texts], columns=MIXTURE.names)

    return run(text)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text") -> DataFrame:
    """``docs`` with ``mixture``: lang_pred, score (the proportion of lang_pred), languages, proportions.

    ``und`` with score 0 for a null text, one without a letter, or a model without languages.
    Only the text is read. Equal proportions go to the language of the smaller name. Repeated rows get the same result, an empty table
    gives an empty one. An existing column ``mixture`` keeps its name and the new one is numbered. ``score`` is 1 where one language is chosen: it says
    how much of the text is in ``lang_pred``, not how sure that is.
    """
    prepare(docs.sparkSession)
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return docs.withColumn(free_name(docs, "mixture"), identified(F.col(text), names, shared))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))
