"""Line deduplication with two Bloom filters.

1. Every task fills two filters from the hashes of its documents' lines: *once* with the
   hashes it meets, *twice* with those it meets again. A document counts a line one time.
2. The filters are cut into segments and merged segment by segment: the merged *twice* also
   gets the bits that two tasks have both set in *once*. No repeated line can be missed.
3. Only lines that pass the merged *twice* filter leave their task. They are grouped by the
   whole key, which removes false alarms, and the smallest document keeps the line.
4. Documents that lose a line are told by another such filter, of their identifiers and texts' hashes. All others are passed
   through: in the last reads no line is looked at but theirs.

The filters have at least 16 bits a line and at most ``max_filter_bits`` (128 MiB each in a
task's memory). Past that, more lines are suspected and shuffled; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlens.llm.bloom import MAX_FILTER_BITS, bits_of, contains, filter_of, passes
from flightlens.llm.common import LOWER, UPPER, WHITE, did, free_name, lower_ascii, prepare, quoted, sig, text_of, without
from flightlens.session import materialize


def n_lines(text: Column) -> Column:
    return F.length(text) - F.length(without(text, "\n")) + F.lit(1)


def keys_of(text: Column, min_chars: int) -> Column:
    """A document's different keys of at least ``min_chars`` code points."""
    lines = F.transform(F.split(lower_ascii(text), "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) >= min_chars))


def suspect_lines(twice, bits: int):
    """(did, sig, keys, hashes) → a row for each key that passes the filter."""

    def run(batches):
        for batch in batches:
            lists = batch.column("hashes")
            found = contains(np.frombuffer(twice.value, np.uint8), bits_of(lists.flatten().to_numpy(zero_copy_only=False), bits))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            row = pa.array(row[found])
            keys = batch.column("keys").flatten().filter(pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column("did").take(row), batch.column("sig").take(row), keys], names=["did", "sig", "key"])

    return run


FOLD = str.maketrans(UPPER, LOWER)


@F.pandas_udf(T.StructType().add("text", "string").add("dropped", "long"))
def without_lines(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    """Texts without the lines whose key is among ``dropped``."""
    out = []
    for text, keys in zip(texts, dropped, strict=True):
        gone, lines = set(keys), text.split("\n")
        kept = [x for x in lines if x.strip(WHITE).translate(FOLD) not in gone]
        out.append(("\n".join(kept), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "dropped"])


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and two columns more: ``n_lines``
    (before) and ``n_dropped``.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at
    least ``min_chars`` code points found in two or more documents stay in the document of
    the smallest ``doc_id`` only. A null text is one empty line and stays null; a null
    ``doc_id`` is larger than any other; rows with the same ``doc_id`` are one document.
    An empty table gives an empty result. Columns of the same names are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = text_of()
    flag, d, s, lost = (free_name(docs, x) for x in ("hashes", "did", "sig", "lost"))
    lines = docs.select(F.sum(n_lines(text)).alias("n")).first().n or 0
    keyed = docs.select(did().alias("did"), sig().alias("sig"), keys_of(text, min_chars).alias("keys"))
    keyed = keyed.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    twice, bits = filter_of(keyed.select("hashes"), lines, "twice", max_filter_bits)

    found = materialize(keyed.mapInArrow(suspect_lines(twice, bits), "did bigint, sig bigint, key string"), "lines")
    ends = found.groupBy("key").agg(F.min("did").alias("first"), F.max("did").alias("last"))
    repeated = materialize(ends.where("first < last").select("key", "first"), "repeated")
    gone = found.join(repeated, "key").where(F.col("did") > F.col("first"))
    gone = gone.groupBy(F.col("did").alias(d), F.col("sig").alias(s)).agg(F.collect_set("key").alias(lost))

    place = F.array(F.xxhash64(d, s))
    gone = materialize(gone, "gone")
    losing, width = filter_of(gone.select(place.alias("hashes")), gone.count(), "once")
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    marked = docs.withColumns({d: did(), s: sig()})
    marked = marked.withColumn(flag, passes(losing, width)(place))
    whole = marked.where(~F.col(flag)).select(*quoted(kept), n_lines(text).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    part = marked.where(F.col(flag)).join(gone, [d, s], "left")
    part = part.withColumn(lost, without_lines(text, F.coalesce(F.col(lost), F.array().cast("array<string>"))))
    changed = F.when(F.col(lost)["dropped"] > 0, F.col(lost)["text"]).otherwise(F.col("text"))
    part = part.select(
        *(changed.alias(c) if c == "text" else quoted([c])[0] for c in kept),
        n_lines(text).cast("long").alias("n_lines"),
        F.col(lost)["dropped"].alias("n_dropped"),
    )
    return whole.unionByName(part)
