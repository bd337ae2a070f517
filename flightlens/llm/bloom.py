"""Bloom filters over lists of hashes: what occurs, and what occurs more than once.

Every task fills two filters: *once* with the hashes it meets, *twice* with those it meets again.
They are cut into segments, and each segment is merged by itself: the merged *twice* also gets
the bits that two tasks have both set in *once*. So no repeated hash can be missed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlens.llm.common import prepare

MAX_FILTER_BITS = 2**30
SEGMENT_BITS = 2**20
PROBES = 4
SEGMENT = "segment int, once binary, twice binary"


def bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of each hash in a filter: one row per hash."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) % np.uint64(bits)).astype(np.int64)


def contains(bitmap: np.ndarray, where: np.ndarray) -> np.ndarray:
    return ((bitmap[where >> 3] >> (where & 7).astype(np.uint8)) & 1).all(axis=1)


def put(bitmap: np.ndarray, where: np.ndarray) -> None:
    where = np.unique(where)
    np.bitwise_or.at(bitmap, where >> 3, np.uint8(1) << (where & 7).astype(np.uint8))


def fill(bits: int):
    """Batches of ``hashes`` → (segment, once, twice) of this task."""

    def run(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes, count = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            where = bits_of(hashes, bits)
            again = (count > 1) | contains(once, where)
            put(twice, where[again])
            put(once, where)
        size = min(SEGMENT_BITS, bits) // 8
        for k in range(bits // 8 // size):
            part = slice(k * size, (k + 1) * size)
            if once[part].any():
                yield segment(k, once[part], twice[part])

    return run


def segment(k: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    packed = [zlib.compress(x.tobytes(), 1) for x in (once, twice)]
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["segment", "once", "twice"])


def merge(batches):
    """Folds the parts of each segment one by one: memory for the segments of this task only."""
    folded: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, *parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in parts)
            if k not in folded:
                folded[k] = [once.copy(), twice.copy()]
            else:
                folded[k][1] |= twice | (folded[k][0] & once)
                folded[k][0] |= once
    for k, (once, twice) in folded.items():
        yield segment(k, once, twice)


def filter_of(lists: DataFrame, expected: int, which: str, max_filter_bits: int = MAX_FILTER_BITS):
    """The merged *once* or *twice* filter of a table of lists of hashes, as a broadcast variable, and
    its length in bits: at least 16 for each expected hash, up to ``max_filter_bits``."""
    prepare(lists.sparkSession)
    bits = min(max(1 << (16 * max(expected, 1) - 1).bit_length(), SEGMENT_BITS), max_filter_bits)
    merged = lists.mapInArrow(fill(bits), SEGMENT).repartition(F.col("segment")).mapInArrow(merge, SEGMENT)
    size = min(SEGMENT_BITS, bits) // 8
    whole = np.zeros(bits // 8, np.uint8)
    for row in merged.select("segment", F.col(which).alias("part")).toLocalIterator():  # bits / 8 bytes in all
        whole[row.segment * size : (row.segment + 1) * size] = np.frombuffer(zlib.decompress(row.part), np.uint8)
    return lists.sparkSession.sparkContext.broadcast(whole.tobytes()), bits


def passes(bitmap, bits: int):
    """Column function: does any hash of the list pass the broadcast filter?"""

    @F.pandas_udf(T.BooleanType())
    def run(lists: pd.Series) -> pd.Series:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flags = np.zeros(len(lists), bool)
        if sizes.sum():
            found = contains(np.frombuffer(bitmap.value, np.uint8), bits_of(np.concatenate(lists.to_list()).astype(np.int64), bits))
            flags[np.repeat(np.arange(len(lists)), sizes)[found]] = True
        return pd.Series(flags)

    return run
