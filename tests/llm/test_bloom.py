"""Filters: nothing that occurs, or occurs twice, is missed, however the rows are dealt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlens.llm.bloom import bits_of, contains, filter_of


@pytest.mark.parametrize("tasks", [1, 5])
def test_no_hash_is_missed(spark, rows, tasks):
    draw = random.Random(1)
    lists = [sorted(draw.sample(range(3000), draw.randint(0, 40))) for _ in range(80)]
    df = rows("x array<bigint>", *[(x,) for x in lists]).repartition(tasks).select(F.transform("x", lambda v: F.xxhash64(v)).alias("hashes"))
    counts = {r.h: r["count"] for r in df.select(F.explode("hashes").alias("h")).groupBy("h").count().collect()}
    hashes = np.array(list(counts), np.int64)
    twice = np.array([c > 1 for c in counts.values()])
    for which, must in (("once", np.ones(len(hashes), bool)), ("twice", twice)):
        shared, bits = filter_of(df, len(hashes), which)
        found = contains(np.frombuffer(shared.value, np.uint8), bits_of(hashes, bits))
        assert found[must].all()
        assert found[~must].mean() < 0.05 if (~must).any() else True
        others = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
        assert contains(np.frombuffer(shared.value, np.uint8), bits_of(others, bits)).mean() < 0.01


def test_empty_table(spark, rows):
    shared, bits = filter_of(rows("hashes array<bigint>"), 0, "twice")
    assert bits == 2**20 and not any(shared.value)
