"""Near-duplicate detection with SimHash fingerprints, linked by pigeonring chains.

Two fingerprints are linked if at most ``LIMIT`` of their bits differ. Cut into ``SEGMENTS``
segments on a ring, linked ones have a segment from which every chain of l consecutive segments differs by at
most l * LIMIT / SEGMENTS bits (the pigeonring principle): 0, 1, 2 and 3 bits for 3 bits in 4 segments.

Each different fingerprint is one node. It is turned four times, so that each segment comes first once, and then:

1. Nodes with an equal first segment meet. The chains of two, three and four segments are checked, each a mask, an exclusive or and
   a bit count in the join condition; only links leave the join.
2. A node in a group of more than ``group`` nodes is *crowded* and does not meet its group. It goes on with longer chains: it asks for every first
   two segments that the budget of a chain of two allows, and meets the nodes that have them. Nodes still crowded there go on with
   three, then with all four segments, where no group has two nodes.

So crowded nodes meet those within reach only, no group larger than ``group`` is ever paired, and no link is lost: a pair of nodes that are not crowded
meets on the level that one of them has reached, any other pair when the crowded one has gone on.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlens.llm.common import did, prepare
from flightlens.llm.components import components
from flightlens.session import materialize

BITS, SEGMENTS, LIMIT = 64, 4, 3
WIDTH = BITS // SEGMENTS
BUDGETS = [LIMIT * chain // SEGMENTS for chain in range(SEGMENTS + 1)]
GROUP = 64
MAX_HOT = 1000
SEED = 42
BLOCK = 65_536


def signed(value: int) -> int:
    """The 64 bits of ``value`` as Spark's long."""
    return value - 2**BITS if value >= 2 ** (BITS - 1) else value


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bits set in over half of the hashes of ``size`` consecutive words, repeats included; zero without words.

    ``bytes.lower`` and ``bytes.split`` are those of ASCII: A-Z, and words ``[^\\x20\\x09-\\x0D]+``.
    """
    words = text.lower().split()
    if not words:
        return 0
    line, size = b" ".join(words), min(size, len(words))
    ends = list(itertools.accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(end + 1 for end in ends)]
    count, total = np.zeros(BITS, np.int64), len(words) - size + 1
    for k in range(0, total, BLOCK):
        last = min(k + BLOCK, total)
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[k:last], ends[k + size - 1 :], strict=False)), "<u8", last - k)
        count += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, size: int) -> Column:
    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(x or b"", size)) for x in texts], dtype="int64")

    return run(text.cast("binary"))


def mask(chain: int) -> int:
    return signed(2 ** (WIDTH * chain) - 1)


def turned(nodes: DataFrame) -> DataFrame:
    """(turn, ring) of each node, once per segment: ``ring`` is the fingerprint with that segment lowest."""
    turn = nodes.select("fp", F.explode(F.array(*map(F.lit, range(SEGMENTS)))).alias("turn"))
    rings = [F.shiftrightunsigned("fp", WIDTH * k).bitwiseOR(F.shiftleft("fp", BITS - WIDTH * k)) if k else F.col("fp") for k in range(SEGMENTS)]
    return turn.withColumn("ring", F.element_at(F.array(*rings), F.col("turn") + 1))


def crowded(rows: DataFrame, chain: int, group: int) -> DataFrame:
    """(turn, key) of the first ``chain`` segments that more than ``group`` of the nodes (turn, ring) have."""
    return rows.groupBy("turn", F.col("ring").bitwiseAND(F.lit(mask(chain))).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > group).select("turn", "key")


def flips(chain: int) -> list[tuple[int, int, int]]:
    """(bits used before, bits used then, mask) of all ways to change the last segment of a chain within its budget."""
    out = []
    for used in range(BUDGETS[chain - 1] + 1):
        for more in range(BUDGETS[chain] - used + 1):
            for bits in itertools.combinations(range(WIDTH * (chain - 1), WIDTH * chain), more):
                out.append((used, used + more, signed(sum(1 << b for b in bits))))
    return out


def within(chain: int) -> Column:
    """Do the rings x and y keep the budgets of all chains from ``chain`` segments on?"""
    apart = F.col("x").bitwiseXOR(F.col("y"))
    checks = [F.bit_count(apart.bitwiseAND(F.lit(mask(k)))) <= BUDGETS[k] for k in range(chain, SEGMENTS + 1)]
    out = checks[0]
    for check in checks[1:]:
        out &= check
    return out


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """(turn, x, y) of all linked pairs of the different fingerprints ``fp``, as rings; a pair may come several times."""
    spark = nodes.sparkSession
    base = materialize(turned(nodes).select("turn", "ring"), "turned")
    asking = base.select("turn", "ring", F.col("ring").alias("asked"), F.lit(0).alias("used"))
    found = None
    for chain in range(1, SEGMENTS + 1):
        first = F.lit(mask(chain))
        hot = materialize(crowded(base, chain, group), f"crowded-{chain}").withColumnRenamed("key", "own")
        if chain > 1:
            ways = spark.createDataFrame(flips(chain), "used int, then int, flip bigint")  # 17, 154 or 851 rows, fixed
            asking = asking.join(F.broadcast(ways), "used").select("turn", "ring", F.col("asked").bitwiseXOR(F.col("flip")).alias("asked"), F.col("then").alias("used"))
        marked = asking.withColumn("own", F.col("ring").bitwiseAND(first))
        calm = marked.join(hot, ["turn", "own"], "left_anti").select("turn", F.col("ring").alias("x"), F.col("asked").bitwiseAND(first).alias("key"))
        quiet = base.withColumn("key", F.col("ring").bitwiseAND(first)).join(hot.withColumnRenamed("own", "key"), ["turn", "key"], "left_anti")
        met = calm.join(quiet.select("turn", F.col("ring").alias("y"), "key"), ["turn", "key"])
        # Further on, the node that is met need not be asking itself.
        once = F.col("x") < F.col("y") if chain == 1 else F.col("x") != F.col("y")
        met = met.where(once & within(chain)).select("turn", "x", "y")
        found = met if found is None else found.unionByName(met)
        if chain == SEGMENTS or hot.isEmpty():
            return found
        asking = materialize(marked.join(hot, ["turn", "own"], "left_semi").select("turn", "ring", "asked", "used"), f"asking-{chain}")
        if chain == 1:
            base = asking.select("turn", "ring")
    return found


def node_of(ring: str) -> Column:
    """The fingerprint of a ring, as eight bytes."""
    back = [F.shiftleft(ring, WIDTH * k).bitwiseOR(F.shiftrightunsigned(ring, BITS - WIDTH * k)) if k else F.col(ring) for k in range(SEGMENTS)]
    return as_bytes(F.element_at(F.array(*back), F.col("turn") + 1))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def as_bytes(fp: Column) -> Column:
    return F.unhex(as_hex(fp))


def linked(docs: DataFrame, *, size: int = 3, group: int = GROUP, max_hot: int = MAX_HOT) -> DataFrame:
    """did, fingerprint, component (smallest did reachable) and kept of every row of ``docs``.

    Words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) text; hashes (XXH64) of ``size`` consecutive words, space-joined, or of
    all of them if there are fewer. Null, empty and blank texts have the fingerprint zero, which is linked like any other; so equal and similar
    texts always are. A null ``doc_id`` is larger than any other. Repeated rows each have their row, all of them ``kept`` if one
    is. Other columns of ``docs`` do not matter, whatever their names. An empty table gives an empty result.

    Fingerprints that make up over ``1 / max_hot`` of the rows are fewer than ``max_hot``: their components are broadcast to the
    rows; the rest is joined by fingerprint.
    """
    prepare(docs.sparkSession)
    rows = materialize(docs.select(did().alias("did"), fingerprints(F.col("text"), size).alias("fp")), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("did").alias("did"), F.count("*").alias("n")), "nodes")
    edges = links(nodes, group).select(node_of("x").alias("u"), node_of("y").alias("v"))
    roots = components(edges, "simhash")
    named = nodes.withColumn("node", as_bytes(F.col("fp"))).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named.select("fp", "did", "n", "root"), "rooted")
    smallest = named.groupBy("root").agg(F.min("did").alias("component"))
    named = materialize(named.join(smallest, "root").select("fp", "n", "component"), "named")

    most = (nodes.agg(F.sum("n")).first()[0] or 0) / max_hot
    hot, cold = (named.where(x).select("fp", "component") for x in (F.col("n") > most, F.col("n") <= most))
    near = rows.join(F.broadcast(hot), "fp")
    far = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp")
    out = near.unionByName(far).select("did", as_hex(F.col("fp")).alias("fingerprint"), "component")
    return out.withColumn("kept", F.col("did") == F.col("component"))
