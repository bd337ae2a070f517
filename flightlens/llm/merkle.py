"""A Merkle manifest of a table: a tree of digests per group, one over the groups, and a proof for every row.

1. Every row becomes a leaf, the SHA-256 of some of its columns. Leaves are range-sorted by group and
   order over many tasks; a leaf's rank in its group is its place in its task plus the sizes of the
   tasks before (a small table, cumulated per group).
2. A rank is written in digits to the base ``fanout``. ``digits`` of them make up a block of at most
   ``fanout ** digits`` leaves, which is shuffled together once. There, the digit columns are grouped away
   one after the other, the lowest first: the children of a node become an array of structs inside its struct.
3. The blocks' digests are the leaves of the next storey of blocks, until one digest per group is left.
   The groups' digests get the same treatment, as one group.
4. On the way back each block unfolds by nested ``transform`` and one ``explode``: every leaf meets its
   siblings inside its block's struct, without a join. Only a block's own proof comes by a join,
   one row per block.

Nothing is larger than a block, whatever the size of a group. DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlens.session import materialize

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


class Shape(NamedTuple):
    """Children of a node, and levels of a block."""

    fanout: int = 2
    digits: int = 10

    @property
    def block(self) -> int:
        return self.fanout**self.digits


def sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def leaf_of(columns: list[Column]) -> Column:
    """Digest of the values one after the other: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return sha(F.concat(*map(field, columns)))


def ranked(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """``leaves`` (part, ...) with ``rank`` in its part from 0 on, and the part's size ``n``.

    Null parts are a part of their own, and nulls come first. Rows equal in ``order`` come in any order, but in the
    same one to every reader: the sorted rows are written with their places.
    """
    # ``monotonically_increasing_id`` is task * 2^33 + row.
    places = leaves.repartitionByRange("part", *order).sortWithinPartitions("part", *order).withColumn("place", F.monotonically_increasing_id())
    places = materialize(places, f"{name}-sorted").withColumn("task", F.shiftright("place", 33))
    whole = Window.partitionBy("part")
    before = F.sum("size").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = places.groupBy("part", "task").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    tasks = tasks.select(F.col("part").alias("its"), F.col("task").alias("at"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    met = places.join(materialize(tasks, f"{name}-tasks"), F.col("part").eqNullSafe(F.col("its")) & (F.col("task") == F.col("at")))
    return met.withColumn("rank", F.col("place") + F.col("shift")).drop("its", "at", "task", "place", "shift")


def nested(leaves: DataFrame, shape: Shape) -> DataFrame:
    """(part, n, rank, node) → (part, n, block, node): the struct of nested structs of each block of ranks.

    ``node`` is a struct with the digest ``h``; the block's has ``h`` and ``kids``. A level on which a part has one node only hands it on.
    """
    names = [f"digit_{k}" for k in range(shape.digits)]
    digit = {name: F.expr(f"rank div {shape.fanout**k}L % {shape.fanout}") for k, name in enumerate(names)}
    df = leaves.withColumns({"block": F.expr(f"rank div {shape.block}L"), **digit}).repartition("part", "block")
    for k, name in enumerate(names):
        kids = F.sort_array(F.collect_list(F.struct(name, "node")))
        df = df.groupBy("part", "block", "n", *names[k + 1 :]).agg(F.transform(kids, lambda x: x["node"]).alias("kids"))
        h = F.when(F.col("n") > shape.fanout**k, sha(joined(F.col("kids.h")))).otherwise(F.col("kids")[0]["h"])
        df = df.withColumn("node", F.struct(h.alias("h"), "kids")).drop("kids")
    return df.select("part", "n", "block", "node")


def unfolded(blocks: DataFrame, shape: Shape) -> DataFrame:
    """Blocks (..., n, node, path) → a row for each leaf: (..., n, leaf, path), its path from itself to the root."""

    def walk(node: Column, path: Column, level: int) -> Column:
        if level == 0:
            return F.array(F.struct(node.alias("leaf"), path.alias("path")))
        digests = F.transform(node["kids"], lambda x: x["h"])

        def below(kid: Column, at: Column) -> Column:
            step = F.struct(joined(F.slice(digests, F.lit(1), at)).alias("left"), joined(F.slice(digests, at + 2, F.size(digests))).alias("right"))
            steps = F.when(F.col("n") > shape.fanout ** (level - 1), F.array(step)).otherwise(F.array().cast(STEPS))
            return walk(kid, F.concat(steps, path), level - 1)

        return F.flatten(F.transform(node["kids"], below))

    every = blocks.withColumn("found", F.explode(walk(F.col("node"), F.col("path"), shape.digits)))
    return every.select(*(c for c in blocks.columns if c not in ("node", "path", "block")), "found.leaf", "found.path")


def climb(leaves: DataFrame, shape: Shape, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Leaves (part, n, rank, node) → the storeys of blocks, and (part, h): the last digest of each part."""
    storeys, largest = [], leaves.agg(F.max("n")).first()[0] or 1
    while True:
        storeys.append(materialize(nested(leaves, shape), f"{name}-{len(storeys)}"))
        if largest <= shape.block:
            return storeys, storeys[-1].select("part", "node.h")
        largest = -(-largest // shape.block)
        nodes = F.struct("node.h", "block")
        leaves = storeys[-1].select("part", F.expr(f"(n + {shape.block - 1}) div {shape.block}L").alias("n"), F.col("block").alias("rank"), nodes.alias("node"))


def descend(storeys: list[DataFrame], above: DataFrame, shape: Shape, name: str) -> DataFrame:
    """Storeys and the parts' own paths (part, path, ...) → (part, n, leaf, path, ...) of every leaf."""
    above = above.withColumn("at", F.lit(0).cast("long"))
    for k, blocks in reversed(list(enumerate(storeys))):
        met = above.withColumnRenamed("part", "its")
        met = blocks.join(met, F.col("part").eqNullSafe(F.col("its")) & (F.col("block") == F.col("at"))).drop("its", "at")
        found = unfolded(met, shape)
        if k:
            above = materialize(found.withColumn("at", F.col("leaf.block")).drop("n", "leaf"), f"{name}-above-{k}")
    return found


def manifest(
    docs: DataFrame,
    *,
    columns: tuple[str, ...] = LEAF_COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    seen: dict[str, Column] | None = None,
    shape: Shape = Shape(),
) -> DataFrame:
    """``order`` column, group, leaf, subroot, root, path, proof_sha256, folded_root and verified of every row of ``docs``.

    A leaf is the digest of ``columns`` (see ``leaf_of``). In each group leaves ascend by ``order``; every ``fanout`` consecutive nodes
    become the digest of their digests, the last ones even if there is one only, until one is left: the subroot (a lone leaf itself). The
    subroots, by group in UTF-8 order, become the root alike. ``path``: what stands left and right of
    a node on each level, from the leaf to the root; ``proof_sha256``: the digest of all of it. ``seen`` replaces columns by what a reader
    finds now: ``folded_root`` is the leaf of that, folded with the path, and ``verified`` says whether it is the root.

    Nulls: a null value has a mark of its own in the leaf, a null group is a group and comes first, a null ``order`` comes first. Rows of equal
    order are sorted by their leaves; equal rows have leaves of their own. An empty text is a value of length 0; an empty table gives an empty
    result. Columns of ``docs`` that are not named do not matter, whatever their names. A row is one value, so a text must fit in a task's memory.
    """
    spark_columns = [F.col(f"`{c}`") for c in columns]
    found = [(seen or {}).get(c, F.col(f"`{c}`")) for c in columns]
    leaf = leaf_of(spark_columns)
    changed = F.when(leaf != leaf_of(found), leaf_of(found)) if seen else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{group}`").alias("part"), F.col(f"`{order}`").alias("key"), leaf.alias("h"), changed.alias("changed"))
    rows = materialize(rows, "leaves")
    leaves = ranked(rows, ["key", "h"], "leaves").select("part", "n", "rank", F.struct("h", "key", "changed").alias("node"))
    storeys, subroots = climb(leaves, shape, "blocks")

    small = shape._replace(digits=min(shape.digits, 6))
    groups = subroots.select(F.lit(0).alias("part"), F.col("part").alias("key"), "h")
    groups = ranked(groups, ["key"], "groups").select("part", "n", "rank", F.struct("h", "key").alias("node"))
    tops, root = climb(groups, small, "groups")
    above = root.select("part", F.array().cast(STEPS).alias("path"), F.col("h").alias("root"))
    above = descend(tops, above, small, "groups")
    above = materialize(above.select(F.col("leaf.key").alias("part"), "path", F.col("leaf.h").alias("subroot"), "root"), "subroots")

    out = descend(storeys, above, shape, "blocks")
    proof = F.transform("path", lambda x: F.concat(x["left"], x["right"]))
    start = F.coalesce("leaf.changed", "leaf.h")
    folded = F.aggregate("path", start, lambda acc, x: sha(F.concat(x["left"], acc, x["right"])))
    out = out.select(F.col("leaf.key").alias(order), F.col("part").alias(group), F.col("leaf.h").alias("leaf"), "subroot", "root", "path", sha(joined(proof)).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def one_more(column: str) -> Column:
    """The whole number of ``column`` plus one, in decimal digits; null stays null."""
    return (F.col(f"`{column}`").cast("decimal(38,0)") + 1).cast("string")
