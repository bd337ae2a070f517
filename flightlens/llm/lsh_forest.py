"""Near-duplicate detection with an LSH forest over MinHash signatures.

1. A text's set is its distinct shingles of consecutive words, as 64-bit hashes. Texts of equal sets
   (128-bit digest and size) become one node at once, however many they are.
2. A node's signature has ``TREES`` x ``DEPTH`` minimum hashes and some more. Each tree sorts the nodes
   by the signature read from another place on; its first ``DEPTH`` hashes name a region.
   Regions of one node are dropped.
3. Candidates are neighbours in a tree's order inside a region. A region of up to ``WINDOW`` nodes
   gives all its pairs. In a denser one the order goes on to deeper hashes, so that the
   next ``WINDOW`` nodes are those with the longest common prefix: depth adapts to density.
   Large regions are sorted by range over many tasks, and each node keeps its best few there:
   these only start the components, step 6 compares the rest.
4. Candidates far below the limit by their signatures are dropped. The best of each node
   are confirmed on the full sets first; then, between components that are still apart,
   all the others are confirmed.
5. A node with few partners inside a dense cluster may have met none of them. So the nodes
   that share a dense region with a large component, but do not belong to it, are compared
   with all its members, in tiles of bounded size; only confirmed links leave a tile.
6. The nodes of each dense region outside its large component are then compared with each
   other, whatever component they are in: all pairs of different components, in tiles too.

At a similarity of 0.8, two sets share no region of any tree with a probability of 3.2e-6, and their
signatures differ by more than ``SLACK`` with one of 1.8e-7: 3.4e-6 of such pairs are missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlens.llm.bloom import filter_of, passes
from flightlens.llm.common import WHITE, did, keyed, lower_ascii, prepare, quoted, sig, text_of, without, words_of
from flightlens.llm.components import components
from flightlens.session import materialize

TREES, DEPTH, HASHES = 24, 4, 128
ORDER = 16
WINDOW = 16
BEST = 2
FIRST = 3
SLACK = 0.2
BLOCK = 4096
TILE = 500
SIGNED = "did bigint, sig bigint, n_shingles bigint, node binary, regions array<bigint>, small binary"

rng = np.random.default_rng(20_240_501)
FACTORS = rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
OFFSETS = rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words (64-bit hashes); of all, if there are fewer."""
    w = words.view(np.uint64)
    if len(w) == 0:
        return w
    if len(w) < size:
        value = np.array([len(w)], np.uint64)
        for k in range(len(w)):
            value = mix(value * np.uint64(31) + w[k : k + 1])
        return value
    value = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        value = mix(value) + w[k : len(w) - size + 1 + k]
    return np.unique(mix(value))


def minimum_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), BLOCK):
        part = shingles[k : k + BLOCK]
        np.minimum(out, (FACTORS[:, None] * part + OFFSETS[:, None]).min(axis=1), out=out)
    return mix(out)


def digest(shingles: np.ndarray) -> bytes:
    """Of a sorted set: its size and two sums of differently mixed hashes."""
    one, two = mix(shingles).sum(dtype=np.uint64), mix(shingles * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)).sum(dtype=np.uint64)
    return np.array([one, two, len(shingles)], ">u8").tobytes()


def sign(size: int):
    """(did, sig, list of word hashes) → ``SIGNED``; a set without shingles has no regions."""

    def run(batches):
        for batch in batches:
            lists, counts, nodes, regions, small = batch.column(2), [], [], [], []
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for end, begin in zip(ends, np.concatenate([[0], ends[:-1]]), strict=True):
                shingles = shingle_hashes(values[begin:end], size)
                counts.append(len(shingles))
                nodes.append(digest(shingles))
                if len(shingles):
                    least = minimum_hashes(shingles)
                    value = np.arange(TREES, dtype=np.uint64)
                    for k in range(DEPTH):
                        value = mix(value * np.uint64(31) + least[np.arange(TREES) * DEPTH + k])
                    regions.append(value.view(np.int64))
                    small.append(least.astype(np.uint8).tobytes())
                else:
                    regions.append(np.zeros(0, np.int64))
                    small.append(b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(regions, pa.list_(pa.int64())), pa.array(small, pa.binary())],
                names=["did", "sig", "n_shingles", "node", "regions", "small"],
            )

    return run


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(lower_ascii(text)), lambda w: F.xxhash64(w))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of signatures cut to a byte per hash; equal by chance in one of 256."""
    return ((a == b).mean(axis=-1) - 1 / 256) * 256 / 255


def neighbours(least: float, best: int | None):
    """Rows (region, node, small) in the order of a tree → (a, b, est) of a node and the next ``WINDOW`` in its region.

    ``best``: keep so many per node. The last rows of a batch are carried to the next.
    """

    def pairs(region, node, small, fresh):
        found = []
        for step in range(1, min(WINDOW, len(region) - 1) + 1):
            (at,) = (region[:-step] == region[step:]).nonzero()
            at = at[at + step >= fresh]
            if len(at):
                est = estimate(small[at], small[at + step])
                close = est >= least
                found += [(at[close], at[close] + step, est[close])]
        if not found:
            return None
        a, b, est = (np.concatenate(x) for x in zip(*found, strict=True))
        if best is not None:
            order = np.lexsort((-est, a))
            run = np.arange(len(order)) - np.searchsorted(a[order], a[order])
            a, b, est = (x[order[run < best]] for x in (a, b, est))
        return pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b)), pa.array(est)], names=["a", "b", "est"])

    def run(batches):
        held = None
        for batch in batches:
            fresh = held.num_rows if held is not None else 0
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            small = np.frombuffer(b"".join(batch.column("small").to_pylist()), np.uint8).reshape(batch.num_rows, HASHES)
            got = pairs(batch.column("region").to_numpy(), batch.column("node"), small, fresh)
            if got is not None and got.num_rows:
                yield got
            held = batch.slice(max(batch.num_rows - WINDOW, 0))

    return run


PAIR = "a binary, b binary, est double"


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("est").alias("est"))


def forest(nodes: DataFrame) -> DataFrame:
    """(region, tree, node, n) of regions with two nodes or more; n: nodes in the region."""
    leaves = nodes.select("node", F.posexplode("regions").alias("tree", "region"))
    shared = materialize(leaves.groupBy("region").agg(F.count("*").alias("n")).where("n > 1"), "regions")
    return materialize(leaves.join(shared.hint("merge"), "region"), "leaves")


def candidates(leaves: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, est): neighbours in the trees' orders, each pair once."""
    rows = leaves.join(nodes.select("node", "small"), "node")
    few = rows.where(F.col("n") <= WINDOW + 1).select("region", "node", "small")
    few = few.repartition(F.col("region")).sortWithinPartitions("region").mapInArrow(neighbours(least, None), PAIR)
    at = (F.col("tree") + 1) * DEPTH
    deeper = F.substring(F.concat("small", "small"), at + 1, F.lit(ORDER))
    many = rows.where(F.col("n") > WINDOW + 1).select("region", "node", "small", deeper.alias("order"))
    many = materialize(many, "dense")
    many = many.repartitionByRange("region", "order", "node").sortWithinPartitions("region", "order", "node")
    many = many.select("region", "node", "small").mapInArrow(neighbours(least, BEST), PAIR)
    return ordered(few.unionByName(many))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) reach the similarity."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return met.where(similar("x", "y", percent)).select("a", "b")


def similar(x: str, y: str, percent: int) -> Column:
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= percent * (F.size(x) + F.size(y) - both)


def best_of_each(pairs: DataFrame, count: int) -> DataFrame:
    """The pairs (a, b) that are among the ``count`` best of a or of b."""
    both = pairs.select("a", "b", "est").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "est"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("est"), "b")))
    return ordered(ranked.where(F.col("rank") <= count))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, ra, rb): the pairs whose nodes have different roots; a node without one is its own."""
    for side, root in (("a", "ra"), ("b", "rb")):
        known = roots.select(F.col("node").alias(side), F.col("root").alias(root))
        pairs = pairs.join(known, side, "left").withColumn(root, F.coalesce(root, side))
    return pairs.where("ra != rb")


def merge(roots: DataFrame, bridges: DataFrame, name: str) -> DataFrame:
    """(node, root) after joining the components of the rows (u, v) of ``bridges``, which are roots."""
    bridges = materialize(bridges, f"{name}-bridges")
    if bridges.isEmpty():
        return roots
    over = components(bridges, name).select(F.col("node").alias("root"), F.col("root").alias("over"))
    alone = over.select(F.col("root").alias("node")).join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    every = roots.unionByName(alone).join(over, "root", "left")
    return materialize(every.select("node", F.coalesce("over", "root").alias("root")), f"{name}-roots")


def strays(leaves: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core, node) of the members of large components, and of the other nodes that share a dense region with them;
    (region, tree, node) of all nodes of dense regions that are outside the region's core.

    A component of over ``WINDOW`` nodes is the core of the dense regions where it has most
    nodes, if there are over ``WINDOW`` of them. Other dense regions have none.
    """
    large = materialize(roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > WINDOW).select("root"), "large")
    members = roots.join(large, "root").select(F.col("root").alias("core"), "node")
    dense = leaves.where(F.col("n") > WINDOW + 1).select("region", "tree", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    dense = materialize(dense, "dense-roots")
    share = dense.groupBy("region", "root").agg(F.count("*").alias("n"))
    core = share.groupBy("region").agg(F.max(F.struct("n", "root")).alias("top")).where(F.col("top.n") > WINDOW)
    core = materialize(core.select("region", F.col("top.root").alias("core")), "cores")
    outside = dense.join(core, "region", "left").where("core IS NULL OR root != core")
    return members, outside.where("core IS NOT NULL").select("core", "node").distinct(), outside.select("region", "tree", "node")


def tiled(members: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``m`` and ``o``: each member meets each other node of its core in one tile of at most about ``TILE`` x ``TILE``."""
    count = members.groupBy("core").agg(F.count("*").alias("nm")).join(others.groupBy("core").agg(F.count("*").alias("no")), "core")
    count = materialize(count.select("core", F.ceil(F.col("nm") / TILE).alias("nm"), F.ceil(F.col("no") / TILE).alias("no")), "tiles")
    place = F.xxhash64("node")
    left = members.join(count, "core").select("core", "node", F.pmod(place, "nm").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("no") - 1)).alias("o"))
    right = others.join(count, "core").select("core", "node", F.pmod(place, "no").alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1)).alias("m"))
    return left, right


def links_to_core(least: float, percent: int):
    """Tiles of members and other nodes → (u, core) of the others that are linked to a member."""

    def run(members: pa.Table, others: pa.Table) -> pa.Table:
        small = [np.frombuffer(b"".join(t.column("small").to_pylist()), np.uint8).reshape(t.num_rows, HASHES) for t in (members, others)]
        sets = [np.asarray(x) for x in members.column("shingles").to_pylist()] if others.num_rows else []
        found = []
        for k, (node, shingles) in enumerate(zip(others.column("node").to_pylist(), others.column("shingles").to_pylist(), strict=True)):
            est = estimate(small[0], small[1][k]) if members.num_rows else np.zeros(0)
            for j in np.argsort(-est)[: int((est >= least).sum())]:
                both = len(np.intersect1d(sets[j], shingles, assume_unique=True))
                if 100 * both >= percent * (len(sets[j]) + len(shingles) - both):
                    found.append(node)
                    break
        core = members.column("core")[0].as_py() if found else None
        return pa.table({"u": pa.array(found, pa.binary()), "v": pa.array([core] * len(found), pa.binary())})

    return run


def paired(outside: DataFrame, roots: DataFrame) -> DataFrame:
    """``outside`` with root, block, i and j: any two nodes of a region with several roots meet in one tile (i, j), i <= j, of its blocks of about ``TILE``."""
    rows = materialize(outside.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "outside")
    count = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    count = materialize(count.select("region", F.ceil(F.col("n") / TILE).alias("blocks")), "outside-blocks")
    rows = rows.join(count, "region").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("region", "tree", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def common_counts(x: list[np.ndarray], y: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``; ``shared``: sorted elements that are in both."""

    def places(sets):
        row, value = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
        hit = shared[at] == value
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    out = np.zeros((len(x), len(y)), np.int64)
    sides = [(len(s), *places(s)) for s in (x, y)] if len(shared) else []
    for begin in range(0, len(shared), BLOCK):
        parts = []
        for n, row, at in sides:
            low, high = np.searchsorted(at, [begin, begin + BLOCK])
            part = np.zeros((n, min(BLOCK, len(shared) - begin)), np.float32)
            part[row[low:high], at[low:high] - begin] = 1
            parts.append(part)
        out += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return out


def links_between(least: float, percent: int):
    """A tile of a region → (u, v): roots that are linked by a pair of the tile, as a forest.

    A pair that shares a region of an earlier tree has been compared there: with a core, in a
    small region, or in a tile of that region.
    """

    def run(tile: pa.Table) -> pa.Table:
        i, j, tree = (tile.column(c)[0].as_py() for c in ("i", "j", "tree"))
        block = tile.column("block").to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        names = tile.column("root").to_pylist()
        number = np.unique(np.array([x.hex() for x in names]), return_inverse=True)[1]
        small = np.frombuffer(b"".join(tile.column("small").to_pylist()), np.uint8).reshape(tile.num_rows, HASHES)
        regions = np.array(tile.column("regions").to_pylist(), np.int64).reshape(tile.num_rows, TREES)
        open_ = number[left][:, None] != number[right]
        if i == j:
            open_ &= left[:, None] < right
        same = np.zeros(open_.shape, np.uint8)
        for k in range(HASHES):
            same += small[left, k][:, None] == small[right, k]
        open_ &= (same / HASHES - 1 / 256) * 256 / 255 >= least
        if open_.any():
            for k in range(tree):
                open_ &= regions[left, k][:, None] != regions[right, k]
        a, b = open_.nonzero()
        found = []
        if len(a):
            parent = list(range(number.max() + 1))

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            (rows, ra), (cols, rb) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
            lists = tile.column("shingles")
            x, y = ([np.asarray(lists[int(k)].values) for k in side] for side in (left[rows], right[cols]))
            nx, ny = (np.array([len(s) for s in side]) for side in (x, y))
            shared = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
            # All intersections as one product of matrices, or each alone, whichever is less work.
            product = 1e-10 * len(x) * len(y) * len(shared) < len(a) * (2e-5 + 5e-8 * (nx.mean() + ny.mean()))
            both = common_counts(x, y, shared) if product else None
            for k in np.argsort(-same[a, b].astype(np.int64), kind="stable"):
                p, q = ra[k], rb[k]
                u, v = find(number[left[a[k]]]), find(number[right[b[k]]])
                if u == v:
                    continue
                n = both[p, q] if product else len(np.intersect1d(x[p], y[q], assume_unique=True))
                if 100 * n >= percent * (nx[p] + ny[q] - n):
                    parent[u] = v
                    found.append((names[left[a[k]]], names[right[b[k]]]))
        return pa.table({"u": pa.array([u for u, _ in found], pa.binary()), "v": pa.array([v for _, v in found], pa.binary())})

    return run


def linked(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """did, sig, n_shingles, component (smallest did reachable), kept and root of every row of ``docs``.

    Words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) text; shingles of ``shingle`` words, or
    the whole sequence if there are fewer. Two rows are linked if 100 * intersection >=
    ``percent`` * union of their sets. Null and empty texts have no shingles and are linked
    with nothing, not even each other. A null ``doc_id`` is larger than any other. Rows with
    the same ``doc_id`` and text are in one component; all of them have ``kept`` if one has.
    ``root`` tells components apart even if an identifier is in several; null without shingles.
    An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    least = percent / 100 - SLACK
    rows = docs.select(did().alias("did"), sig().alias("sig"), F.col("text"))
    signed = materialize(rows.select("did", "sig", word_hashes(text_of())).mapInArrow(sign(shingle), SIGNED), "signed")
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("did", "sig")).alias("doc"), F.first("regions").alias("regions"), F.first("small").alias("small"))
    nodes = materialize(nodes, "nodes")
    leaves = forest(nodes)
    pairs = materialize(candidates(leaves, nodes, least), "candidates")

    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    needed = needed.unionByName(leaves.where(F.col("n") > WINDOW + 1).select("node")).distinct()
    needed = materialize(needed.join(nodes, "node").select("node", "doc.did", "doc.sig"), "needed")
    # Only documents that pass a filter of the needed ones leave their task.
    place = F.array(F.xxhash64("did", "sig"))
    wanted, bits = filter_of(needed.select(place.alias("hashes")), needed.count(), "once")
    texts = rows.where(passes(wanted, bits)(place)).join(needed.hint("merge"), ["did", "sig"]).dropDuplicates(["did", "sig"]).select("node", word_hashes(text_of()))
    sets = materialize(texts.mapInArrow(shingled(shingle), "node binary, shingles array<bigint>"), "sets")

    first = confirmed(best_of_each(pairs, FIRST), sets, percent)
    roots = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")), "first")
    rest = materialize(apart(pairs, roots), "apart")
    bridges = confirmed(rest.select("a", "b"), sets, percent).join(rest, ["a", "b"])
    roots = merge(roots, bridges.select(F.col("ra").alias("u"), F.col("rb").alias("v")), "rest")

    members, others, outside = (materialize(x, "strays") for x in strays(leaves, roots))
    if not others.isEmpty():
        full = sets.join(nodes.select("node", "small"), "node")
        left, right = (x.join(full, "node").select("core", "m", "o", "node", "small", "shingles") for x in tiled(members, others))
        right = right.toDF(*right.columns)  # columns of its own, for the cogroup
        more = left.groupBy("core", "m", "o").cogroup(right.groupBy("core", "m", "o")).applyInArrow(links_to_core(least, percent), "u binary, v binary")
        more = more.join(roots.withColumnRenamed("node", "u"), "u", "left").select(F.coalesce("root", "u").alias("u"), "v").distinct()
        roots = merge(roots, more, "strays")
    if not outside.isEmpty():
        full = sets.join(nodes.select("node", "small", "regions"), "node")
        tiles = paired(outside, roots).join(full, "node").groupBy("region", "i", "j")
        roots = merge(roots, tiles.applyInArrow(links_between(least, percent), "u binary, v binary"), "outside")

    named = nodes.select("node", "doc.did").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "rooted")
    smallest = materialize(named.groupBy("root").agg(F.min("did").alias("component")), "components")
    named = materialize(named.join(smallest, "root").select("node", "root", "component"), "named")
    out = signed.join(named, "node", "left").withColumn("component", F.coalesce("component", "did"))
    return out.select("did", "sig", "n_shingles", "component", (F.col("did") == F.col("component")).alias("kept"), "root")


def keep(docs: DataFrame, **settings) -> DataFrame:
    """One row of each component of ``docs``, with its columns: that of the smallest ``doc_id``.

    Rows without a word are in no component and all stay.
    """
    found = linked(docs, **settings).where("root IS NOT NULL")
    chosen = found.groupBy("root").agg(F.min(F.struct("did", "sig")).alias("doc"))
    rows, d, s = keyed(docs)
    empty = F.length(without(text_of(), WHITE)) == 0
    chosen = materialize(chosen.select(F.col("doc.did").alias(d), F.col("doc.sig").alias(s)), "chosen")
    full = rows.where(~empty).join(chosen, [d, s], "left_semi").dropDuplicates([d, s])
    return full.select(*quoted(docs.columns)).unionByName(rows.where(empty).select(*quoted(docs.columns)))


def shingled(size: int):
    """(node, word hashes) → (node, shingles)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(np.asarray(x, np.int64), size).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run
