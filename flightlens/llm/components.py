"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.common import prepare
from flightlens.session import materialize


def contract(batches):
    """Edges of a task → (node, root): a star for each component of these edges, smallest node in the middle."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for k in range(0, len(nodes), 10_000):
        part = nodes[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([find(x) for x in part], pa.binary())], names=["u", "v"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (u binary, v binary): root is the component's smallest node.

    Each task first contracts its own edges to stars. Then every node takes the smallest label
    among its neighbours and follows its label's label, until nothing changes: a number of
    rounds that grows with the logarithm of the longest path. Each round is written, so joins
    read plain tables and the adaptive plan can split a node with very many edges.
    """
    prepare(edges.sparkSession)
    stars = materialize(edges.select("u", "v").mapInArrow(contract, "u binary, v binary"), f"{name}-stars")
    both = materialize(stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("low"))
        lower = materialize(labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root")), f"{name}-low-{step}")
        ahead = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = materialize(lower.join(ahead, "root").select("node", "was", F.col("next").alias("root")), f"{name}-{step}")
        if labels.where("was != root").isEmpty():
            return labels.select("node", "root")
