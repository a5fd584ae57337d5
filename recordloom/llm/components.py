"""Connected components of an edge table by union-find: inside tasks first, then by contraction over the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .textkit import tidy

#: Nodes that a task holds at once at most.
MOST_NODES = 200_000


def forest(edges: DataFrame, roots: bool = False) -> DataFrame:
    """Edges (a, b) with the same components: in each task, from every node held at once to the least that it reaches; roots: from that to itself too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent[x]
            return top

        def flush() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in list(parent)]
            pairs = [p for p in pairs if roots or p[0] != p[1]]
            parent.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > MOST_NODES:
                yield flush()
        yield flush()

    return edges.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) of every node with an edge.

    Each step deals MOST_NODES / 2 edges, which can't have more nodes than
    that, to a task, which turns them into a forest. Then every node points
    to the least of itself and its neighbours (by id, which contracts the
    trees of a forest at once, and in every other step in a random order,
    which keeps the steps logarithmic in the nodes), and the edges are
    contracted. A node with very many edges costs a partial aggregate and a
    join that Spark can split. What fits in one task ends there. Loops and
    repeated edges have no effect; no edges give no rows.
    """
    edges = materialise(forest(edges.filter("a <> b")), "edges")
    pointers = None
    step, share = 0, MOST_NODES // 2
    while (count := edges.count()) > share:
        edges = materialise(forest(edges.coalesce(-(-count // share))), "dealt")
        order = lambda c, n=step: F.struct((F.xxhash64(F.lit(n), F.col(c)) if n % 2 else F.col(c)).alias("o"), F.col(c).alias("to"))
        both = edges.select("a", order("b").alias("next")).unionByName(edges.select(F.col("b").alias("a"), order("a").alias("next")))
        least = both.groupBy("a").agg(F.min("next").alias("next"))
        least = materialise(least.select(F.col("a").alias("node"), F.least(order("a"), F.col("next"))["to"].alias("to")), "least")
        left = edges.join(least.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(least.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        edges = materialise(forest(left.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b")), "edges")
        pointers = least if pointers is None else followed(pointers, least)
        step += 1
    last = materialise(forest(edges.coalesce(1), roots=True).select(F.col("a").alias("node"), F.col("b").alias("to")), "last")
    if pointers is None:
        return last.withColumnRenamed("to", "component")
    pointers = materialise(followed(pointers, last), "pointers")
    smallest = pointers.groupBy("to").agg(F.min("node").alias("component"))
    return materialise(pointers.join(smallest, "to").select("node", "component"), "components")


def followed(pointers: DataFrame, further: DataFrame) -> DataFrame:
    """pointers (node, to), each led on by what further has for its end."""
    return pointers.join(further.select(F.col("node").alias("to"), F.col("to").alias("further")), "to", "left").select("node", F.coalesce("further", "to").alias("to"))
