"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is dealt to a leaf.  A query pulls
branches from a priority queue, best centroid first, and visits as many leaves as the
calibration found enough: the true neighbours of some vectors, by brute force over all
rows, lie in that many first leaves at the wanted recall.  A query goes on while these leaves
list too few rows to give k.  Scores are exact cosines.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, released

#: Vectors that the tree is fitted on, vectors of the sample in a leaf, branches of a node.
SAMPLE, LEAF, BRANCHES = 20_000, 64, 8
#: Vectors used to calibrate, and the share of their true neighbours to be found.
CALIBRATION, RECALL = 160, 0.96
#: Blocks that the leaves are dealt to at least, and rows of a block at most; a leaf alone is cut only beyond that.
BLOCKS, BLOCK_ROWS = 16, 8192


class Tree:
    """Centroids of all nodes, children of each, and the leaf number of those without."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        self.centroids, self.children, self.leaf, self.leaves = [sample.mean(axis=0) if len(sample) else sample.sum(axis=0)], [[]], [-1], 0
        self._grow(0, sample)
        self.centroids = np.array(self.centroids)
        self.leaf = np.array(self.leaf)

    def _grow(self, node: int, rows: np.ndarray) -> None:
        groups = self._split(rows) if len(rows) > LEAF else []
        if len(groups) < 2:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
            return
        first = len(self.centroids)
        for centre, members in groups:
            self.children[node].append(len(self.centroids))
            self.centroids.append(centre)
            self.children.append([])
            self.leaf.append(-1)
        for i, (_, members) in enumerate(groups):
            self._grow(first + i, members)

    def _split(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = rows[self.rng.choice(len(rows), BRANCHES, replace=False)]
        for _ in range(8):
            near = (rows @ centres.T).argmax(axis=1)
            centres = np.array([unit(rows[near == i].sum(axis=0)[None])[0] for i in range(len(centres)) if (near == i).any()])
        near = (rows @ centres.T).argmax(axis=1)
        return [(centres[i], rows[near == i]) for i in range(len(centres)) if (near == i).any()]

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector: the nearest child at every level."""
        node = np.zeros(len(rows), np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            open_rows = open_rows[self.leaf[node[open_rows]] < 0]
            for parent in np.unique(node[open_rows]).tolist():
                mine = open_rows[node[open_rows] == parent]
                kids = np.array(self.children[parent])
                node[mine] = kids[(rows[mine] @ self.centroids[kids].T).argmax(axis=1)]
        return self.leaf[node].astype(np.int32)

    def visits(self, query: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves in best-bin-first order: ``most``, and more until they hold ``least`` rows by the counts ``held``."""
        near = self.centroids @ query
        queue, found, rows = [(0.0, 0)], [], 0
        while queue and (len(found) < most or rows < least):
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                kids = sorted(self.children[node], key=lambda k: -near[k])
                for kid in kids[1:]:
                    heapq.heappush(queue, (-near[kid], kid))
                node = kids[0]
            found.append(int(self.leaf[node]))
            rows += int(held[found[-1]]) if least else 0
        return found


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, zero rows as they are; a power of two takes each row near 1 first, so no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1, initial=0.0, keepdims=True))
    rows = np.ldexp(rows, -exponent)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part, one for each id.

    Left out: null ids; vectors that are null, empty or zero, or hold null or non-finite
    values, or are not of the commonest length (of ties, the longest).  Of rows that share
    an id the one with the smallest vector counts.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & F.exists("vector", lambda x: x != 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.filter(F.size("vector") == (lengths["n"] if lengths else 0)).groupBy("id").agg(F.min("vector").alias("vector"))


def _top(score: np.ndarray, at: np.ndarray, ids: list, own: int, k: int) -> list[tuple[int, float]]:
    """The k best (id, score) of the rows ``at``, which stand for the ids of equal vectors, without ``own``."""
    seen = np.arange(len(score))
    if len(seen) > k + 1:
        least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
        above, level = np.flatnonzero(score > least), np.flatnonzero(score == least)
        # Of rows at the last score only those with the smallest ids can be needed.
        seen = np.r_[above, sorted(level, key=lambda i: ids[at[i]][0])[: k + 1]]
    found = sorted((-score[i], v) for i in seen.tolist() for v in ids[at[i]] if v != own)
    return [(v, -s) for s, v in found[:k]]


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row with ``is_query``.

    ``is_query`` is a condition on the column ``id``.  All rows but the query's own are
    candidates; ties go to the smaller id; fewer rows give all of them.  Equal vectors are
    indexed once with their k + 1 smallest ids, which are all that can be returned.  Rows
    that share an id count once.  An empty table gives no rows; other columns are left alone.

    Leaves that follow each other in the tree share a block; a query goes only to the blocks
    of leaves that it visits, and there only those leaves' rows are scored.
    """
    valid = materialise(usable(df, id_col, vector_col))
    same = Window.partitionBy("key", "vector").orderBy("id")
    base = (
        valid.withColumn("key", F.xxhash64("vector"))
        .withColumn("place", F.row_number().over(same))
        .filter(F.col("place") <= k + 1)
        .groupBy("key", "vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    base = materialise(base)
    total = base.count()
    draw = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30))
    some = base.filter(draw < (1 << 30) * min(1.0, SAMPLE / max(1, total))).orderBy("key").limit(SAMPLE).select("vector")
    tree = Tree(unit(matrix(some.toArrow().column("vector"))) if total else np.zeros((0, 1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.place(unit(matrix(batch.column(1)))))], names=[*batch.schema.names, "leaf"])

    dealt = materialise(base.select("key", "vector", "ids").mapInArrow(released(deal), "key long, vector array<double>, ids array<long>, leaf int"))
    wanted = _calibrated(dealt, tree, k, total, recall)

    held, listed = np.zeros(max(1, tree.leaves), np.int64), np.zeros(max(1, tree.leaves), np.int64)
    for row in dealt.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect():  # one row a leaf
        held[row["leaf"]], listed[row["leaf"]] = row["n"], row["ids"]
    most = max(1, min(BLOCK_ROWS, -(-total // BLOCKS)))
    block_of, cuts = (np.cumsum(held) - held) // most, np.maximum(1, -(-held // BLOCK_ROWS))
    # The first row of a block leads; what follows of a leaf that is cut has a number of its own.
    block_map, cut_map = (F.array(*[F.lit(int(v)) for v in values]) for values in (block_of, cuts))
    data = dealt.select(
        F.element_at(block_map, F.col("leaf") + 1).alias("block"), F.pmod(F.xxhash64("key", F.lit(3)), F.element_at(cut_map, F.col("leaf") + 1)).cast("int").alias("cut"), F.lit(0).alias("side"),
        F.lit(0).cast("long").alias("id"), "vector", "ids", F.array("leaf").alias("leaves"),
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, vector in enumerate(unit(matrix(batch.column(1))) if batch.num_rows else []):
                goes: dict[tuple[int, int], list[int]] = {}
                for leaf in tree.visits(vector, wanted, listed, k + 1):
                    for cut in range(int(cuts[leaf])):
                        goes.setdefault((int(block_of[leaf]), cut), []).append(leaf)
                rows += [(*place, i, leaves) for place, leaves in goes.items()]
            at = pa.array([r[2] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
                names=["block", "cut", "id", "vector", "leaves"],
            )

    queries = valid.filter(is_query).select("id", "vector").mapInArrow(released(route), "block int, cut int, id long, vector array<double>, leaves array<int>")
    queries = queries.select("block", "cut", F.lit(1).alias("side"), "id", "vector", F.lit(None).cast("array<long>").alias("ids"), "leaves")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, data before queries; one block of data is held at a time, in the order of its leaves."""
        block, held, ready = None, [], None
        for batch in batches:
            first, second, side = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(first)], strict=True):
                if a == b:
                    continue
                if (first[a], second[a]) != block:
                    block, held, ready = (first[a], second[a]), [], None
                rows = batch.slice(a, b - a)
                if side[a] == 0:
                    held.append(rows)
                    continue
                if not held:
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held)
                    leaf = table.column("leaves").combine_chunks().flatten().to_numpy()
                    table, leaf = table.take(pa.array(np.argsort(leaf, kind="stable"))), np.sort(leaf)
                    ready = unit(matrix(table.column("vector"))), table.column("ids").to_pylist(), leaf
                vectors, ids, leaf = ready
                out = []
                for own, query, visited in zip(rows.column(3).to_pylist(), unit(matrix(rows.column(4))), rows.column(6).to_pylist(), strict=True):
                    bounds = zip(np.searchsorted(leaf, visited), np.searchsorted(leaf, visited, "right"), strict=True)
                    at = np.concatenate([np.arange(x, y) for x, y in bounds])
                    if len(at):
                        out += [(own, v, s) for v, s in _top(vectors[at] @ query, at, ids, own, k)]
                columns = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    met = data.unionByName(queries).repartition("block", "cut").sortWithinPartitions("block", "cut", "side")
    found = met.mapInArrow(released(search), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(dealt: DataFrame, tree: Tree, k: int, total: int, recall: float) -> int:
    """Leaves to visit so that the wanted share of true neighbours is found."""
    draw = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 30))
    rows = dealt.filter(draw < (1 << 30) * min(1.0, 2 * CALIBRATION / max(1, total))).orderBy("key").limit(CALIBRATION).select("key", "vector").toArrow()
    if not rows.num_rows:
        return 1
    keys, vectors = rows.column("key").to_numpy(), unit(matrix(rows.column("vector")))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = vectors @ unit(matrix(batch.column(1))).T
            scores[keys[:, None] == batch.column(0).to_numpy()] = -np.inf
            top = np.argsort(-scores, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(keys)), top.shape[1])), pa.array(np.take_along_axis(scores, top, 1).reshape(-1)), batch.column(3).take(pa.array(top.reshape(-1)))],
                names=["query", "score", "leaf"],
            )

    near = dealt.mapInArrow(released(brute), "query long, score double, leaf int").filter("score > -2")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "leaf")
    truth = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "leaf").collect()  # k rows a query
    order = [{leaf: i + 1 for i, leaf in enumerate(tree.visits(v, tree.leaves))} for v in vectors]
    ranks = sorted(order[r["query"]][r["leaf"]] for r in truth)
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))] if ranks else 1
