"""Exact top-k inner-product search by two cover trees that are walked together.

Queries and data are dealt into blocks; a task indexes one block of either by a cover tree and walks
the two trees. A pair of nodes is left out if no point below can matter: the inner product is at most
``<cq, cr> + Rq |cr| + Rr |cq| + Rq Rr`` for centres c and covering radii R, and that must reach the
worst kth score among the queries below the query node. Equal scores are never pruned, so ties go to
the smaller id. The best k of every block are merged by a window per query.

Defined results: rows without an id, and vectors that are null, empty or hold null, NaN or infinite
parts, take no part; a query meets only vectors of its own length and never rows of its own id;
repeated query rows are one query; components must keep products below 2**53.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.session import stage

#: Ratio of the covering radii of a node and its children.
BASE = 1.3
LEAF = 64
#: Least points per child on average.
THIN = 12
#: Rows of a task's block of data and of queries.
DATA_BLOCK, QUERY_BLOCK = 8192, 2048


@dataclass
class Node:
    """Points ``rows`` lie within ``radius`` of ``centre``; a leaf has no children."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    norm: float
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    """Every child covers its points within 1/BASE of the parent's radius; centres keep that distance.

    Where children would hold fewer than ``THIN`` points each, as in high dimensions, the node stays
    a leaf: a product of two matrices is cheaper than a bound for nearly every point.
    """
    squares = np.einsum("ij,ij->i", points, points)

    def distances(rows: np.ndarray, centre: int) -> np.ndarray:
        gap = squares[rows] + squares[centre] - 2 * (points[rows] @ points[centre])
        return np.sqrt(np.maximum(gap, 0))

    def node(rows: np.ndarray, centre: int, away: np.ndarray) -> Node:
        return Node(points[centre], float(away.max()), rows, float(np.sqrt(squares[centre])))

    everything = np.arange(len(points))
    middle = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    root = node(everything, middle, distances(everything, middle))
    open_ = [(root, middle)]
    while open_:
        parent, centre = open_.pop()
        if len(parent.rows) <= leaf or parent.radius == 0:
            continue
        reach, left = parent.radius / BASE, parent.rows
        away = distances(left, centre)
        nearest, children = away, []
        while len(left) and len(children) * THIN <= len(parent.rows):
            inside = away <= reach
            inside[left == centre] = True
            children.append((node(left[inside], centre, away[inside]), centre))
            left, nearest = left[~inside], np.minimum(nearest, away)[~inside]
            if len(left):
                centre = int(left[np.argmax(nearest)])
                away = distances(left, centre)
        if not len(left) and len(children) > 1:
            parent.children = [child for child, _ in children]
            open_ += children
    return root


class Search:
    """The best k of ``data`` for each query, by (score descending, id)."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.own, self.data, self.ids, self.k = queries, own, data, ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.slack = 1e-9 * (1 + np.abs(queries).max() * np.abs(data).max() * data.shape[1])

    def worst(self, node: Node) -> float:
        return float(self.scores[node.rows, -1].min())

    def bound(self, q: Node, r: Node) -> float:
        reach = q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
        return float(q.centre @ r.centre) + reach * (1 + 1e-9) + self.slack

    def compare(self, q: Node, r: Node) -> None:
        """All queries of one leaf with all data of another."""
        scores = self.queries[q.rows] @ self.data[r.rows].T
        able = scores >= self.scores[q.rows, -1][:, None]
        able &= self.ids[r.rows][None, :] != self.own[q.rows][:, None]
        at, of = np.nonzero(able)
        if not len(at):
            return
        touched, slot = np.unique(at, return_inverse=True)
        rows = q.rows[touched]
        slot = np.concatenate([slot, np.repeat(np.arange(len(rows)), self.k)])
        score = np.concatenate([scores[at, of], self.scores[rows].ravel()])
        ids = np.concatenate([self.ids[r.rows[of]], self.found[rows].ravel()])
        order = np.lexsort((ids, -score, slot))
        first = np.searchsorted(slot[order], np.arange(len(rows)))
        best = order[first[:, None] + np.arange(self.k)]
        self.scores[rows], self.found[rows] = score[best], ids[best]

    def run(self) -> None:
        q, r = cover_tree(self.queries, 32), cover_tree(self.data)
        order = 0
        heap = [(-self.bound(q, r), order, q, r)]
        while heap:
            minus, _, q, r = heapq.heappop(heap)
            if -minus < self.worst(q):
                continue
            if not q.children and not r.children:
                self.compare(q, r)
                continue
            split_query = bool(q.children) and (not r.children or q.radius > r.radius)
            pairs = [(c, r) for c in q.children] if split_query else [(q, c) for c in r.children]
            for a, b in pairs:
                limit = self.bound(a, b)
                if limit >= self.worst(a):
                    order += 1
                    heapq.heappush(heap, (-limit, order, a, b))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def top_k(queries: DataFrame, data: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``query_id, rank, <key>, score`` of the ``k`` best rows of ``data`` for every query.

    The number of blocks follows from the counts of both sides, so the work of a task is bounded;
    data and queries are repeated once for each block of the other side.
    """

    def valid(df: DataFrame) -> DataFrame:
        parts = F.col(vector).cast("array<double>")
        whole = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        some = df.filter(F.col(key).isNotNull() & (F.size(parts) > 0) & whole)
        return some.select(F.col(key).cast("bigint").alias("id"), parts.alias("v"))

    rows = stage(valid(data), "vectors")
    asked = stage(valid(queries).distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    data_blocks = max(1, math.ceil(rows.count() / DATA_BLOCK))
    query_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, salt: list[str], blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64(*salt), F.lit(blocks))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint")))
        return df.withColumn(own, block).withColumn(other, every)

    numbered = rows.withColumn("query", F.lit(None).cast("bigint"))
    spread = numbered.withColumn("spread", F.monotonically_increasing_id())
    left = dealt(spread, "d", ["spread"], data_blocks, "q", query_blocks).drop("spread")
    right = dealt(asked, "q", ["query"], query_blocks, "d", data_blocks)
    cells = left.unionByName(right).withColumn("size", F.size("v"))

    def search(table: pa.Table) -> pa.Table:
        is_query = table.column("query").is_valid()
        asks, base = table.filter(is_query), table.filter(pc.invert(is_query))
        if not asks.num_rows or not base.num_rows:
            return RESULT.empty_table()
        own, ids = asks.column("id").to_numpy(), base.column("id").to_numpy()
        job = Search(_matrix(asks.column("v")), own, _matrix(base.column("v")), ids, k)
        job.run()
        hit = np.isfinite(job.scores)
        at = np.nonzero(hit)[0]
        columns = [asks.column("query").to_numpy()[at], own[at], job.found[hit], job.scores[hit].astype(np.int64)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=RESULT)

    best = cells.groupBy("size", "q", "d").applyInArrow(search, "query long, query_id long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


RESULT = pa.schema([(n, pa.int64()) for n in ("query", "query_id", "id", "score")])

