"""Exact top-k search by inner product: a KD-tree per shard, searched best box first.

Rows are numbered and dealt into shards of bounded size by median cuts: a bounded sample gives the cuts, so that a shard
is a region; a region with too many rows, such as equal ones, is dealt further by row number. A shard's tree splits at
medians of the widest dimension and keeps the tight box of each node; no vector of a box can score above the sum over
dimensions of max(q * low, q * high). A query first searches the shard that holds it; the score of its k-th hit then
goes with it, and it is sent only to those other shards whose whole box may score as much, and prunes boxes there.
Queries meet shards, and before that boxes of shards, in blocks of bounded size. Scores are integers and exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellprobe.llm.io import cut

SHARD_ROWS = 16_384
QUERY_BLOCK = 4_096
LEAF_ROWS = 64
#: Rows from which cuts are made (any cuts give the same result), and boxes of shards that meet one block of queries.
SAMPLE_ROWS, BOX_BLOCK = 20_000, 4_096
SCALE = 1024.0
_EXACT = 2.0**53
_LEAST = -(2**63)


def scaled(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(1024 x) of each component as doubles; shorter vectors are padded with zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return np.floor(SCALE * out)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and b: int64, exact; beyond 64 bits the nearest 64-bit number."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * width < _EXACT:
        return (a @ b.T).astype(np.int64)
    ints = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[max(_LEAST, min(2**63 - 1, sum(x * y for x, y in zip(u, v, strict=True)))) for v in ints[1]] for u in ints[0]], np.int64)


class KDTree:
    """Nodes in arrays: box, children, and for leaves a slice of the reordered rows."""

    def __init__(self, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(rows))
        self.low, self.high, self.children, self.slices = [], [], [], []
        pending = [(0, len(rows), -1, 0)]
        while pending:
            a, b, parent, side = pending.pop()
            own = rows[self.order[a:b]]
            node = len(self.low)
            low, high = own.min(0), own.max(0)
            self.low.append(low)
            self.high.append(high)
            self.children.append([-1, -1])
            self.slices.append((a, b))
            if parent >= 0:
                self.children[parent][side] = node
            spread = high - low
            if b - a > leaf_rows and spread.size and spread.max() > 0:
                axis, middle = int(spread.argmax()), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
                pending += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.rows = rows[self.order]

    @staticmethod
    def bounds_of(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Upper bounds of scores, query by box, as doubles with room for their rounding."""
        width = min(queries.shape[1], low.shape[1])
        q, low, high = queries[:, :width], low[:, :width], high[:, :width]
        exact = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        slack = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
        return exact + slack * 1e-12 + 0.5

    def search(self, queries: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, ids: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of up to k rows each that score ``kth[query]`` or more and aren't the query's own."""
        bounds, ids, rows = self.bounds_of(queries, self.low, self.high), ids[self.order], rows[self.order]
        for i in range(len(queries)):
            least = int(kth[i])
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            heap = [(-bounds[i, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if -bound < least:
                    break
                left, right = self.children[node]
                if left >= 0:
                    for child in (left, right):
                        if bounds[i, child] >= least:
                            heapq.heappush(heap, (-bounds[i, child], child))
                    continue
                a, b = self.slices[node]
                scores = _products(queries[i : i + 1], self.rows[a:b])[0]
                keep = (scores >= least) & (rows[a:b] != query_rows[i])
                if keep.any():
                    best, best_ids = np.concatenate([best, scores[keep]]), np.concatenate([best_ids, ids[a:b][keep]])
                    order = np.lexsort((best_ids, ~best))[:k]
                    best, best_ids = best[order], best_ids[order]
                    if len(best) == k:
                        least = max(least, int(best[-1]))
            yield i, best_ids, best


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return scaled([np.asarray(v, np.float64) for v in column.to_pylist()])


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal width; what is short gets zeros, as its vectors do."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for row, v in zip(out, rows, strict=True):
        row[: len(v)] = v
    return out


def _cuts(sample: np.ndarray, regions: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, value, node of the rows below, node of the others) of median cuts into about ``regions`` regions; a leaf has axis -1."""
    nodes, pending = [(-1, 0.0, -1, -1)], [(0, np.arange(len(sample)), regions)]
    while pending:
        node, rows, want = pending.pop()
        own = sample[rows]
        spread = own.max(0) - own.min(0) if len(rows) else np.zeros(0)
        if want < 2 or not spread.size or not spread.max() > 0:
            continue
        axis = int(spread.argmax())
        value = float(np.median(own[:, axis]))
        below = own[:, axis] < value
        if not below.any():  # the median is the least value
            value = float(own[:, axis][own[:, axis] > value].min())
            below = own[:, axis] < value
        nodes[node] = (axis, value, len(nodes), len(nodes) + 1)
        pending += [(len(nodes), rows[below], want // 2), (len(nodes) + 1, rows[~below], want - want // 2)]
        nodes += [(-1, 0.0, -1, -1)] * 2
    return nodes


def _region(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The leaf of each row."""
    out, pending = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
    while pending:
        node, rows = pending.pop()
        axis, value, low, high = nodes[node]
        if axis < 0:
            out[rows] = node
        elif len(rows):
            own = x[rows, axis] if axis < x.shape[1] else np.zeros(len(rows))
            pending += [(low, rows[own < value]), (high, rows[own >= value])]
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows; queries are the rows whose id is divisible by ``every``.

    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Rows count one
    by one, also those that share an id: each is a candidate of every query but itself, and each with a query's id is a
    query with ranks of its own. Shorter vectors are padded with zeros; vectors of any width are compared whole. Ties go
    to the smaller id. An empty table gives no rows; other columns are not read.
    """
    whole = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.where(F.col(id_col).isNotNull() & F.coalesce(whole, F.lit(False)))
    rows = cut(valid.select(F.col(id_col).cast("long").alias("_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("_v")).withColumn("_row", F.monotonically_increasing_id()))
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    if shards > 1:
        spread = 1 << 30
        sample = rows.where(F.pmod(F.xxhash64("_row"), F.lit(spread)) < spread * SAMPLE_ROWS // total).select("_v").toArrow()["_v"]
        nodes = _cuts(_vectors(sample), shards)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("_region", pa.array(_region(_vectors(batch.column(1)), nodes)))

        rows = cut(rows.mapInArrow(placed, "_id long, _v array<double>, _row long, _region long"))
        parts = rows.groupBy("_region").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("_parts"))
        rows = rows.join(cut(parts), "_region").withColumn("_shard", F.xxhash64("_region", F.expr("pmod(xxhash64(_row), _parts)"))).drop("_region", "_parts")
    else:
        rows = rows.withColumn("_shard", F.lit(0).cast("long"))
    base = cut(rows)
    schema = "query long, query_id long, vec_id long, score long"

    def hits(found: Iterator[tuple[int, np.ndarray, np.ndarray]], query: np.ndarray, query_ids: np.ndarray) -> pa.Table:
        found = list(found)
        at = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])
        joined = lambda n: np.concatenate([np.zeros(0, np.int64), *[x[n] for x in found]])
        return pa.table({"query": query[at], "query_id": query_ids[at], "vec_id": joined(1), "score": joined(2)})

    def home(part: pa.Table) -> pa.Table:
        ids, row, x = part["_id"].to_numpy(), part["_row"].to_numpy(), _vectors(part["_v"])
        asked = np.flatnonzero(ids % every == 0)
        return hits(KDTree(x).search(x[asked], row[asked], row, ids, np.full(len(asked), _LEAST), k), row[asked], ids[asked])

    def box(part: pa.Table) -> pa.Table:
        x = _vectors(part["_v"])
        return pa.table({"_shard": part["_shard"].slice(0, 1), "_low": pa.array([x.min(0).tolist()], pa.list_(pa.float64())), "_high": pa.array([x.max(0).tolist()], pa.list_(pa.float64()))})

    first = base.groupBy("_shard").applyInArrow(home, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    if shards > 1:
        first = cut(first)
        kth = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(_LEAST).alias("_kth"))
        asked = base.where(F.col("_id") % every == 0).join(kth, F.col("_row") == F.col("query"), "left")
        asked = asked.select(F.col("_row").alias("_query"), F.col("_id").alias("_query_id"), F.col("_v").alias("_q"), F.col("_shard").alias("_own"), F.coalesce("_kth", F.lit(_LEAST)).alias("_kth"))
        block = lambda c, n: F.pmod(F.xxhash64(c, F.lit("block")), F.lit(n)).cast("int")
        blocks = max(1, -(-total // (every * query_block)))
        asked = cut(asked.withColumn("_block", block("_query", blocks)))
        chunks = max(1, -(-2 * shards // BOX_BLOCK))
        boxes = base.groupBy("_shard").applyInArrow(box, "_shard long, _low array<double>, _high array<double>").withColumn("_chunk", block("_shard", chunks))
        boxes = cut(boxes).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sent = asked.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def reached(part: pa.Table, asked: pa.Table) -> pa.Table:
            """The shards other than its own whose box may score a query's k-th score or more."""
            queries, own = asked["_query"].to_numpy(), asked["_own"].to_numpy()
            shard = part["_shard"].to_numpy()
            if not len(queries) or not len(shard):
                return pa.table({"_query": pa.array([], pa.int64()), "_shard": pa.array([], pa.int64())})
            bounds = KDTree.bounds_of(_vectors(asked["_q"]), _padded(part["_low"]), _padded(part["_high"]))
            q, s = np.nonzero((bounds >= asked["_kth"].to_numpy()[:, None]) & (own[:, None] != shard[None, :]))
            return pa.table({"_query": queries[q], "_shard": shard[s]})

        going = boxes.groupBy("_chunk", "_block").cogroup(sent.groupBy("_chunk", "_block")).applyInArrow(reached, "_query long, _shard long")
        asked = asked.join(going, "_query")
        dealt = base.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def other(part: pa.Table, asked: pa.Table) -> pa.Table:
            ids, row = part["_id"].to_numpy(), part["_row"].to_numpy()
            queries, query_ids = asked["_query"].to_numpy(), asked["_query_id"].to_numpy()
            if not len(ids) or not len(queries):
                return hits(iter(()), queries, query_ids)
            return hits(KDTree(_vectors(part["_v"])).search(_vectors(asked["_q"]), queries, row, ids, asked["_kth"].to_numpy(), k), queries, query_ids)

        rest = dealt.groupBy("_shard", "_block").cogroup(asked.groupBy("_shard", "_block")).applyInArrow(other, schema)
        first = first.union(rest)
    ranked = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The same for the ``embeddings`` table in DuckDB.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.n <> c.n
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
