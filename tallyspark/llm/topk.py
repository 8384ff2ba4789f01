"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are indexed in blocks, of falling norms; a block holds, for each dimension, its rows in order of
that component. A block of queries meets one block of the index after another as a stream, and each query
takes its best so far along, so its k-th score is the bound that the next block has to beat. The bound of a
block at a depth is the inner product of the query with the components reached there, from the top of a
list where the query's component is positive and from its bottom where it is negative. Where it falls below
the k-th score, no row unseen in all lists can enter the result; a row of the same score and a smaller id
could, so it has to be below, not equal. A block whose bound is below at the first depth is not looked at.
A query that can stop early scores the rows it meets on the way down; queries that would meet much of a
block anyway score its rows together, by one product of matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Vectors in a block of the index, queries in a block of queries, and queries scored together.
BLOCK, QUERY_BLOCK, TOGETHER = 8192, 512, 128
#: Share of a block that a query may meet row by row.
EARLY = 1 / 16
#: Largest magnitude below which doubles add whole numbers exactly.
EXACT = 2**53


def threshold_top_k(index: np.ndarray, order: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, best: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """The ``k`` best ``(score, id)`` of ``best`` and of ``index`` (rows by dimensions), without rows of id ``own``.

    ``order`` holds for each dimension the rows in ascending order of that component.
    """
    n, best = len(index), list(best)
    dims = np.nonzero(query)[0]
    if not len(dims):  # every score is zero: the smallest ids win
        return sorted([*best, *((0, int(i)) for i in np.sort(ids[ids != own])[:k])], key=lambda x: (-x[0], x[1]))[:k]
    weights = query[dims]
    lists = np.where(weights[:, None] > 0, order[dims, ::-1], order[dims])
    seen = np.zeros(n, dtype=bool)
    seen[ids == own] = True
    depth, step = 0, 32
    while depth < n:
        to = min(n, depth + step)
        met = np.unique(lists[:, depth:to])
        met = met[~seen[met]]
        if len(met):
            seen[met] = True
            scores = index[met] @ query
            if len(best) == k:
                better = scores >= best[-1][0]
                met, scores = met[better], scores[better]
            top = np.lexsort((ids[met], -scores))[:k]
            best = sorted([*best, *((int(scores[t]), int(ids[met[t]])) for t in top)], key=lambda x: (-x[0], x[1]))[:k]
        if len(best) == k and index[lists[:, to - 1], dims] @ weights < best[-1][0]:
            break
        depth, step = to, step * 2
    return best


class Queries:
    """A block of queries of one width and the best that each has met."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int):
        self.ids, self.points, self.k = ids, points, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def kth(self) -> np.ndarray:
        """The score to reach, -infinity for queries that have met fewer than ``k`` rows."""
        return np.array([b[-1][0] if len(b) == self.k else -np.inf for b in self.best])

    def meet(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        points = self.points
        peak = float(np.abs(rows).max(initial=0)) * float(np.abs(points).max(initial=0)) * max(1, rows.shape[1])
        kind = np.float64 if peak < EXACT else np.int64
        rows, points = rows.astype(kind), points.astype(kind)
        reach, up, down, at = self.kth(), np.maximum(points, 0), np.minimum(points, 0), np.arange(rows.shape[1])
        stops, depth = np.full(len(points), len(rows)), 1
        while depth <= max(1, int(len(rows) * EARLY) // max(1, rows.shape[1])):
            bound = up @ rows[order[:, -depth], at] + down @ rows[order[:, depth - 1], at]
            stops = np.where((bound < reach) & (stops == len(rows)), depth - 1 if depth == 1 else depth, stops)
            depth *= 2
        early, deep = np.nonzero((stops > 0) & (stops < len(rows)))[0], np.nonzero(stops == len(rows))[0]
        for q in early.tolist():
            self.best[q] = threshold_top_k(rows, order, ids, points[q], int(self.ids[q]), self.k, self.best[q])
        for a in range(0, len(deep), TOGETHER):
            self._score(deep[a : a + TOGETHER], ids, rows, points, reach)

    def _score(self, which: np.ndarray, ids: np.ndarray, rows: np.ndarray, points: np.ndarray, reach: np.ndarray) -> None:
        scores = points[which] @ rows.T
        foreign = ids[None, :] != self.ids[which][:, None]
        to_reach = reach[which]
        fresh = np.isneginf(to_reach)
        if fresh.any() and len(ids) > self.k + 1:  # of the rows of the query's id there may be several
            masked = np.where(foreign[fresh], scores[fresh], scores.min() - 1)
            to_reach[fresh] = np.partition(masked, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        q, r = np.nonzero((scores >= to_reach[:, None]) & foreign)
        found = scores[q, r]
        order = np.lexsort((ids[r], -found, q))
        q, r, found = q[order], r[order], found[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        for i, score, vec in zip(which[q[keep]].tolist(), found[keep].tolist(), ids[r[keep]].tolist()):
            self.best[i].append((int(score), vec))
        for i in np.unique(which[q[keep]]).tolist():
            self.best[i] = sorted(self.best[i], key=lambda x: (-x[0], x[1]))[: self.k]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _least_kind(values: np.ndarray) -> str:
    """The narrowest integers that hold ``values``."""
    most = int(max(values.max(initial=0), -int(values.min(initial=0))))
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"


STREAM = "width int, b long, of_index boolean, place double, id long, v array<long>, ids binary, kind string, rows binary, lists binary"


def top_k_inner(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``vectors`` for each row of ``queries``.

    Components x become floor(scale * x), x as double; the score is their whole-number inner product, ties
    go to the smaller id. Rows with a null id or vector, or a null or non-finite component, take no part. A
    query meets the vectors of its own length. Rows of a query's own id are not among its results; queries
    repeated whole are one query, but each repeated row of ``vectors`` is a candidate of its own.
    Components are to be small enough for sums to fit a long. An empty side gives no rows; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        numbers = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
        return df.filter(sound).select(F.col(id_col).cast("long").alias("id"), numbers.alias("v"))

    def block(batches):
        parts: dict[int, list] = {}  # by length of vector
        held: dict[int, int] = {}

        def emit(width):
            held.pop(width)
            i, m = map(np.concatenate, zip(*parts.pop(width)))
            order, kind = np.argsort(m, axis=0, kind="stable").T.astype("<u2"), _least_kind(m)
            norm = float(np.sqrt((m.astype(float) ** 2).sum(axis=1).max()))
            return pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "place": [-norm], "ids": [i.astype("<i8").tobytes()], "kind": [kind], "rows": [m.astype(kind).tobytes()], "lists": [order.tobytes()]})

        for batch in batches:
            if not len(batch):
                continue
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for width in np.unique(lengths).tolist():
                of = batch.filter(pa.array(lengths == width))
                i, m = of.column("id").to_numpy(zero_copy_only=False), _matrix(of.column("v"))
                for a in range(0, len(i), BLOCK):
                    piece = i[a : a + BLOCK], m[a : a + BLOCK]
                    if held.get(width, 0) + len(piece[0]) > BLOCK:
                        yield emit(width)
                    parts.setdefault(width, []).append(piece)
                    held[width] = held.get(width, 0) + len(piece[0])
                    if sum(held.values()) > BLOCK:  # rows of all lengths together, so many lengths take no more memory
                        yield emit(max(held, key=held.get))
        for width in list(parts):
            yield emit(width)

    def search(batches):
        now, key, waiting = None, None, []

        def gather():
            return Queries(np.array([i for i, _ in waiting], dtype=np.int64), np.array([v for _, v in waiting], dtype=np.int64), k)

        def report():
            rows = [(int(q), vec, score) for q, best in zip(now.ids, now.best) for score, vec in best] if now else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for n in range(len(batch)):
                r = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                if (r["width"], r["b"]) != key:
                    yield report()
                    key, waiting, now = (r["width"], r["b"]), [], None
                if not r["of_index"]:
                    waiting.append((r["id"], r["v"]))
                    continue
                if now is None:
                    now = gather()
                rows = np.frombuffer(r["rows"], r["kind"]).reshape(-1, r["width"])
                now.meet(np.frombuffer(r["ids"], "<i8"), rows, np.frombuffer(r["lists"], "<u2").reshape(r["width"], -1).astype(np.int64))
        yield report()

    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    index = scratch.write(whole(vectors).repartitionByRange(F.desc(norm), "id").sortWithinPartitions(F.desc(norm), "id").mapInArrow(block, "width int, place double, ids binary, kind string, rows binary, lists binary"), "index")
    asked = scratch.write(whole(queries).distinct().withColumn("width", F.size("v")), "queries")
    # Queries are dealt over blocks by their id; each block of the index goes to every block of queries of its width.
    numbers = scratch.write(asked.groupBy("width").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("n")), "numbers")
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in STREAM.split(", ")}
    names = [c.split()[0] for c in STREAM.split(", ")]
    left = asked.join(numbers, "width").withColumns({"b": F.pmod(F.xxhash64("id"), F.col("n")), "of_index": F.lit(False)})
    right = index.join(numbers, "width").withColumns({"b": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)), "of_index": F.lit(True)})
    stream = left.select(*(c if c in left.columns else none[c].alias(c) for c in names)).union(right.select(*(c if c in right.columns else none[c].alias(c) for c in names)))
    met = stream.repartition("width", "b").sortWithinPartitions("width", "b", "of_index", "place")
    found = scratch.write(met.mapInArrow(search, "query_id long, vec_id long, score long"), "found")
    # A query id with two vectors may stand in two results of its own, so ranks are given anew.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same in DuckDB, for rows whose id is divisible by 50 as queries.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(q.v, lambda x, i: x * c.v[i])) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
