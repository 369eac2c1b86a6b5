"""Operator 10: exact top-k inner-product search by ball trees.

Components become integers ``floor(1024 x)``; the score is their inner product.
Vectors are dealt by hashed id into shards; a task builds one ball tree a shard
(median splits along the widest axis down to leaves of ``LEAF`` rows; each node
has its centre, radius and smallest id) and stores it as one row.  Queries are
packed into blocks, and every block meets every shard once, by a join on the
shard, so a shard moves once and no pair of vectors is ever a row.

Search is best first: nodes wait in a heap ordered by the upper bound ``q.c +
|q| r`` and the search ends when the next bound is below the k-th score found.
A bound equal to it goes on only if the node holds a smaller id, so many equal
vectors don't widen the search.  The k-th score is shared between shards: a
pilot run of each block over one shard gives a first k-th score for each query,
which all other shards start from.

Rows: vectors that are NULL or hold a NULL or non-finite component take no
part, nor rows without an id.  Rows that repeat an id are candidates each, and
such queries share their k best (never rows of their own id); they are dealt by
row, so a hot id fills no shard.  Empty vectors score 0 with each other;
vectors of different lengths are never compared.  Components of any size count:
scores are summed in doubles, longs or Python integers, whichever is exact, and
a score or component beyond a long is an error.  Ties go to the smaller id; a
query with fewer than k candidates returns all of them.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import saved

SHARD_ROWS, LEAST_SHARDS, QUERY_BLOCK, LEAF, SCALE = 1 << 16, 8, 1024, 64, 1024


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, v array<int>) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x"), fine.alias("fine")).where("vec_id is not null and fine")
    whole = lambda x: F.when(F.abs(x) < float(2**52), F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component times 1024 is beyond a long")).cast("long"))
    return df.select("vec_id", F.size("x").alias("dim"), F.transform("x", whole).alias("v"))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def build_tree(ids: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes in breadth-first order; a leaf has child -1.  Rows are permuted so that each node is a slice."""
    place = np.arange(len(ids))
    nodes, at = [(0, len(ids))], 0
    centre, radius, child, low, span = [], [], [], [], []
    while at < len(nodes):
        a, b = nodes[at]
        x = rows[place[a:b]].astype(np.float64)
        c = x.mean(0)
        centre.append(c)
        radius.append(float(np.sqrt(((x - c) ** 2).sum(1).max())))
        low.append(int(ids[place[a:b]].min()))
        span.append((a, b))
        if b - a > LEAF:
            wide = x[:, int((x.max(0) - x.min(0)).argmax())] if x.shape[1] else np.zeros(b - a)
            place[a:b] = place[a:b][np.lexsort((ids[place[a:b]], wide))]
            mid = (a + b) // 2
            child.append(len(nodes))
            nodes += [(a, mid), (mid, b)]
        else:
            child.append(-1)
        at += 1
    most = np.abs(rows).max(initial=0)
    return {"ids": ids[place], "rows": rows[place].astype(np.int16 if most < 2 ** 15 else np.int32 if most < 2 ** 31 else np.int64), "centre": np.array(centre), "radius": np.array(radius),
            "child": np.array(child), "low": np.array(low), "span": np.array(span)}


def search(tree: dict, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
    """(score, id) of the k best, best first; what scores below ``least`` can't be among them."""
    q = query.astype(np.float64)
    size = float(np.sqrt(q @ q))
    slack = 1e-6 * (1 + size)
    bound = tree["centre"] @ q + size * tree["radius"]
    bound += slack + 1e-9 * size * (np.sqrt((tree["centre"] ** 2).sum(1)) + tree["radius"])  # beyond the rounding of all sums
    heap, best = [(-bound[0], 0)], []  # best: min-heap of (score, -id)
    while heap:
        top, node = heapq.heappop(heap)
        if np.floor(-top) < least:
            break
        if len(best) == k and (np.floor(-top) < best[0][0]):
            break
        if len(best) == k and np.floor(-top) == best[0][0] and tree["low"][node] > -best[0][1]:
            continue
        c = int(tree["child"][node])
        if c >= 0:
            heapq.heappush(heap, (-min(bound[c], -top), c))
            heapq.heappush(heap, (-min(bound[c + 1], -top), c + 1))
            continue
        a, b = tree["span"][node]
        scores = tree["dot"](a, b, query)
        ids = tree["ids"][a:b]
        floor = max(least, best[0][0] if len(best) == k else -np.inf)
        for j in np.flatnonzero(scores >= floor).tolist():
            item = (int(scores[j]), -int(ids[j]))
            if -item[1] == own:
                continue
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def _opened(data: bytes) -> dict:
    tree = _unpack(data)
    rows = tree["rows"]
    most = int(np.abs(rows.astype(np.int64)).max(initial=0))
    real = rows.astype(np.float64) if most ** 2 * rows.shape[1] < 2 ** 52 else None

    def dot(a, b, q):
        if real is not None and most * int(np.abs(q).max(initial=0)) * len(q) < 2 ** 53:
            return real[a:b] @ q  # whole numbers below 2^53 are exact
        if most * int(np.abs(q).max(initial=0)) * len(q) < 2 ** 63:
            return rows[a:b].astype(np.int64) @ q.astype(np.int64)
        return rows[a:b].astype(object) @ q.astype(object)
    tree["dot"] = dot
    return tree


def _at_most(score: int) -> float:
    """The largest double that isn't above the score."""
    x = float(score)
    return x if x <= score else float(np.nextafter(x, -np.inf))


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.assign(v=[tuple(x) for x in pdf["v"]]).sort_values(["vec_id", "v"])
    return pdf["vec_id"].to_numpy(np.int64), np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), -1 if len(pdf["v"].iloc[0]) else 0)


def _trees(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [_pack(**build_tree(*_rows(pdf)))]})


def _blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    ids, rows = _rows(pdf)
    return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "queries": [_pack(ids=ids, rows=rows, least=np.full(len(ids), -np.inf))]})


def _pilot(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tree, data in zip(b.column(2), b.column(3)):
                tree, q = _opened(tree.as_py()), _unpack(data.as_py())
                got = [search(tree, v, own, k, -np.inf) for own, v in zip(q["ids"].tolist(), q["rows"])]
                out.append(_pack(ids=q["ids"], rows=q["rows"], least=np.array([_at_most(g[-1][0]) if len(g) == k else -np.inf for g in got], float)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["dim", "block", "queries"])
    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, data in zip(b.column(2), b.column(3)):
                tree, q = _opened(tree.as_py()), _unpack(data.as_py())
                rows = [(own, i, s) for own, v, least in zip(q["ids"].tolist(), q["rows"], q["least"].tolist()) for s, i in search(tree, v, own, k, least)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs as ``integers`` gives them.  A query's own id is no candidate."""
    row = F.monotonically_increasing_id()  # written with the rows: rows of one id are dealt apart
    cand = saved(candidates.withColumn("slot", row), "topk_vectors")
    shards = max(-(-cand.count() // SHARD_ROWS), LEAST_SHARDS)
    trees = cand.withColumn("shard", F.pmod(F.xxhash64("vec_id", "slot"), F.lit(shards))).drop("slot").groupBy("dim", "shard").applyInPandas(_trees, "dim int, shard long, tree binary")
    trees = saved(trees, "topk_trees")
    queries = saved(queries.withColumn("slot", row), "topk_queries")
    blocks = max(-(-queries.count() // QUERY_BLOCK), 1)
    packed = saved(queries.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id", "slot"), F.lit(blocks))).drop("slot").groupBy("dim", "block")
                   .applyInPandas(_blocks, "dim int, block long, queries binary"), "topk_blocks")
    first = packed.withColumn("shard", F.pmod("block", F.lit(shards))).join(trees, ["dim", "shard"], "left")
    known = first.where("tree is not null").select("dim", "block", "tree", "queries").mapInArrow(_pilot(k), "dim int, block long, queries binary")
    packed = saved(known.union(first.where("tree is null").select("dim", "block", "queries")), "topk_known")
    every = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    met = every.join(trees, ["dim", "shard"]).select("shard", "block", "tree", "queries")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
