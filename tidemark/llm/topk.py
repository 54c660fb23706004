"""Exact top-k inner products over norm-sorted vectors.

Vectors are turned to integers floor(scale * x). Their second moments (a dim x dim table,
whatever the number of rows) give the SVD basis of the data; in it the first coordinates
carry most of every product. Rows are cut into bands of descending length, bands into blocks, and queries into blocks. A first pass scores the queries against the longest block alone and gives
each a k-th score to beat. Then a pair of blocks is visited only if length times length
can reach it; inside, vectors are cut where their length is too small, partial sums over
the first rotated coordinates plus the Cauchy-Schwarz bound of the residuals leave a few
candidates, and those get exact integer products. Bounds carry a margin for rounding, so
nothing that ties the k-th score is lost.

A task holds one block of vectors and one of queries. Each block pair returns at most k
rows a query, and a last aggregation keeps the k best.

Cases: vectors that are null or hold null, NaN or infinite components take no part; shorter
vectors are padded with zeros; products beyond 64 bits saturate; rows that repeat a vec_id
are ranked each (a query's own id never is a candidate); ties go to the smaller vec_id;
fewer candidates than k give fewer rows; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

QUERY_BLOCK, VECTOR_BLOCK, BANDS, HEAD = 1024, 8192, 64, 16
_EXACT = 2.0**52


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v (array of doubles that are whole numbers) of the rows that take part."""
    v = F.col(f"`{vector_col}`")
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(usable & F.col(f"`{id_col}`").isNotNull())
    # a double holds the whole number exactly, and values beyond a long as well
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: _floor(x, scale)).alias("v"))


def _floor(x, scale: int):
    y = x.cast("double") * scale
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def basis(rows: DataFrame, dim: int) -> np.ndarray:
    """The orthogonal basis, largest second moment first."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0), dim)
            total += m.T @ m
        i, j = np.indices((dim, dim)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "m"])

    summed = rows.select("v").mapInArrow(moments, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect()  # dim * dim rows
    gram = np.zeros((dim, dim))
    for r in summed:
        gram[r["i"], r["j"]] = r["m"]
    if not np.isfinite(gram).all():
        return np.eye(dim)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number products of one row with rows."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * len(q) < _EXACT:
        return (c @ q).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(q, row)) for row in c]
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in big], np.int64)


def best_of_block(q_ids, q, least, c_ids, c, k: int, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """query_id, vec_id and score of each query's k best in a block; and how many products were computed in full.

    least: a score for each query that a result must reach (-inf: none).
    """
    head = min(HEAD, c.shape[1])
    norm_c = np.sqrt((c**2).sum(1))
    order = np.lexsort((c_ids, -norm_c))
    c_ids, c, norm_c = c_ids[order], c[order], norm_c[order]
    rc, rq = c @ rotation, q @ rotation
    rest_c = np.sqrt(np.maximum(0, (rc[:, head:] ** 2).sum(1)))
    rest_q = np.sqrt(np.maximum(0, (rq[:, head:] ** 2).sum(1)))
    norm_q = np.sqrt((q**2).sum(1))
    out, full = [], 0
    for i in range(len(q)):
        slack = 1e-9 * norm_q[i] * (norm_c[0] if len(norm_c) else 0) + 1e-6
        floor = least[i]
        # longest first, in growing steps: the k-th score so far rises and cuts the rest
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, 256
        while at < len(c) and norm_c[at] * norm_q[i] + slack >= floor:
            part = slice(at, at + step)
            bound = rc[part, :head] @ rq[i, :head] + rest_c[part] * rest_q[i] + slack
            near = np.flatnonzero((bound >= floor) & (c_ids[part] != q_ids[i])) + at
            full += len(near)
            ids = np.concatenate([ids, c_ids[near]])
            scores = np.concatenate([scores, exact(q[i], c[near])])
            if len(ids) > k:
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
                floor = max(floor, float(scores[-1]))
            at, step = at + step, step * 2
        out.append((np.full(len(ids), q_ids[i], np.int64), ids, scores))
    if not out:
        e = np.empty(0, np.int64)
        return e, e, e, full
    return *(np.concatenate(x) for x in zip(*out)), full


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query with all other rows."""
    rows = staged(integer_vectors(vectors, id_col, vector_col, scale).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    asked = staged(integer_vectors(queries, id_col, vector_col, scale).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "queries")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n_q = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not shape["n"] or not n_q["n"]:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = max(1, shape["dim"] or 0, n_q["dim"] or 0)
    rotation = vectors.sparkSession.sparkContext.broadcast(basis(rows, dim))  # dim x dim

    n_blocks, n_asked = min(BANDS, ceil(shape["n"] / VECTOR_BLOCK)), ceil(n_q["n"] / QUERY_BLOCK)
    # bands of about equal shares of the rows, longest first; a band is cut into blocks by id
    edges = rows.agg(F.percentile_approx("norm", F.array(*(F.lit(1 - b / n_blocks) for b in range(1, n_blocks))), 10_000).alias("e")).first()["e"] if n_blocks > 1 else []
    block = F.lit(0)
    for e in edges:
        block = block + F.when(F.col("norm") < e, 1).otherwise(0)
    rows = staged(rows.withColumn("b", block).withColumn("u", F.monotonically_increasing_id()), "blocks")  # a number of each row: ids may repeat
    sizes = rows.groupBy("b").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()  # a row a band
    cuts = {r["b"]: ceil(r["n"] / VECTOR_BLOCK) for r in sizes}
    asked = asked.withColumn("a", F.pmod(F.xxhash64("vec_id"), F.lit(n_asked)).cast("int"))

    best_first = min(cuts)
    head = rows.where(F.col("b") == best_first).orderBy(F.desc("norm"), "vec_id").limit(VECTOR_BLOCK).select("vec_id", "v")
    start = _visit(asked.withColumn("least", F.lit(float("-inf"))).withColumn("b", F.lit(0)).withColumn("c", F.lit(0)), head.withColumn("b", F.lit(0)).withColumn("c", F.lit(0)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))), k, dim, rotation)
    start = staged(start, "start")
    reached = start.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(float("-inf")).alias("least"))
    asked = staged(asked.join(reached, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "asked")

    blocks = vectors.sparkSession.createDataFrame([(int(r["b"]), float(r["longest"]), cuts[r["b"]]) for r in sizes], "b int, longest double, cuts int")
    reach = asked.withColumn("b", F.explode(F.array(*(F.lit(int(r["b"])) for r in sizes)))).join(F.broadcast(blocks), "b")  # a row a band
    reach = reach.where(F.col("norm") * F.col("longest") * (1 + 1e-9) + 1e-3 >= F.col("least")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    needed = staged(reach.select("a", "b", "c").distinct(), "needed")
    dealt = rows.join(F.broadcast(blocks), "b").withColumn("c", F.pmod(F.xxhash64("u"), F.col("cuts")).cast("int"))
    visited = dealt.join(needed, ["b", "c"]).select("vec_id", "v", "a", "b", "c")
    found = _visit(reach.select("vec_id", "v", "least", "a", "b", "c"), visited, k, dim, rotation)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _visit(asked: DataFrame, rows: DataFrame, k: int, dim: int, rotation) -> DataFrame:
    """query_id, vec_id, score of the k best rows of each query in each pair of blocks (a, b, c)."""

    def pair(l: pa.Table, r: pa.Table) -> pa.Table:
        e = np.empty(0, np.int64)
        q, v, s = e, e, e
        if l.num_rows and r.num_rows:
            order = np.argsort(l.column("vec_id").to_numpy(), kind="stable")
            ids, m, least = l.column("vec_id").to_numpy()[order], _matrix(l.column("v"), dim)[order], l.column("least").to_numpy()[order]
            q, v, s, _ = best_of_block(ids, m, least, r.column("vec_id").to_numpy(), _matrix(r.column("v"), dim), k, rotation.value)
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    by = ["a", "b", "c"]
    return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(pair, "query_id long, vec_id long, score long")
