"""Exact top-k search by inner product: tiles of queries times shards, partial lists, a merge tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, write_shared

#: Rows of a tile's two sides, and queries scored at once. With 64 components a tile's operands take 25 MB, a block of scores 32 MB.
SHARD, BLOCK, STRIP = 16384, 32768, 256
#: Partial lists that one merge step joins.
FAN_IN = 32


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, row, v array<long>)``: ``floor(scale * x)`` of every component; a written table with a number for each row.

    Rows without an id or a vector, and vectors with a null, NaN or infinite component, are left out. Rows that
    repeat an id stay, each with a number of its own.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col)).where(F.col("vec_id").isNotNull() & F.col(vector_col).isNotNull() & finite)
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return write_shared(numbered(rows.select("vec_id", v.alias("v")), "row"), "topk-vectors")


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: by floating point where every sum stays below 2**53, else by integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller places; the places ``own`` are left out."""
    other = np.delete(np.arange(len(scores)), own)
    s = scores[other]
    if len(s) > k:
        bound = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > bound)
        level = np.flatnonzero(s == bound)[: k - len(above)]
        keep = np.concatenate([above, level])
    else:
        keep = np.arange(len(s))
    return other[keep[np.lexsort((keep, -s[keep]))]]


def _tile_task(k: int):
    def run(key, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query_row": [], "vec_id": [], "row": [], "score": []}
        if len(queries) and len(shard):
            shard = shard.sort_values(["vec_id", "row"])
            c, ids, rows = np.stack(shard["v"].to_numpy()).astype(np.int64), shard["vec_id"].to_numpy(), shard["row"].to_numpy()
            place = {r: i for i, r in enumerate(rows.tolist())}
            for a in range(0, len(queries), STRIP):
                part = queries.iloc[a : a + STRIP]
                scores = _scores(np.stack(part["v"].to_numpy()).astype(np.int64), c)
                for line, query, own in zip(scores, part["vec_id"].to_numpy(), part["row"].to_numpy()):
                    best = _best(line, [place[own]] if own in place else [], k)
                    for name, x in (("query_id", np.full(len(best), query)), ("query_row", np.full(len(best), own)), ("vec_id", ids[best]), ("row", rows[best]), ("score", line[best])):
                        out[name].append(x)
        frame = pd.DataFrame({n: np.concatenate(x) if x else np.array([], dtype=np.int64) for n, x in out.items()})
        return frame.assign(shard=np.int32(key[0]))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` rows of the highest inner product.

    ``vectors(vec_id, row, v)`` comes from :func:`quantize` and ``queries`` are some of its rows. A query's own row is no
    candidate, other rows with its id are; queries that repeat an id give a list each under that id. Ties go to the
    smaller id; only vectors of the query's length are compared, an empty one with none. Fewer candidates
    give fewer rows, none gives no row. Scores are exact while they fit in 64 bits.

    Rows are dealt by a hash of their number into shards of about ``SHARD`` and queries into blocks of about
    ``BLOCK``; a tile is one shard with one block, and each tile returns its ``k`` best for each query.
    """
    w = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    queries = write_shared(queries, "topk-queries")
    shards, blocks = max(1, -(-vectors.count() // SHARD)), max(1, -(-queries.count() // BLOCK))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    left = queries.select("vec_id", "row", "v", F.size("v").alias("dim"), deal(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = vectors.select("vec_id", "row", "v", F.size("v").alias("dim"), deal(shards, 2).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    by = ["shard", "block", "dim"]
    lists = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_tile_task(k), "query_id long, query_row long, vec_id long, row long, score long, shard int")
    while shards > FAN_IN:
        lists = lists.withColumn("shard", (F.col("shard") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(w("query_row", "shard"))).where(F.col("rank") <= k).drop("rank")
        shards = -(-shards // FAN_IN)
    return lists.withColumn("rank", F.row_number().over(w("query_row"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, q.row_no AS query_row, c.vec_id, c.row_no, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.row_no <> c.row_no AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row_no) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
