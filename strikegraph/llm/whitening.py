"""Whitening of embeddings by their leading components.

Components are quantised to integers, so sums are exact and every row is centred exactly: ``n * x - S`` is an integer. The
covariance is MLlib's Gramian of the centred distinct vectors, computed by Spark and ``dim`` by ``dim`` in size; its
eigenvectors are found on the driver and go out with the sums as a broadcast that only depends on the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, write_shared

SCALE = 256
#: Integers below this add up in 64 bits without overflow; larger ones go through Python's integers.
SAFE = 1 << 62


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, x array<long>)``: ``floor(scale * c)`` of every entry, as a written table of one length of vectors.

    Vectors that are null or empty or hold a null, NaN or infinite entry are left out; null and repeated ids stay. Of vectors of
    several lengths those of the most frequent one stay (ties: the longest), since a covariance has one dimension.
    """
    rows = picked(vectors, **{id_col: "long", vector_col: "array<double>"}).toDF("vec_id", "c")
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("c", lambda c: F.floor(c * scale).cast("long"))
    kept = write_shared(rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & finite).select("vec_id", x.alias("x")), "whitening-vectors")
    sizes = kept.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(2).collect()
    return kept if len(sizes) < 2 else kept.where(F.size("x") == sizes[0]["dim"])


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def most(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns, exact at any size."""
    return [int(s) for s in (x if most(x) * len(x) < SAFE else x.astype(object)).sum(axis=0)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: in 64 bits where they suffice, else as Python's integers."""
    if n * most(x) + max(map(abs, sums), default=0) < SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(d: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row of integers; None if it does not fit in 64 bits."""
    if d.dtype != object and most(d) ** 2 * d.shape[1] < SAFE:
        return (d * d).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in d)]


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            part = exact_sums(matrix(batch.column("x"), batch.num_rows))
            total, n = part if total is None else [a + b for a, b in zip(total, part)], n + batch.num_rows
    if n:
        yield pa.record_batch({"sums": pa.array([[str(s) for s in [n, *total]]], pa.list_(pa.string()))})


def _centre_task(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = (centred(matrix(batch.column("x"), batch.num_rows), n, sums) / n).astype(np.float64)
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.record_batch({"v": pa.ListArray.from_arrays(ends, pa.array(v.ravel()))})

    return run


@dataclass
class Whitening:
    """``n`` distinct vectors with sums ``sums``; ``axes`` are unit eigenvectors over the root of their eigenvalue, as columns."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, d: np.ndarray) -> np.ndarray:
        return (d / self.n).astype(np.float64) @ self.axes


def fit(x: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of the distinct vectors of ``x(x)``, every covariance with divisor ``n``; None for an empty table.

    Components are numbered by falling eigenvalue; those whose eigenvalue is zero but for rounding are left out, so that
    equal vectors only have none. ``identity_error`` is measured on the distinct vectors.
    """
    once = write_shared(x.select("x").distinct(), "whitening-fit")
    sums = once.mapInArrow(_sum_task, "sums array<string>").select(F.posexplode("sums").alias("at", "s"))
    rows = sums.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()  # a row a dimension
    if not rows:
        return None
    n, *total = (int(r["s"]) for r in rows)
    v = once.mapInArrow(_centre_task(n, total), "v array<double>").select(array_to_vector("v").alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(v, "v"), n, len(total)).computeGramianMatrix().toArray()
    covariance = (gram + gram.T) / (2 * n)
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > max(e[0], 0.0) * len(e) * np.finfo(float).eps).sum()))
    found = Whitening(n, total, u[:, :k] / np.sqrt(e[:k]), e[:k] / max(covariance.trace(), np.finfo(float).tiny))
    if k:
        held = x.sparkSession.sparkContext.broadcast(found)
        w = once.mapInPandas(_project_task(held), ", ".join(f"w{i} double" for i in range(k)))
        parts = {(i, j): F.abs(F.covar_pop(f"w{i}", f"w{j}") - float(i == j)) for i in range(k) for j in range(i, k)}
        found.identity_error = max(w.agg(*(c.alias(f"e{i}_{j}") for (i, j), c in parts.items())).first())
    return found


def _stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["x"].to_numpy()).astype(np.int64)


def _project_task(held):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for frame in frames:
            if len(frame):
                w = model.project(centred(_stacked(frame), model.n, model.sums))
                yield pd.DataFrame(w, columns=[f"w{i}" for i in range(w.shape[1])])

    return run


def _whiten_task(held):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        k = model.axes.shape[1]
        for frame in frames:
            if len(frame) and k:
                d = centred(_stacked(frame), model.n, model.sums)
                yield pd.DataFrame(
                    {
                        "vec_id": frame["vec_id"].repeat(k).reset_index(drop=True),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(frame)),
                        "n": np.full(len(frame) * k, model.n),
                        "deviation": pd.array(deviations(d), dtype="Int64").repeat(k),
                        "whitened": model.project(d).ravel(),
                        "explained": np.tile(model.explained, len(frame)),
                        "identity_error": np.full(len(frame) * k, model.identity_error),
                    }
                )

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Vectors that ``quantize`` leaves out have no row. Every other row is whitened, also those that repeat an id or a vector and
    those without an id; each distinct vector counts once in the fit. ``deviation`` is null where it does not fit in a long.
    A table that is empty or holds one distinct vector only gives no rows. Other columns are not read.
    """
    x = quantize(vectors, id_col, vector_col)
    model = fit(x, components)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return x.sparkSession.createDataFrame([], out)
    held = x.sparkSession.sparkContext.broadcast(model)
    return x.select(F.col("vec_id"), "x").mapInPandas(_whiten_task(held), out)
