"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over
the counts of all vote patterns estimates how each labeller votes on good and on bad documents, without
any given label; the posteriors of a sample then train a linear scorer on hashed features, which scores
every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, placed, plain, rows_of, slices, write_shared

#: The scorer is fitted on the posteriors of so many documents at most, drawn by a hash.
TRAIN_ROWS = 8192
#: Hashed features: trigrams of byte classes and shapes of words.
FEATURES = 512
NONE, GOOD, BAD = 0, 1, 2

#: Classes of bytes: 0 blank, 1 small letter or part of a longer sign, 2 capital, 3 digit, 4 stop, 5 comma, 6 exclamation, 7 mark used in prose, 8 any other.
_CLASS = np.full(256, 8, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _signs, _c in ((b".?", 4), (b",", 5), (b"!", 6), (b";:'\"-()", 7)):
    _CLASS[list(_signs)] = _c

_MIX = np.random.default_rng(7).integers(1, 2**63, 256 + 64, dtype=np.uint64) | np.uint64(1)
_BYTE, _PLACE = _MIX[:256].copy(), _MIX[256:]
_BYTE[_CLASS == 0] = 0

#: Each labeller: its measure, the range where it votes good, the ranges where it votes bad, the fewest words.
LABELLERS = {
    "repeats": (lambda m: m["repeats"], (0, 0.05), [(0.15, 2)], 3),
    "variety": (lambda m: m["distinct"] / np.maximum(m["words"], 1) ** 0.8, (0.8, 99), [(-1, 0.35)], 20),
    "symbols": (lambda m: m["symbols"] / np.maximum(m["signs"], 1), (0, 0.01), [(0.06, 2)], 3),
    "capitals": (lambda m: m["capitals"] / np.maximum(m["letters"], 1), (0, 0.12), [(0.3, 2)], 5),
    "shouts": (lambda m: m["shouts"] / np.maximum(m["words"], 1), (0, 0.05), [(0.15, 99)], 3),
    "marks": (lambda m: m["lone"] / np.maximum(m["words"], 1), (0, 0.02), [(0.1, 2)], 5),
    "short words": (lambda m: m["short"] / np.maximum(m["words"], 1), (0.1, 0.75), [(-1, 0.02), (0.95, 2)], 20),
    "sentences": (lambda m: m["words"] / np.maximum(m["stops"], 0.5), (1.5, 60), [(150, 1e18)], 20),
}


def measure(texts: list[str], features: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The labellers' measures by document, and the counts of hashed features ``(documents, FEATURES)``."""
    raw = [t.encode("utf-8") for t in texts]
    b = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
    n = len(texts)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=n)
    ends = np.cumsum(sizes + 1) + 1  # each document's bytes with the blank behind them
    c = _CLASS[b]
    blank = c == 0
    start = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    stop = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    doc = np.searchsorted(ends, start, side="right")
    per = lambda of, w=None: np.bincount(of, weights=w, minlength=n)
    m = {"words": per(doc)}
    doc_start = ends - sizes - 1

    def tally(flag: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return run[ends] - run[doc_start]

    m["signs"], m["capitals"], m["shouts"], m["symbols"] = tally(~blank), tally(c == 2), tally(c == 6), tally(c == 8)
    m["letters"] = tally(c == 1) + m["capitals"]
    size = stop - start
    m["short"] = per(doc[size <= 3])
    m["lone"] = per(doc[(size == 1) & (c[start] >= 4)]) if len(start) else per(doc)
    m["stops"] = per(doc[(c[stop - 1] == 4) | (c[stop - 1] == 6)]) if len(start) else per(doc)
    if len(start):
        place = np.arange(len(b), dtype=np.int64)
        place -= np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(b)]])))
        h = np.add.reduceat(_BYTE[b] * _PLACE[np.minimum(place, 63)], start)
        h ^= h >> np.uint64(29)
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        m["repeats"] = per(doc[same]) / np.maximum(m["words"], 1)
        key = np.sort((h & np.uint64((1 << 44) - 1)) | (doc.astype(np.uint64) << np.uint64(44)))
        fresh = np.append(True, key[1:] != key[:-1])
        m["distinct"] = per((key[fresh] >> np.uint64(44)).astype(np.int64))
    else:
        m["repeats"] = m["distinct"] = np.zeros(n)
    counts = np.zeros((n, FEATURES))
    if features and len(start):
        half = FEATURES // 2
        tri = (c[:-2].astype(np.int32) * 81 + c[1:-1].astype(np.int32) * 9 + c[2:]) * 40503 % 65521 % half
        at = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)[: len(tri)]
        counts += np.bincount(at * FEATURES + tri, minlength=n * FEATURES).reshape(n, FEATURES) / np.maximum(m["signs"], 1)[:, None]
        shape = ((np.minimum(size, 15) * 9 + c[start]) * 9 + c[stop - 1]) * 2 + same
        shape = shape * 40503 % 65521 % half + half
        counts += np.bincount(doc * FEATURES + shape, minlength=n * FEATURES).reshape(n, FEATURES) / np.maximum(m["words"], 1)[:, None]
    return m, np.sqrt(counts)


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """The votes as one number in base 3, the first labeller's last."""
    code = np.zeros(len(m["words"]), dtype=np.int64)
    for i, (of, good, bad, least) in enumerate(LABELLERS.values()):
        x = of(m)
        v = np.where((x >= good[0]) & (x <= good[1]), GOOD, NONE)
        for lo, hi in bad:
            v = np.where((x > lo) & (x < hi), BAD, v)
        code += np.where(m["words"] >= least, v, NONE) * 3**i
    return code


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation with two classes and labellers that are independent within a class.

    A labeller that gives no vote says nothing: whether it can vote depends on the length of the text.
    ``patterns`` are distinct vote codes with their ``counts``. It starts from the belief that a document with
    a bad vote is likely bad, which also tells the two classes apart. Returns the posterior of good by pattern, the
    table ``[labeller, class, vote]`` and the share of good documents.
    """
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = np.where((v == BAD).any(axis=1), 0.1, np.where((v == GOOD).any(axis=1), 0.95, 0.5))
    table, share = np.ones((len(LABELLERS), 2, 3)), 0.5
    for _ in range(rounds):
        w = np.stack([counts * (1 - good), counts * good])
        share = float((w[1].sum() + 1) / (w.sum() + 2))
        for j in (GOOD, BAD):
            table[:, :, j] = (w @ (v == j)).T + 0.5
        table[:, :, GOOD:] /= table[:, :, GOOD:].sum(axis=2, keepdims=True)
        log = np.stack([np.log(table[np.arange(len(LABELLERS)), y, v]).sum(axis=1) for y in (0, 1)])
        log += np.log([[1 - share], [share]])
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return good, table, share


def fit_scorer(x: np.ndarray, good: np.ndarray, ridge: float = 1e-2, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the constant last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge * max(1, len(x)) / 100)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (good - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class QualityModel:
    patterns: np.ndarray
    posterior: np.ndarray
    table: np.ndarray
    weights: np.ndarray


_VOTE = pa.schema([("votes", pa.int64()), ("order", pa.int64()), ("features", pa.binary())])


def _vote_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        drawn = part.column("drawn").to_numpy(zero_copy_only=False).astype(bool)
        m, x = measure(texts, features=bool(drawn.any()))
        yield rows_of(_VOTE, votes=votes(m), order=part.column("order"), features=[x[i].astype("<f4").tobytes() if d else None for i, d in enumerate(drawn.tolist())])


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fits the labellers on the votes over all documents, and the scorer on ``train_rows`` of them at most."""
    n = docs.count()
    text = picked(docs, doc_id="string", text="string").select("text", F.xxhash64("doc_id", "text").alias("order"))
    share = min(1.0, 1.1 * train_rows / max(1, n))
    marked = text.withColumn("drawn", F.pmod("order", F.lit(1 << 30)) < int(share * (1 << 30)))
    voted = write_shared(marked.mapInArrow(_vote_task, "votes long, order long, features binary"), "quality-votes")
    seen = voted.groupBy("votes").agg(F.count("*").alias("n")).toPandas().sort_values("votes")  # at most 3 ** len(LABELLERS) rows
    patterns = seen["votes"].to_numpy(dtype=np.int64)
    posterior, table, _ = fit_labellers(patterns, seen["n"].to_numpy(dtype=np.float64))
    rows = voted.where("features is not null").orderBy("order", "votes").limit(train_rows).select("votes", "features").collect()
    if rows:
        x = np.stack([np.frombuffer(r["features"], "<f4") for r in rows]).astype(np.float64)
        weights = fit_scorer(x, posterior[np.searchsorted(patterns, [r["votes"] for r in rows])])
    else:
        weights = np.zeros(FEATURES + 1)
    return QualityModel(patterns, posterior, table, weights)


ADDED = ("quality", "weak_good", "keep")


def _score_task(held, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part, texts in slices(batches, text="_text"):
            m, x = measure(texts)
            score = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -500, 500)))
            score[m["words"] == 0] = 0.0
            code = votes(m)
            if len(model.patterns):
                at = np.minimum(np.searchsorted(model.patterns, code), len(model.patterns) - 1)
                weak = np.where(model.patterns[at] == code, model.posterior[at], 0.5)
            else:
                weak = np.full(len(code), 0.5)
            yield rows_of(schema, **{f.name: part.column(f.name) for f in schema if f.name not in ADDED}, quality=score, weak_good=weak, keep=score >= 0.5)

    return run


def _scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``plain(docs)`` with the three columns of ``score``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rest = plain(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = StructType([*rest.schema.fields]).add("quality", "double").add("weak_good", "double").add("keep", "boolean")
    return rest.withColumn("_text", placed(docs, "text").cast("string")).mapInArrow(_score_task(held, to_arrow_schema(out)), out)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The columns of ``docs`` with ``quality`` (0 to 1), ``weak_good`` (the labellers' posterior) and ``keep`` (quality of 0.5 or more).

    A text that is null, empty or blank has quality 0 and is not kept. Repeated rows and null ids stay; an
    empty table gives no rows; columns of ``docs`` with those three names are replaced.
    """
    scored = _scored(docs, model).select(*(f"c{i}" for i, c in enumerate(docs.columns) if c not in ADDED), *ADDED)
    return scored.toDF(*(c for c in docs.columns if c not in ADDED), *ADDED)


def keep_good(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all columns, whatever their names."""
    return _scored(docs, train(docs, train_rows)).where("keep").drop(*ADDED).toDF(*docs.columns)


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, train(docs, train_rows))
