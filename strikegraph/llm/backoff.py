"""Stupid-backoff scores, computed relationally over hashed n-grams.

Documents go in chunks by a hash. A chunk posts each distinct n-gram in it once, with its count, as arrays of one range of
the hash each, so an n-gram takes eight bytes on the way and a frequent one appears once a chunk: no key is hot. Behind the
exchange by range the arrays are exploded to rows, counted by n-gram, and joined to the chunks that posted them; the counts
go back to the chunks, where the words' scores are summed per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, rows_of, write_shared

#: Factor of each step to a shorter context, and the count of a word that was never seen.
BACKOFF, UNSEEN = 0.4, 0.5
#: Bytes of text of a chunk, and of posted n-grams of a range.
CHUNK_BYTES, RANGE_BYTES = 6 << 20, 8 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all words, lower-cased in A-Z and split at ASCII white space, and the number of words of each text."""
    words: list[bytes] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        part = t.encode("utf-8").lower().split()
        words += part
        sizes[i] = len(part)
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64), sizes


def grams(h: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order`` the hash of the n-gram that ends at each word; 0 where the text has no such n-gram."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [_mixed(h) | np.uint64(1)]
    for n in range(1, order):
        g = np.zeros_like(h)
        g[1:] = _mixed(out[-1][:-1] * _A + h[1:] * _B + np.uint64(n)) | np.uint64(1)
        g[place < n] = 0
        out.append(g)
    return out


def _texts(table: pa.Table) -> list[str]:
    return [t or "" for t in table.column("text").to_pylist()]


_POST = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("grams", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
#: A count takes so many bits beside its place in a post.
TOTAL_BITS = 42
#: The row of a chunk that carries its number of words has this range.
WORDS = -1


def _distinct(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, ascending, and how often they occur."""
    keys = np.sort(np.concatenate(of))
    keys = keys[np.searchsorted(keys, 1) :]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.int32)


def _post_task(order: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        """The chunk's distinct n-grams, ascending as unsigned numbers, with their counts, cut by range."""
        chunk = table.column("chunk")[0].as_py()
        h, sizes = word_hashes(_texts(table))
        keys, n = _distinct(grams(h, sizes, order))
        cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], cut, [len(keys)]]).astype(np.int32)
        blocks = pa.record_batch([
            pa.array(np.arange(1 << bits), pa.int32()), pa.array(np.full(1 << bits, chunk), pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64))), pa.ListArray.from_arrays(pa.array(ends), pa.array(n)),
        ], schema=_POST)
        words = rows_of(_POST, range=[WORDS], chunk=[chunk], grams=[[0]], counts=[[len(h)]])
        return pa.Table.from_batches([blocks.filter(pc.greater(pc.list_value_length(blocks.column("grams")), 0)), words])

    return run


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _slim(docs: DataFrame) -> DataFrame:
    return picked(docs, doc_id="long", text="string")


def _bits(size: int, order: int) -> int:
    return max(0, math.ceil(math.log2(max(1, size * order * 0.7 / RANGE_BYTES))))


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, text, chunk)`` dealt by chunk, of about ``CHUNK_BYTES`` each.

    The place of a row in its input takes part, so that equal rows spread; both uses of the result read one exchange.
    """
    chunks = max(1, -(-size // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    return docs.select("doc_id", "text", chunk.alias("chunk")).repartition("chunk")


def posted(rows: DataFrame, order: int, bits: int) -> DataFrame:
    """``(range, chunk, place, gram, n)`` of ``chunked`` rows, dealt by range; the number of a chunk's words under the range ``WORDS``."""
    blocks = rows.groupBy("chunk").applyInArrow(_post_task(order, bits), "range int, chunk int, grams array<long>, counts array<int>")
    each = F.posexplode(F.arrays_zip(F.col("grams").alias("gram"), F.col("counts").alias("n"))).alias("place", "g")
    return blocks.repartition("range").select("range", "chunk", each).select("range", "chunk", "place", "g.gram", "g.n")


def answered(each: DataFrame) -> DataFrame:
    """``(chunk, range, totals)``: the ``total`` of each posted n-gram, in the order in which the chunk posted them."""
    packed = F.shiftleft(F.col("place").cast("long"), TOTAL_BITS).bitwiseOR(F.col("total"))
    lists = each.groupBy("range", "chunk").agg(F.sort_array(F.collect_list(packed)).alias("totals"))
    return lists.select("chunk", "range", F.transform("totals", lambda x: x.bitwiseAND(F.lit((1 << TOTAL_BITS) - 1))).alias("totals"))


@dataclass
class NgramCounts:
    """``table(range, gram, n)``: the count of every n-gram, by ranges of the leading ``bits`` of its hash; ``words``: the corpus size."""

    table: DataFrame
    order: int
    bits: int
    words: int


def count(docs: DataFrame, order: int = 2) -> NgramCounts:
    """Counts all n-grams of 1 to ``order`` words in all of ``docs(text)``; null texts have none."""
    docs = picked(docs, text="string").withColumn("doc_id", F.lit(None).cast("long"))
    size = _bytes(docs)
    bits = _bits(size, order)
    each = posted(chunked(docs, size), order, bits)
    table = write_shared(each.groupBy("range", "gram").agg(F.sum("n").alias("n")), "ngram-counts")
    words = table.where(F.col("range") == WORDS).agg(F.sum("n")).first()[0]
    return NgramCounts(table.where(F.col("range") != WORDS), order, bits, words or 0)


def _placed(of: np.ndarray, doc: np.ndarray, known: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place the total of its n-gram, looked up in ``known``, and its count in its own document; zeros where there is no n-gram."""
    at = np.argsort(of, kind="stable")  # within an n-gram by place, so by document
    g, d = of[at], doc[at]
    new = np.append(True, g[1:] != g[:-1])
    first = np.flatnonzero(new)
    total = np.where(g[first] > 0, totals[np.minimum(np.searchsorted(known, g[first]), len(known) - 1)], 0)
    runs = np.flatnonzero(new | np.append(True, d[1:] != d[:-1]))
    m = np.diff(np.append(runs, len(g)))
    all_, own = np.empty(len(g), dtype=np.int64), np.empty(len(g), dtype=np.int64)
    all_[at] = np.repeat(total, np.diff(np.append(first, len(g))))
    own[at] = np.repeat(np.where(g[runs] > 0, m, 0), m)
    return all_, own


def _score_task(order: int, leave_out: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        h, sizes = word_hashes(_texts(table))
        got = dict(zip(answers.column("range").to_pylist(), answers.column("totals").combine_chunks()))
        words = int(got.pop(WORDS)[0].as_py())
        totals = np.concatenate([got[r].values.to_numpy() for r in sorted(got)]) if got else np.zeros(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        of = grams(h, sizes, order)
        known = _distinct(of)[0]
        n = []
        for g in of:
            all_, own = _placed(g, doc, known, totals) if len(h) else (g.astype(np.int64),) * 2
            n.append(all_ - own if leave_out else all_)
        total = np.maximum(1, words - sizes if leave_out else np.full(len(sizes), words))
        score = np.log(np.maximum(n[0], UNSEEN) / total[doc])
        used = np.ones(len(doc), dtype=np.int64)
        most = np.minimum(np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1, order)
        # From short to long: a longer n-gram with a count replaces the shorter one's score, else it is a backoff step.
        for k in range(1, order):
            before = np.zeros_like(n[k - 1])
            before[1:] = n[k - 1][:-1]
            seen = n[k] > 0
            step = np.where(most > k, math.log(BACKOFF), 0.0)
            score = np.where(seen, np.log(np.maximum(n[k], 1) / np.maximum(before, 1)), score + step)
            used = np.where(seen, k + 1, used)
        per = lambda w: np.bincount(doc, weights=w, minlength=len(sizes))
        return pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), "n_words": pa.array(sizes, pa.int64()), "log_score": pa.array(per(score), pa.float64()), "n_backoff": pa.array(per(used < most).astype(np.int64), pa.int64())})

    return run


def _scored(rows: DataFrame, each: DataFrame, order: int, leave_out: bool) -> DataFrame:
    return rows.groupBy("chunk").cogroup(answered(each).groupBy("chunk")).applyInArrow(_score_task(order, leave_out), "doc_id long, n_words long, log_score double, n_backoff long")


def score(docs: DataFrame, model: NgramCounts, leave_out: bool = False) -> DataFrame:
    """``doc_id, n_words, log_score, n_backoff`` for every row of ``docs(doc_id, text)``.

    ``log_score`` sums the logarithms of the words' scores: the count of the longest n-gram of the model that ends at the
    word over the count of its context, times ``BACKOFF`` for each longer n-gram that the text has there and the
    corpus has not. With ``leave_out`` the document's own n-grams are taken off all counts, for documents that are part of
    the corpus. ``n_backoff`` counts the words that backed off. A null, empty or blank text has no words and score
    0. Repeated rows and null ids stay; an empty table gives no rows; other columns are not read.
    """
    docs = _slim(docs)
    rows = chunked(docs, _bytes(docs))
    asked = posted(rows, model.order, model.bits).drop("n")
    known = model.table.where(F.col("range") != WORDS).withColumnRenamed("n", "total")
    total = F.when(F.col("range") == WORDS, F.lit(model.words)).otherwise(F.coalesce("total", F.lit(0))).cast("long")
    return _scored(rows, asked.join(known, ["range", "gram"], "left").withColumn("total", total), model.order, leave_out)


def score_corpus(docs: DataFrame, order: int = 2) -> DataFrame:
    """``score`` of all of ``docs`` against themselves, each document left out of its own counts.

    The chunks' posts are the count table's rows and the questions to it at once, so they move once.
    """
    docs = _slim(docs)
    size = _bytes(docs)
    rows = chunked(docs, size)
    each = posted(rows, order, _bits(size, order))
    return _scored(rows, each.withColumn("total", F.sum("n").over(Window.partitionBy("range", "gram"))), order, True)


#: The same scores of ``documents`` against themselves, each left out of its own counts, for DuckDB.
SCORE_SQL = r"""
WITH w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i
           FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents)),
     g AS (SELECT a.doc_id, a.i, a.w, b.w AS v FROM w a LEFT JOIN w b ON a.doc_id = b.doc_id AND a.i = b.i + 1),
     c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w), d1 AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY doc_id, w),
     c2 AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w),
     d2 AS (SELECT doc_id, v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY doc_id, v, w),
     size AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), total AS (SELECT count(*) AS n FROM w),
     s AS (SELECT g.doc_id, g.v, c2.n - d2.n AS n2, cv.n - dv.n AS nv, c1.n - d1.n AS n1, greatest(1, total.n - size.n) AS t
           FROM g JOIN c1 USING (w) JOIN d1 ON d1.doc_id = g.doc_id AND d1.w = g.w JOIN size ON size.doc_id = g.doc_id CROSS JOIN total
           LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN d2 ON d2.doc_id = g.doc_id AND d2.v = g.v AND d2.w = g.w
           LEFT JOIN c1 cv ON cv.w = g.v LEFT JOIN d1 dv ON dv.doc_id = g.doc_id AND dv.w = g.v),
     x AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE v IS NOT NULL AND n2 = 0) AS n_backoff,
                  sum(CASE WHEN n2 > 0 THEN ln(n2 / nv) ELSE ln(greatest(n1, 0.5) / t) + CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END END) AS s
           FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(s, 0), 4) + 0.0 AS log_score, coalesce(n_backoff, 0)::BIGINT AS n_backoff
FROM documents d LEFT JOIN x USING (doc_id)
"""
