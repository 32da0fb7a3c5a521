"""Removal of lines that many documents repeat, by perfect hashing.

A line's key is hashed to 128 bits. Keys are counted by document, and those of enough documents go into shards; a shard is a
minimal perfect hash with three arrays: fingerprints, counts and the largest document. Documents send the hashes of
their lines to the shards and get the repeated ones back. Keys that hold more than a ``SHARE`` of all postings, which can be
few, are a shard of their own that goes to every task, so no shard meets a hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import picked, rows_of, slices, write_shared

BLANKS = b" \t\n\x0b\x0c\r"
#: Slots of a level for each key that is left.
GAMMA = 2.0
#: A key with more than this share of all postings is hot; there can't be more hot keys than ``1 / SHARE``.
SHARE = 1 / (1 << 16)
#: Keys and postings of a shard, about.
SHARD_KEYS, SHARD_POSTS = 8192, 16384


def line_keys(texts: list[bytes], least: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """The lines of each text, and of those whose key has ``least`` code points: text, place and the hash's two halves."""
    lines, doc, at, digests = [], [], [], []
    for i, text in enumerate(texts):
        lines.append(parts := text.split(b"\n"))
        for j, part in enumerate(parts):
            key = part.strip(BLANKS)
            if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                doc.append(i)
                at.append(j)
                digests.append(xxhash.xxh3_128_digest(key.lower()))  # of bytes: A-Z only
    return lines, np.array(doc, dtype=np.int64), np.array(at, dtype=np.int64), np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


def _places(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
    h, f = keys[:, 0].astype(np.uint64), keys[:, 1].astype(np.uint64)
    x = (h ^ (f * np.uint64(0x9E3779B97F4A7C15))) + np.uint64((level * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) + f
    return ((x ^ (x >> np.uint64(31))) % np.uint64(slots)).astype(np.int64)


@dataclass
class PerfectHash:
    """Places 0 to n - 1 for n distinct keys, without the keys.

    A level is a bitmap: a key that is alone in its slot has its place there, by the rank of the slot's bit; the others go on to
    the next level.
    """

    slots: list[int]
    bits: bytes

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        slots, bits, left = [], [], np.arange(len(keys))
        while len(left):
            slots.append(max(8, math.ceil(GAMMA * len(left) / 8) * 8))
            at = _places(keys[left], len(slots), slots[-1])
            alone = np.bincount(at, minlength=slots[-1]) == 1
            bits.append(np.packbits(alone))
            left = left[~alone[at]]
        return PerfectHash(slots, b"".join(x.tobytes() for x in bits))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; for others some place, or -1."""
        held = np.unpackbits(np.frombuffer(self.bits, dtype=np.uint8)).astype(bool)
        rank = np.cumsum(held) - 1
        out, left, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
        for level, slots in enumerate(self.slots, 1):
            at = base + _places(keys[left], level, slots)
            here = held[at]
            out[left[here]] = rank[at[here]]
            left, base = left[~here], base + slots
        return out


@dataclass
class LineShard:
    """What is known of a shard's keys, by their places: fingerprints, counts of documents, and the largest ids."""

    perfect: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    last: np.ndarray

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineShard:
        perfect = PerfectHash.build(keys)
        order = np.argsort(perfect.find(keys))
        return LineShard(perfect, keys[order, 1], counts[order], last[order])

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key that the shard holds, else -1."""
        at = self.perfect.find(keys)
        if not len(self.fingerprints):
            return at
        return np.where((at >= 0) & (self.fingerprints[np.maximum(at, 0)] == keys[:, 1]), at, -1)


_POST = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("f", pa.int64())])


def _bytes(texts: list) -> list[bytes]:
    return [t or b"" for t in texts]


def _post_task(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            _, doc, _, keys = line_keys(_bytes(texts), least)
            order = np.lexsort((keys[:, 1], keys[:, 0], doc))
            doc, keys = doc[order], keys[order]
            fresh = np.append(True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1]).any(axis=1))[: len(doc)]
            doc, keys = doc[fresh], keys[fresh]
            yield rows_of(_POST, rid=part.column("rid").take(pa.array(doc)), doc_id=part.column("doc_id").take(pa.array(doc)), h=keys[:, 0], f=keys[:, 1])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """``(rid, doc_id, text)``, the texts as bytes; rows of equal ids and texts share a ``rid``, others may do so by chance."""
    slim = picked(docs, doc_id="long", text="string")
    return slim.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _posts(rows: DataFrame, least: int) -> DataFrame:
    """``(rid, doc_id, h, f)``: each distinct key of a document."""
    return rows.mapInArrow(_post_task(least), "rid long, doc_id long, h long, f long")


_SHARD = pa.schema([("shard", pa.int64()), ("slots", pa.list_(pa.int64())), ("bits", pa.binary()), ("fingerprints", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])
#: Stands for a missing id, below all ids that could be the largest.
NO_ID = np.iinfo(np.int64).min


def _columns(table: pa.Table, *names: str) -> np.ndarray:
    return np.stack([table.column(n).to_numpy() for n in names], axis=1)


def _build_task(table: pa.Table) -> pa.Table:
    made = LineShard.build(_columns(table, "h", "f"), table.column("n").to_numpy(), table.column("last").to_numpy())
    return pa.Table.from_batches([rows_of(_SHARD, shard=table.column("shard")[:1].to_pylist(), slots=[made.perfect.slots], bits=[made.perfect.bits], fingerprints=[made.fingerprints], counts=[made.counts], last=[made.last])])


def _shard_of(table: pa.Table) -> LineShard | None:
    if not table.num_rows:
        return None
    row = table.slice(0, 1)
    array = lambda name: row.column(name).combine_chunks().flatten().to_numpy()
    return LineShard(PerfectHash(array("slots").tolist(), row.column("bits")[0].as_py()), array("fingerprints"), array("counts"), array("last"))


_HIT = pa.schema([("rid", pa.int64()), ("h", pa.int64()), ("f", pa.int64()), ("last", pa.int64())])


def _probe_task(posts: pa.Table, shard: pa.Table) -> pa.Table:
    held = _shard_of(shard)
    keys = _columns(posts, "h", "f")
    at = held.probe(keys) if held else np.full(len(keys), -1)
    hit = at >= 0
    last = held.last[at[hit]] if held else np.zeros(0, dtype=np.int64)
    return pa.Table.from_batches([rows_of(_HIT, rid=posts.column("rid").to_numpy()[hit], h=keys[hit, 0], f=keys[hit, 1], last=last)])


@dataclass
class LineIndex:
    """The repeated lines of a corpus: ``table`` has a row for each of ``shards`` shards, ``hot`` holds the hot keys."""

    table: DataFrame
    shards: int
    hot: LineShard
    min_chars: int

    def shard(self) -> F.Column:
        return F.pmod(F.col("h"), F.lit(self.shards))


def index(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> LineIndex:
    """The keys of at least ``min_chars`` code points found in at least ``min_docs`` rows of ``docs(doc_id, text)``.

    Keys of fewer documents decide nothing and are not indexed. Keys are told apart by 128 bits: 64 give the shard, all of
    them the place, and the other 64 are the fingerprint that a probe is compared with.
    """
    seen = Observation()
    rows = _rows(docs)
    posts = _posts(rows, min_chars).observe(seen, F.count(F.lit(1)).alias("posts"))
    counted = posts.groupBy("h", "f").agg(F.count("*").alias("n"), F.coalesce(F.max("doc_id"), F.lit(int(NO_ID))).alias("last")).where(F.col("n") >= min_docs)
    keys = write_shared(counted, "line-keys")
    n_posts = 0 if rows.isEmpty() else seen.get["posts"]  # a plan over nothing observes nothing
    bound = n_posts * SHARE
    hot = keys.where(F.col("n") > bound).toArrow()  # fewer than 1 / SHARE rows
    made = LineShard.build(_columns(hot, "h", "f"), hot.column("n").to_numpy(), hot.column("last").to_numpy())
    shards = max(1, -(-n_posts // SHARD_POSTS), -(-keys.count() // SHARD_KEYS))
    out = LineIndex(keys, shards, made, min_chars)
    built = keys.where(F.col("n") <= bound).withColumn("shard", out.shard()).groupBy("shard").applyInArrow(_build_task, "shard long, slots array<long>, bits binary, fingerprints array<long>, counts array<long>, last array<long>")
    out.table = write_shared(built, "line-index")
    return out


def _cold_task(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = held.value.probe(np.stack([batch.column(n).to_numpy() for n in ("h", "f")], axis=1))
                yield batch.filter(pa.array(at < 0))

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def _drop_task(held, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = held.value
        for part, texts in slices(batches):
            lines, doc, at, keys = line_keys(_bytes(texts), least)
            own = np.array([NO_ID if x is None else x for x in part.column("doc_id").to_pylist()], dtype=np.int64)
            place = hot.probe(keys)
            drop = place >= 0
            drop[drop] = hot.last[place[drop]] != own[doc[drop]]
            answers = part.column("hits").to_pylist()
            asked = np.flatnonzero(np.array([bool(a) for a in answers])[doc]) if len(doc) else doc
            told = {i: {(x["h"], x["f"]): x["last"] for x in answers[i]} for i in set(doc[asked].tolist())}
            for k in asked.tolist():
                last = told[doc[k]].get((int(keys[k, 0]), int(keys[k, 1])))
                drop[k] |= last is not None and last != own[doc[k]]
            gone: list[set] = [set() for _ in texts]
            for i, j in zip(doc[drop].tolist(), at[drop].tolist()):
                gone[i].add(j)
            kept = [b"\n".join(x for j, x in enumerate(own_lines) if j not in g) if g else t for own_lines, g, t in zip(lines, gone, _bytes(texts))]
            yield rows_of(_KEPT, doc_id=part.column("doc_id"), text=kept, n_lines=[len(x) for x in lines], n_dropped=[len(g) for g in gone])

    return run


def drop_lines(docs: DataFrame, lines: LineIndex) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` for every row of ``docs(doc_id, text)``: the texts without repeated lines.

    A line that the index holds stays in the rows of the largest doc_id that has it, all its repetitions there included, and goes
    from all others; a missing id is the smallest, and where no row with the line has an id it stays everywhere. A null or empty text is
    one empty line. Rows that repeat an id are documents of their own when lines are counted. An empty table gives no rows;
    other columns are not read.
    """
    rows = _rows(docs)
    held = docs.sparkSession.sparkContext.broadcast(lines.hot)
    cold = _posts(rows, lines.min_chars).mapInArrow(_cold_task(held), "rid long, doc_id long, h long, f long").select("rid", "h", "f", lines.shard().alias("shard"))
    hits = cold.groupBy("shard").cogroup(lines.table.groupBy("shard")).applyInArrow(_probe_task, "rid long, h long, f long, last long")
    answers = write_shared(hits.groupBy("rid").agg(F.collect_set(F.struct("h", "f", "last")).alias("hits")), "line-hits")
    # The same join at every size: whether answers would fit a broadcast depends on the corpus.
    asked = rows.join(answers.hint("merge"), "rid", "left").select("doc_id", "text", "hits")
    out = asked.mapInArrow(_drop_task(held, lines.min_chars), "doc_id long, text binary, n_lines long, n_dropped long")
    return out.withColumn("text", F.col("text").cast("string"))


#: What ``op12_line_dedup`` gives, for DuckDB.
LINES_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
     k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
