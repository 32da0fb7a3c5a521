"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

A fingerprint is a run of bytes; two fingerprints that differ in at most ``d`` bits share at least
``n_bytes - d`` of their bytes at equal positions. The index posts every fingerprint under groups
of positional bytes, pairs are tallied by the positional bytes they share, those that reach the
guaranteed minimum stay, and the number of differing bits decides.

A posting list of one single byte would hold 1/256 of all fingerprints, and tallying over it grows
with the square of the corpus. The lists here are therefore intersections of single-byte lists:
with at most two differing bytes of eight, at least two of the four byte pairs agree, so each
fingerprint is posted under its six choices of two byte pairs (four positional bytes, 32 bits). Within such a list
the other four positional bytes are posted one by one and tallied.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, picked, rows_of, slices, write_shared

#: Lists of up to so many fingerprints are compared pair by pair; longer ones go another, equally exact way.
PAIRWISE = 64


def shingle_digests(text: str, words: int, seed: int = 42) -> list[bytes]:
    """XXH64 digests of the word shingles of a text, lower-cased in A-Z and split at ASCII white space."""
    parts = text.encode("utf-8").lower().split()
    n = len(parts)
    digest = xxhash.xxh64_digest
    if n <= words:
        return [digest(b" ".join(parts), seed)] if n else []
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=n)
    ends = np.cumsum(sizes) + np.arange(n)
    first, last = (ends - sizes)[: n - words + 1].tolist(), ends[words - 1 :].tolist()
    return [digest(joined[a:b], seed) for a, b in zip(first, last)]


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes in ``h`` (uint64), the bits set in over half of them; 0 for no hash.

    Eight byte-wide counters are added at once in a uint64, over segments of at most 255 hashes.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    c = counts[some]
    start = np.cumsum(c) - c
    segs = -(-c // 255)
    at = np.repeat(np.cumsum(segs) - segs, segs)
    seg_start = np.repeat(start, segs) + 255 * (np.arange(segs.sum()) - at)
    doc_start = np.cumsum(segs) - segs
    fp = np.zeros(len(some), dtype=np.uint64)
    mask = np.uint64(0x0101010101010101)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & mask, seg_start)
        per = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), doc_start, axis=0)
        for j in range(8):
            fp |= (2 * per[:, j] > c).astype(np.uint64) << np.uint64(8 * j + k)
    out[some] = fp
    return out


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprint_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = [shingle_digests(t, words) for t in texts]
            h = np.frombuffer(b"".join(d for f in found for d in f), dtype=">u8").astype(np.uint64)
            fp = majority(h, np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            yield rows_of(_FP, doc_id=part.column("doc_id"), fp=fp.view(np.int64))

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row: the 64-bit SimHash of all its word shingles, repeats included."""
    return picked(docs, doc_id="long", text="string").mapInArrow(_fingerprint_task(words), "doc_id long, fp long")


def _group(fp: str, g: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * g).bitwiseAND(0xFFFF)


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """``(u, v)``, ``u < v``: links between the distinct fingerprints ``fps(fp)`` at ``distance`` (2 or less) bits or fewer.

    In a short posting list, where four positional bytes agree, the other four are posted too; pairs are tallied by these
    postings and stay from the guaranteed ``4 - distance`` on. In a long list the other 32 bits differ in at most
    ``distance`` places, so its members are posted again under those 32 bits and under each with one bit
    flipped; whoever shares such a list (33 members at most) is within two bits of the others, and two
    members within two bits share one. There the smallest member is linked to the others, which keeps
    the components; for ``distance`` below 2 all pairs of such a list are compared.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the byte-pair index guarantees distances up to 2")
    choices = list(combinations(range(4), 2))
    key = F.array(*(F.lit(s << 32).bitwiseOR(F.shiftleft(_group("fp", a), 16)).bitwiseOR(_group("fp", b)) for s, (a, b) in enumerate(choices)))
    posted = fps.select("fp", F.explode(key).alias("key"))
    slot = F.shiftright("key", 32)
    sizes = write_shared(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-lists")
    short = write_shared(posted.join(sizes.where(F.col("n") <= PAIRWISE), "key").select("key", "fp"), "simhash-short")
    left = F.array(*(F.when(slot == s, F.array(*(F.lit(i << 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(0xFF)) for g in range(4) if g not in pair for i in (2 * g, 2 * g + 1)))) for s, pair in enumerate(choices)))
    bytes_ = short.select("key", "fp", F.explode(F.element_at(F.filter(left, lambda x: x.isNotNull()), 1)).alias("byte"))
    shared = bytes_.select("key", "byte", F.col("fp").alias("u")).join(bytes_.select("key", "byte", F.col("fp").alias("v")), ["key", "byte"]).where("u < v")
    pairs = shared.groupBy("key", "u", "v").agg(F.count("*").alias("tally")).where(F.col("tally") >= 4 - distance)
    long = posted.join(sizes.where(F.col("n") > PAIRWISE), "key").select("key", "fp")
    rest = F.lit(None).cast("long")
    for s, pair in enumerate(choices):
        c, d = (g for g in range(4) if g not in pair)
        rest = F.when(slot == s, F.shiftleft(_group("fp", c), 16).bitwiseOR(_group("fp", d))).otherwise(rest)
    flipped = F.array(rest, *(rest.bitwiseXOR(F.lit(1 << i)) for i in range(32)))
    near = long.select("key", "fp", F.explode(flipped).alias("sub")).groupBy("key", "sub").agg(F.collect_set("fp").alias("m")).where("size(m) > 1")
    if distance == 2:
        star = near.select(F.array_min("m").alias("u"), F.explode("m").alias("v"))
    else:
        star = near.select(F.explode("m").alias("u"), "m").select("u", F.explode("m").alias("v"))
    return pairs.select("u", "v").unionByName(star.where("u < v")).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).distinct()


def components(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Rows whose fingerprints are within ``distance`` bits are linked, and a component is named after its
    smallest doc_id. A null text counts as one without words, whose fingerprint is zero and links like any
    other; a text of fewer words than a shingle is one shingle. Rows with a null doc_id are kept and take
    part; a component of such rows alone has a null name. Repeated rows and ids stay; an empty table gives
    no rows; columns other than doc_id and text are not read.
    """
    rows = write_shared(fingerprints(docs, words), "simhash-fp")
    nodes = write_shared(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    roots = write_shared(connected_components(links(nodes.select("fp"), distance)), "simhash-roots")
    named = write_shared(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-named")
    names = write_shared(named.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-names")
    of = write_shared(named.join(names, "root").select("fp", "component_id"), "simhash-of")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")
