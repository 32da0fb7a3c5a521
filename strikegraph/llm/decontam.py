"""Benchmark decontamination by pigeonhole edit matching.

With a budget of ``k`` edits an item is cut into ``k + 1`` pieces, so an occurrence within the budget holds one piece
unchanged. An automaton finds all pieces in one pass over a text. A hit is verified outwards: the pieces form a
binary tree in which a node of ``p`` pieces has the budget ``p - 1``, and an occurrence within the budget stays
within it along a whole path from some unchanged piece to the root, so chance hits end after a few characters.
Distances come from Myers' bit-parallel recurrence, with an item's rows in one long integer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, plain, rows_of, slices

#: Edits allowed for each character of an item.
ERROR_RATE = 0.1
#: Items of fewer characters must occur unchanged, as whole words.
SHORT = 20
#: Characters of items that one pass broadcasts; more items take more passes.
PASS_CHARS = 4_000_000


def normal(text: str) -> str:
    """Lower case, with each run of white space as one blank."""
    return " ".join(text.lower().split())


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def occurrence(peq: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int]:
    """The least edit distance of a pattern of ``m`` characters to any part of ``text``, and where the first such part ends.

    Distances above ``budget`` are given as ``budget + 1``, end -1.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = (m, 0) if m <= budget else (budget + 1, -1)
    get = peq.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


@dataclass
class Item:
    item_id: int
    text: str
    budget: int
    cuts: list[int] = field(default_factory=list)
    #: By piece: the nodes from its parent to the root, as (first piece, last piece + 1).
    paths: list[list[tuple[int, int]]] = field(default_factory=list)
    peq: dict = field(default_factory=dict)

    def __post_init__(self):
        pieces = self.budget + 1
        self.cuts = [len(self.text) * i // pieces for i in range(pieces + 1)]
        self.paths = [[] for _ in range(pieces)]
        level = [(0, pieces)]
        while level:
            nodes, level = level, []
            for lo, hi in nodes:
                if hi - lo > 1:
                    for p in range(lo, hi):
                        self.paths[p].insert(0, (lo, hi))
                    mid = (lo + hi) // 2
                    level += [(lo, mid), (mid, hi)]

    def verify(self, piece: int, at: int, text: str) -> tuple[int, int] | None:
        """Distance and end of an occurrence around the unchanged piece that starts at ``at``, if within the budget."""
        found = 0, at + len(self.text)
        for lo, hi in self.paths[piece]:
            k, (a, b) = hi - lo - 1, (self.cuts[lo], self.cuts[hi])
            if (lo, hi) not in self.peq:
                self.peq[lo, hi] = masks(self.text[a:b])
            begin = max(0, at - (self.cuts[piece] - a) - k)
            d, end = occurrence(self.peq[lo, hi], b - a, text[begin : at + (b - self.cuts[piece]) + k], k)
            if d > k:
                return None
            found = d, begin + end
        return found


class Matcher:
    """All items of one pass and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items, self.tree, pieces = [], ahocorasick.Automaton(), {}
        for item_id, text in items:
            if t := normal(text):
                item = Item(item_id, t, 0 if len(t) < SHORT else int(len(t) * error_rate))
                self.items.append(item)
                for p in range(item.budget + 1):
                    pieces.setdefault(t[item.cuts[p] : item.cuts[p + 1]], []).append((item, p))
        for piece, of in pieces.items():
            self.tree.add_word(piece, (len(piece), of))
        self.tree.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """``(item_id, distance)`` of every item in the text, with its least distance."""
        if not self.items or not text:
            return []
        text = normal(text)
        best: dict[int, int] = {}
        done: dict[int, list[tuple[int, int]]] = {}
        for last, (size, of) in self.tree.iter(text):
            at = last + 1 - size
            for item, piece in of:
                key = item.item_id
                if best.get(key) == 0:
                    continue
                if len(item.text) < SHORT:
                    if (at == 0 or text[at - 1] == " ") and (last + 1 == len(text) or text[last + 1] == " "):
                        best[key] = 0
                    continue
                start = at - item.cuts[piece]
                if any(abs(start - s) <= d for s, d in done.get(key, ())):
                    continue  # the same occurrence, whose least distance the first hit has seen
                if got := item.verify(piece, at, text):
                    best[key] = min(best.get(key, item.budget + 1), got[0])
                    done.setdefault(key, []).append((start, got[0]))
        return sorted(best.items())


_MATCHERS: dict = {}


def matcher_of(key: str, held, error_rate: float) -> Matcher:
    """The matcher of one pass, kept by a Python worker from task to task; the one of another pass goes."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(held.value, error_rate)
    return _MATCHERS[key]


def _task(held, error_rate: float, schema: pa.Schema):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(key, held, error_rate)
        for part, texts in slices(batches, text="_text"):
            found = [matcher.find(t) for t in texts]
            yield rows_of(schema, **{f.name: part.column(f.name) for f in schema if f.name != "_found"}, _found=[[{"item_id": i, "distance": d} for i, d in f] for f in found])

    return run


def passes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items ``(item_id, text)`` in lists of at most about ``PASS_CHARS`` characters, one item at least; nulls left out."""
    rows = picked(items, item_id="long", text="string").where("item_id is not null and text is not null").orderBy("item_id")
    held, size = [], 0
    for r in rows.toLocalIterator():
        if held and size + len(r["text"]) > PASS_CHARS:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if held:
        yield held


def _with_found(docs: DataFrame, text: str, items: list[tuple[int, str]], error_rate: float) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

    found = ArrayType(StructType().add("item_id", LongType()).add("distance", IntegerType()))
    out = StructType([*docs.schema.fields]).add("_text", "string").add("_found", found)
    slim = StructType([f for f in out.fields if f.name != "_text"])
    held = docs.sparkSession.sparkContext.broadcast(items)
    return docs.withColumn("_text", F.col(text).cast("string")).mapInArrow(_task(held, error_rate, to_arrow_schema(slim)), slim)


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """``(doc_id, item_id, distance)``: every item that occurs in a document within its budget of edits.

    An item's budget is ``error_rate`` of its length, both texts in lower case with white space joined; ``distance`` is the
    least over the document. Null and blank items match nothing and null and empty texts hold nothing; of items
    with the same id each that occurs counts, with the least distance. Repeated rows of a document give
    repeated matches; an empty table gives no rows; other columns are not read.
    """
    out = None
    slim = picked(docs, doc_id="long", text="string")
    for block in passes(items):
        part = _with_found(slim, "text", block, error_rate).select("doc_id", F.explode("_found").alias("f")).select("doc_id", "f.item_id", "f.distance")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int")


def clean(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all columns, whatever their names."""
    out, at = plain(docs), f"c{docs.columns.index('text')}"
    for block in passes(items):
        out = _with_found(out, at, block, error_rate).where(F.size("_found") == 0).drop("_found")
    return out.toDF(*docs.columns)
