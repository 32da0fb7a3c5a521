"""Column helpers for edge types, paths, labels and sets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_etype(etype: Column | str) -> Column:
    """The opposite direction: forward types are even, their reverses one more."""
    return (F.col(etype) if isinstance(etype, str) else etype).bitwiseXOR(F.lit(1))


def reverse_etypes(etypes: Column | str) -> Column:
    """A sequence of edge types read from its other end."""
    return F.transform(F.reverse(etypes), reverse_etype)


def pack_edge(hi: Column | str, lo: Column | str) -> Column:
    """Two 32-bit numbers in one long."""
    return F.shiftleft(F.col(hi).cast("long") if isinstance(hi, str) else hi.cast("long"), 32).bitwiseOR(F.col(lo) if isinstance(lo, str) else lo)


def unpack_edge(packed: Column | str) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 32), (F.col(packed) if isinstance(packed, str) else packed).bitwiseAND(F.lit(0xFFFFFFFF))


def signature(values: Column | str, sep: str = "-") -> Column:
    """A path or sequence as text."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


def parse_signature(text: Column | str, sep: str = "-") -> Column:
    return F.transform(F.split(text, sep), lambda x: x.cast("long"))


def interleave(labels: Column | str, etypes: Column | str, sep: str = "|") -> Column:
    """``label0|e0|label1|...``; there is one label more than edge types."""
    return F.array_join(F.zip_with(labels, F.transform(etypes, lambda x: x.cast("string")), lambda a, e: F.when(e.isNull(), a).otherwise(F.concat(a, F.lit(sep), e))), sep)


def type_label(type_: Column | str) -> Column:
    return F.concat(F.lit("T:"), type_)


def instance_label(nid: Column | str) -> Column:
    return F.concat(F.lit("I:"), (F.col(nid) if isinstance(nid, str) else nid).cast("string"))


def is_simple(nodes: Column | str) -> Column:
    """No node twice."""
    return F.size(F.array_distinct(nodes)) == F.size(nodes)


def decay(level: Column | str) -> Column:
    return F.exp(-(F.col(level) if isinstance(level, str) else level))


#: exp(-i) for the first positions, the same doubles wherever they are used.
DECAYS = [math.exp(-i) for i in range(8)]


def jaccard_distance(a: Column | str, b: Column | str) -> Column:
    """1 - |a and b| / |a or b| of two arrays of distinct values; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def rounded(column: Column | str, digits: int) -> Column:
    """A double rounded in units of ``10 ** -digits``, by scaling it.

    For values that are rounded already: ``round`` decides a tie by the decimal digits, SQL engines by the scaled double.
    """
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value * 10.0**digits) / 10.0**digits
