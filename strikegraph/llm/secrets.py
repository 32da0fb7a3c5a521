"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every text. The hash of each candidate's value is counted over the corpus by
distinct repositories and distinct owners: a value that many owners share is a copied example, one that stays with
few owners and looks random is taken for a live credential. Values leave the scan as hashes only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, placed, plain, rows_of, slices, write_shared
from .spans import Cover, Span, digest

#: The base kinds in their order, then the kind that the method adds.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token")
#: A value held by so many distinct owners or more, or in so many distinct repositories, is a copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 20
#: Entropy in bits a character and length that let a value look live.
LIVE_BITS, LIVE_CHARS = 2.5, 12

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` of the base rules. Matches that are too short go; nothing is searched again inside them.

    A run of hexadecimal digits is matched whole, so asking for 16 at once finds the same runs.
    """
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]


def token_spans(text: str, taken: list[Span]) -> list[tuple[str, int, int, str]]:
    """Other runs of 20 or more key characters with small and capital letters and digits, outside the spans taken."""
    if not _DIGIT.search(text):
        return []
    out, cover = [], Cover(taken)
    for m in _TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and not cover.overlaps(m.start(), m.end()):
            out.append(("token", m.start(), m.end(), v))
    return out


def looks_live(value: str) -> bool:
    return len(value) >= LIVE_CHARS and entropy(value) >= LIVE_BITS and any(c.isdigit() for c in value)


_CANDIDATE = "array<struct<kind:string,start:int,stop:int,value_hash:long,live_looking:boolean>>"
_SCHEMA = f"_rid long, doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, candidates {_CANDIDATE}"


def _scan_task(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            counts, digests, candidates = {k: [] for k in BASE}, [], []
            for t in texts:
                base = base_spans(t)
                spans = [s[:3] for s in base]
                for k in BASE:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(digest(spans, KINDS))
                candidates.append([{"kind": k, "start": a, "stop": b, "value_hash": xxhash.xxh64_intdigest(v.encode()) - 2**63, "live_looking": looks_live(v)} for k, a, b, v in base + token_spans(t, spans)])
            fixed = {n: part.column(n) for n in ("_rid", "doc_id", "repo", "owner")}
            yield rows_of(schema, **fixed, n_assign=counts["assign"], n_access=counts["access"], n_hex=counts["hex"], base_sha256=digests, candidates=candidates)

    return run


def ownership(candidates: DataFrame) -> DataFrame:
    """``(value_hash, n_repos, n_owners)`` of ``candidates(value_hash, repo, owner)``; each pair is counted once, first within its partition."""
    count = lambda by: candidates.select("value_hash", by).where(F.col(by).isNotNull()).distinct().groupBy("value_hash").agg(F.count("*").alias(f"n_{by}s"))
    every = candidates.groupBy("value_hash").agg(F.count("*").alias("n"))
    return every.join(count("repo"), "value_hash", "left").join(count("owner"), "value_hash", "left").select("value_hash", F.coalesce("n_repos", F.lit(0)).alias("n_repos"), F.coalesce("n_owners", F.lit(0)).alias("n_owners"))


def _named(docs: DataFrame, repo: str, owner: str) -> DataFrame:
    kinds = {"doc_id": ("doc_id", "long"), "repo": (repo, "string"), "owner": (owner, "string"), "text": ("text", "string")}
    return plain(docs).select(*(placed(docs, name).cast(kind).alias(out) for out, (name, kind) in kinds.items()))


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_repos, n_owners``.

    ``n_*`` of the base kinds and ``base_sha256`` describe the base spans. ``spans`` has those and the further tokens that
    are live: they look random, and fewer than ``copied_owners`` owners and ``copied_repos`` repositories hold the value.
    ``n_live`` and ``n_copied`` count all candidates with a live-looking value that so few hold, or more; ``n_repos`` and
    ``n_owners`` are the most repositories and owners that hold one of the row's values. A null text is empty;
    a null repository or owner is not counted as one; repeated rows and null ids stay; an empty table gives no rows.
    """
    schema = pa.schema(
        [("_rid", pa.int64()), ("doc_id", pa.int64()), ("repo", pa.string()), ("owner", pa.string()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string())]
        + [("candidates", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value_hash", pa.int64()), ("live_looking", pa.bool_())])))]
    )
    rows = numbered(_named(docs, repo, owner))
    found = write_shared(rows.mapInArrow(_scan_task(schema), _SCHEMA), "secrets-scan")
    each = write_shared(found.select("_rid", "repo", "owner", F.explode("candidates").alias("c")).select("_rid", "repo", "owner", "c.*"), "secrets-candidates")
    owned = write_shared(ownership(each), "secrets-ownership")
    judged = each.join(owned, "value_hash").withColumn("copied", (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos))
    keep = (F.col("kind") != "token") | (F.col("live_looking") & ~F.col("copied"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(F.col("start"), order.alias("k"), F.col("stop"), F.concat_ws(":", "kind", "start", "stop").alias("s"))
    by_row = judged.groupBy("_rid").agg(
        F.collect_list(F.when(keep, span)).alias("kept"),
        F.count_if(F.col("live_looking") & ~F.col("copied")).alias("n_live"),
        F.count_if(F.col("live_looking") & F.col("copied")).alias("n_copied"),
        F.max("n_repos").alias("n_repos"),
        F.max("n_owners").alias("n_owners"),
    )
    spans = F.array_join(F.transform(F.array_sort("kept"), lambda s: s["s"]), ",")
    text = by_row.select("_rid", spans.alias("spans"), "n_live", "n_copied", "n_repos", "n_owners")
    zero = F.lit(0).cast("long")
    return found.join(text, "_rid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), *(F.coalesce(c, zero).alias(c) for c in ("n_copied", "n_repos", "n_owners")))
