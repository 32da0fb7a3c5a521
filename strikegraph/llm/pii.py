"""Personal data: base rules, and a semi-Markov conditional random field that adds spans.

A region is a run of words that hold digits or at signs, cut into atoms (digits, letters, single signs). The
field scores whole segments of up to ``LONGEST`` atoms under each type with features of the span
as a whole, and dynamic programming sums or maximises over all ways to cut the region into segments of some type
and atoms of none. It is trained on the base spans of a bounded sample of regions, on the same spans written in ways that the
base rules miss, and on spans whose checks fail; in every region of every text it then chooses boundaries and types jointly, with the base spans held fixed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, rows_of, slices
from .spans import Cover, Span, digest, joined

KINDS = ("email", "ip", "card", "phone")
#: The field is trained on so many distinct regions at most, drawn by a hash, of so many characters at most.
TRAIN_REGIONS, TRAIN_CHARS = 3000, 400
#: Atoms of the longest segment, hashed weights, and the marginal probability from which a segment is added.
LONGEST, WEIGHTS, SURE = 24, 1 << 13, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match can start inside a run of digits, for one from its start would have covered it.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@]")
_REGION = re.compile(r"[^\s0-9@]*[0-9@]\S*(?: [^\s0-9@]*[0-9@]\S*)*")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^\x00-\x7f]+|[\x00-\x7f]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """The pattern has one at sign, so each is looked at once: the run before it, then the domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the base rules; leftmost, not overlapping within a kind, and those that fail a check left out."""
    out = _emails(text)
    if not _HOT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words with a digit or at sign each, one blank between them."""
    if _HOT.search(text):
        at = 0
        for hit in _HOT.finditer(text):
            if hit.start() < at:
                continue
            a = hit.start()
            while a > at and not text[a - 1].isspace():
                a -= 1
            m = _REGION.match(text, a)
            at = m.end()
            yield a, at


def _kind(atom: str) -> str:
    c = atom[0]
    return "9" if "0" <= c <= "9" else "a" if c.isalpha() and c < "\x80" else "u" if c > "\x7f" else c


@dataclass
class Lattice:
    """A region's atoms and candidate segments ``(first, last + 1, type, feature places)``, by where they end."""

    bounds: list[int]
    plain: list[list[int]]
    ending: list[list[tuple[int, int, list[int]]]]


def _place(*parts) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode()) % WEIGHTS


def _features(kind: str, atoms: list[str], before: str, after: str) -> list[int]:
    """Whole-span features of a segment under a type."""
    kinds = "".join(map(_kind, atoms))
    digits = "".join(a for a in atoms if a[0].isdigit() and a.isascii())
    groups = [len(a) for a in atoms if a[0].isdigit()]
    out = [_place(kind, "bias"), _place(kind, "left", before), _place(kind, "right", after), _place(kind, "first", kinds[0], "last", kinds[-1])]
    if kind == "email":
        local, _, domain = "".join(atoms).partition("@")
        labels = domain.split(".")
        return out + [_place(kind, "labels", min(len(labels), 5)), _place(kind, "tld", min(len(labels[-1]), 8), labels[-1].isalpha()), _place(kind, "local", min(len(local), 12) // 3), _place(kind, "empty", "" in labels)]
    signs = "".join(sorted(set(kinds) - {"9"}))
    out += [_place(kind, "digits", len(digits)), _place(kind, "groups", min(len(groups), 9)), _place(kind, "signs", signs), _place(kind, "shape", kinds if len(kinds) <= 12 else "long")]
    if kind == "card":
        out.append(_place(kind, "luhn", 14 <= len(digits) <= 19 and luhn(digits)))
    elif kind == "ip":
        out.append(_place(kind, "bytes", all(len(a) <= 3 and int(a) <= 255 for a in atoms if a[0].isdigit())))
    else:
        out.append(_place(kind, "plus", kinds[0] == "+"))
    return out


def lattice(text: str, fixed: list[Span]) -> Lattice | None:
    """The region's candidates outside ``fixed``; None where there is none. Types bound what a segment may hold."""
    atoms, bounds = [], [0]
    for m in _ATOM.finditer(text):
        atoms.append(m[0])
        bounds.append(m.end())
    kinds = [_kind(a) for a in atoms]
    n = len(atoms)
    cover = Cover(fixed)
    taken = [cover.overlaps(bounds[i], bounds[i + 1]) for i in range(n)]
    ending: list[list] = [[] for _ in range(n + 1)]
    some = False
    for i in range(n):
        if taken[i] or kinds[i] not in "9a+(" or (i and kinds[i] in "9a" and kinds[i - 1] in "9a"):
            continue
        digits = dots = ats = letters = 0
        for j in range(i, min(n, i + LONGEST)):
            k = kinds[j]
            if taken[j] or k in "u\n\t;!?<>{}[]*#$&^~`\\":
                break
            digits += len(atoms[j]) if k == "9" else 0
            dots, ats, letters = dots + (k == "."), ats + (k == "@"), letters + (k in "a_%=:'\"|")
            if k not in "9a" or (j + 1 < n and kinds[j + 1] in "9a"):
                continue
            if ats == 1 and dots:
                types = ("email",)
            elif ats or letters:
                types = ()
            else:
                types = (("ip",) if dots == 3 and digits <= 12 else ()) + (("card",) if 14 <= digits <= 19 else ()) + (("phone",) if 7 <= digits <= 15 else ())
            for t in types:
                some = True
                ending[j + 1].append((i, t, _features(t, atoms[i : j + 1], kinds[i - 1] if i else "^", kinds[j + 1] if j + 1 < n else "$")))
    if not some:
        return None
    return Lattice(bounds, [[_place("none", k), _place("none", "after", kinds[i - 1] if i else "^", k)] for i, k in enumerate(kinds)], ending)


def _sums(la: Lattice, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Forward and backward log sums, and every arc as ``(from, to, type, features, score)``."""
    n = len(la.plain)
    arcs = [[(i, i + 1, None, f, float(w[f].sum()))] for i, f in enumerate(la.plain)]
    for j in range(1, n + 1):
        arcs[j - 1] += [(i, j, t, f, float(w[f].sum())) for i, t, f in la.ending[j]]
    fwd, bwd = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    fwd[0] = bwd[n] = 0.0
    for into in arcs:
        for a, b, _, _, s in into:
            fwd[b] = np.logaddexp(fwd[b], fwd[a] + s)
    for into in reversed(arcs):
        for a, b, _, _, s in into:
            bwd[a] = np.logaddexp(bwd[a], bwd[b] + s)
    return fwd, bwd, [x for into in arcs for x in into]


def best_path(la: Lattice, w: np.ndarray) -> list[tuple[str, int, int]]:
    """The highest-scoring cut, as typed segments of atoms."""
    n = len(la.plain)
    score, back = np.full(n + 1, -np.inf), [None] * (n + 1)
    score[0] = 0.0
    for j in range(1, n + 1):
        for i, t, f in [(j - 1, None, la.plain[j - 1]), *la.ending[j]]:
            if (s := score[i] + w[f].sum()) > score[j]:
                score[j], back[j] = s, (i, t)
    out, j = [], n
    while j:
        i, t = back[j]
        if t:
            out.append((t, i, j))
        j = i
    return out[::-1]


def fit(examples: list[tuple[str, list[Span]]], rounds: int = 16, rate: float = 0.3, decay: float = 1e-3) -> np.ndarray:
    """Maximises the conditional likelihood of the given spans (offsets within each region), by AdaGrad."""
    w, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-6)
    built = []
    for text, gold in examples:
        if la := lattice(text, []):
            place = {b: i for i, b in enumerate(la.bounds)}
            chosen, at = {}, 0
            for kind, a, b in sorted(gold, key=lambda s: (s[1], -s[2])):
                if a in place and b in place and place[a] >= at and any(i == place[a] and t == kind for i, t, _ in la.ending[place[b]]):
                    chosen[place[a], place[b]] = kind
                    at = place[b]
            inside = {k for a, b in chosen for k in range(a, b)}
            built.append((la, {**chosen, **{(i, i + 1): None for i in range(len(la.plain)) if i not in inside}}))
    for turn in range(rounds):
        for i in np.random.default_rng(turn).permutation(len(built)):
            la, chosen = built[i]
            fwd, bwd, arcs = _sums(la, w)
            step: dict[int, float] = {}
            for a, b, t, f, s in arcs:
                g = float((a, b) in chosen and chosen[a, b] == t) - float(np.exp(fwd[a] + s + bwd[b] - fwd[-1]))
                if abs(g) > 1e-4:
                    for x in f:
                        step[x] = step.get(x, 0.0) + g
            if step:
                at = np.fromiter(step, dtype=np.int64)
                g = np.fromiter(step.values(), dtype=np.float64) - decay * w[at]
                seen[at] += g * g
                w[at] += rate * g / np.sqrt(seen[at])
    return w


def altered(examples: list[tuple[str, list[Span]]]) -> list[tuple[str, list[Span]]]:
    """Counterexamples: each region with an ip or card number, altered in a digit so that its check fails."""
    out = []
    for text, gold in examples:
        for kind, a, b in gold:
            if kind == "card":
                new = text[: b - 1] + str((int(text[b - 1]) + 1) % 10) + text[b:]
            elif kind == "ip":
                first = text[a:b].partition(".")[0]
                new = text[:a] + "9" * min(3, len(first)) + text[a + len(first) :] if len(first) >= 3 else None
            else:
                continue
            if new:
                out.append((new, [s for s in gold if s[2] <= a or s[1] >= b]))
    return out


def varied(examples: list[tuple[str, list[Span]]]) -> list[tuple[str, list[Span]]]:
    """Regions whose spans are written in ways that the base rules miss, as examples of what the field should add.

    Phones without the plus, cards with dots between groups, ip parts with a blank after each dot, domains with a low line.
    """
    out = []
    for text, gold in examples:
        for kind, a, b in gold:
            span = text[a:b]
            if kind == "phone":
                new = span.lstrip("+")
            elif kind == "card":
                digits = re.sub(r"[ -]", "", span)
                new = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
            elif kind == "ip":
                new = span.replace(".", ". ")
            else:
                local, _, domain = span.partition("@")
                new = f"{local}@{domain[:1]}_{domain[1:]}" if domain[1:2].isalnum() else span
            if new != span:
                move = len(new) - (b - a)
                rest = [(k, s, e) if e <= a else (k, s + move, e + move) for k, s, e in gold if e <= a or s >= b]
                out.append((text[:a] + new + text[b:], [*rest, (kind, a, a + len(new))]))
    return out


def added_spans(text: str, base: list[Span], w: np.ndarray) -> list[Span]:
    """Segments of the best cut of each region that no base span touches and whose marginal is ``SURE`` or more."""
    out = []
    todo = sorted(base, key=lambda s: s[1])[::-1]
    for a, b in regions(text):
        # Regions ascend: spans that end before one are done, those that start behind it wait.
        near, later = [], []
        while todo and todo[-1][1] < b:
            k, s, e = todo.pop()
            near += [(k, s - a, e - a)] if e > a else []
            later += [(k, s, e)] if e > b else []
        todo += later[::-1]
        la = lattice(text[a:b], near)
        if la is None:
            continue
        fwd, bwd, arcs = _sums(la, w)
        sure = {(i, j, t) for i, j, t, _, s in arcs if t and fwd[i] + s + bwd[j] - fwd[-1] >= np.log(SURE)}
        out += [(t, a + la.bounds[i], a + la.bounds[j]) for t, i, j in best_path(la, w) if (i, j, t) in sure]
    return out


_REGION_SCHEMA = pa.schema([("region", pa.string()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))])
_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _region_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        found, golds = [], []
        for t in texts:
            base = base_spans(t)
            for a, b in regions(t):
                found.append(t[a:b])
                golds.append([(k, s - a, e - a) for k, s, e in base if a <= s and e <= b])
        yield rows_of(_REGION_SCHEMA, region=found, kinds=[[g[0] for g in x] for x in golds], starts=[[g[1] for g in x] for x in golds], stops=[[g[2] for g in x] for x in golds])


def train(docs: DataFrame, train_regions: int = TRAIN_REGIONS) -> np.ndarray:
    """Weights from the base spans of at most ``train_regions`` distinct regions of ``docs(doc_id, text)``, those of the smallest hashes."""
    hot = picked(docs, text="string").where(F.col("text").rlike("[0-9@]"))
    rows = hot.mapInArrow(_region_task, "region string, kinds array<string>, starts array<int>, stops array<int>").where(F.length("region") <= TRAIN_CHARS)
    # A region may stand in texts that cut its spans in several ways: the way of most spans counts, then the first in order.
    way = F.struct(-F.size("kinds"), "kinds", "starts", "stops")
    distinct = rows.groupBy("region").agg(F.min(way).alias("way")).select("region", "way.kinds", "way.starts", "way.stops")
    drawn = distinct.orderBy(F.xxhash64("region"), "region").limit(train_regions).collect()
    examples = [(r["region"], list(zip(r["kinds"], r["starts"], r["stops"]))) for r in drawn]
    more = examples + varied(examples)
    return fit(more + altered(more))


def _find_task(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for part, texts in slices(batches):
            base = [base_spans(t) for t in texts]
            more = [added_spans(t, b, w) for t, b in zip(texts, base)]
            yield rows_of(
                _OUT,
                doc_id=part.column("doc_id"),
                **{f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS},
                base_sha256=[digest(b, KINDS) for b in base],
                spans=[joined(b + m, KINDS) for b, m in zip(base, more)],
                n_added=[len(m) for m in more],
            )

    return run


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row of ``docs``.

    The counts and the hash are of the base spans; ``spans`` has them and the ``n_added`` spans of the field. A null
    text is empty; repeated rows and null ids stay; an empty table gives no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    return picked(docs, doc_id="long", text="string").mapInArrow(_find_task(held), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
