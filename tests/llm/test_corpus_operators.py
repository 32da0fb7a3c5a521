"""whitening, line_dedup and divergence against brute force, with the odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from strikegraph.llm import divergence, line_dedup, whitening
from strikegraph.llm.common import picked

VECTORS = "vec_id long, embedding array<float>, `a.b` string, VEC_ID int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "i long, v array<float>, s string, n int").toDF("vec_id", "embedding", "a.b", "VEC_ID")


def plain_whitening(rows, k):
    """By id and row the exact deviation; the covariance, exactly summed."""
    x = [(i, [floor(256 * c) for c in v]) for i, v in rows]
    once = sorted({tuple(v) for _, v in x})
    n, dim = len(once), len(once[0])
    sums = [sum(v[j] for v in once) for j in range(dim)]
    c = [[Fraction(n * v[j] - sums[j], n) for j in range(dim)] for v in once]
    cov = np.array([[float(sum(r[i] * r[j] for r in c) / n) for j in range(dim)] for i in range(dim)])
    return [(i, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in x], cov, n, sums, x


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(4)
    basis = rng.normal(size=(6, 6)) * np.array([3, 2, 1, 0.5, 0.2, 0.1])[:, None]
    rows = [(i, (rng.normal(size=6) @ basis).astype(np.float32).tolist()) for i in range(300)]
    rows += [(500 + i, rows[3][1]) for i in range(100)] + [(None, rows[5][1]), (7, rows[8][1]), (8, [-0.0] * 6)]
    odd = [(900, None), (901, []), (902, [nan] * 6), (903, [1.0, inf] + [0.0] * 4), (904, [None] * 6), (905, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows + odd), components=4).collect()
    want, cov, n, sums, x = plain_whitening(rows, 4)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    assert sorted((repr(r.vec_id), r.deviation) for r in got) == sorted((repr(i), d) for i, d in want for _ in range(4))
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12
    for k, part in by.items():
        exact = [(np.array(v) - np.array(sums) / n) @ u[:, k - 1] / np.sqrt(e[k - 1]) for _, v in x]
        found = sorted((r.whitened for r in part))
        assert np.allclose(found, sorted(exact), atol=1e-9) or np.allclose(found, sorted(-w for w in exact), atol=1e-9)


def test_whitening_of_few_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [nan])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 5)).count() == 0  # no spread, no component
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(r.whitened), r.explained) for r in got) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_whitening_of_huge_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()  # 256 * 1e30 counts as the largest long
    assert {r.deviation for r in got} == {None, 59, *()} - {59} | {r.deviation for r in got if r.vec_id == 3}
    x = np.array([[2**63 - 1, 0], [-(2**63), 256], [1280, 512]], dtype=np.int64)
    assert whitening.exact_sums(x) == [1279, 768]
    assert whitening.centred(x, 3, [1279, 768])[0].tolist() == [3 * (2**63 - 1) - 1279, -768]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20000):
        keys = rng.integers(-(2**63), 2**63, (n, 2), dtype=np.int64)
        keys[: n // 2, 0] = 5  # halves may agree
        shard = line_dedup.LineShard.build(keys, np.arange(n), np.arange(n) * 3)
        assert sorted(shard.perfect.find(keys).tolist()) == list(range(n))
        at = shard.probe(keys)
        assert shard.counts[at].tolist() == list(range(n)) and shard.last[at].tolist() == [3 * i for i in range(n)]
        assert (shard.probe(rng.integers(-(2**63), 2**63, (5000, 2), dtype=np.int64)) == -1).all()
        assert len(shard.perfect.bits) <= n + 64  # bits: a few for each key


def plain_lines(rows, chars, least):
    key = lambda line: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(list)
    for i, lines in split:
        for k in {key(x) for x in lines if len(key(x)) >= chars}:
            holders[k].append(i)
    low = lambda i: -inf if i is None else i
    last = {k: max(map(low, ids)) for k, ids in holders.items() if len(ids) >= least}
    out = []
    for i, lines in split:
        kept = [x for x in lines if key(x) not in last or low(i) == last[key(x)]]
        out.append((repr(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("share", [1 / (1 << 16), 0.05, 1.0])
def test_lines_by_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "SHARE", share)
    monkeypatch.setattr(line_dedup, "SHARD_POSTS", 50)
    rng = random.Random(2)
    pool = ["The terms of this licence apply to line %d, é ü" % i for i in range(30)] + ["short line %d" % i for i in range(5)] + ["", "  ", "x" * 39, "É" * 40, "é" * 39 + "é"]
    rows = []
    for i in range(200):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        lines += [pool[0]] * (i % 3 == 0) + ["own line of document %d which nobody else has" % i]
        rows.append((i, "\n".join(x.upper() + "\r" if rng.random() < 0.2 else " \t" + x if rng.random() < 0.2 else x for x in lines)))
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, pool[1] + "\n" + pool[2]), (5, pool[3] + "\na"), (5, pool[3] + "\na")]
    rows += [(None, "a line that only documents without an id have got " + x) for x in "aaaaaabbb"]
    rows += [(400 + i % 2, "a line whose largest document comes twice, and so stays in both") for i in range(6)]
    rows += [(500, ("word " * 3000 + "\n") * 20)]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, rid string, hits string, n int").repartition(7).toDF("doc_id", "text", "rid", "a.hits", "TEXT")
    found = line_dedup.drop_lines(docs, line_dedup.index(docs, 40, 5))
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    got = sorted((repr(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in found.collect())
    assert got == plain_lines(rows, 40, 5)


def test_lines_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_lines(docs, line_dedup.index(docs)).count() == 0


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")) for text, lang, source in rows]
    docs = [(lang, source, [t.translate({c: c + 32 for c in range(65, 91)}) for t in ts]) for lang, source, ts in docs]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= min_docs]
        sources = {d[1] for d in docs if d[0] == lang}

        def shares(which):
            n = Counter(t for d in docs if d[0] == lang and d[1] in which for t in d[2])
            size = sum(n[t] for t in kept) + 5 * len(kept)
            return n, {t: 1 + 10**9 * (n[t] + 5) // size for t in kept}

        all_ = shares(sources)[1]
        own = {s: shares({s}) for s in sources}
        for s in sources:
            n, p = own[s]
            pairs = [(o, sum(abs(p[t] - own[o][1][t]) for t in kept)) for o in sources if o != s]
            best = [(t, p[t] - all_[t]) for t in kept if n[t] and p[t] > all_[t]]
            for part, items in (("pair", pairs), ("term", best)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("rows_of_a_shard", [1 << 16, 40])
def test_audit_by_brute_force(spark, monkeypatch, rows_of_a_shard):
    monkeypatch.setattr(divergence, "SHARD_ROWS", rows_of_a_shard)
    rng = random.Random(3)
    words = ["w%s" % "abcdefghij"[i % 10] * (1 + i // 10) for i in range(40)] + ["Été", "straße", "ПРИВЕТ", "日本"]
    rows = []
    for i in range(220):
        source = rng.choice(["web", "web", "web", "news", "code", None, ""])
        some = words[: 25 + 5 * len(source or "")]
        rows.append((" ".join(rng.choice([w, w.upper(), w + ",", "7" + w + "_x"]) for w in rng.choices(some, k=rng.randrange(40))), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "only nulls"), ("", "xx", "a"), ("one two", "xx", "b"), ("...", "xx", "a"), ("solo", "yy", "a"), ("wa " * 50000, "en", "web"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, n int").repartition(5).toDF("text", "lang", "source", "LANG")
    got = sorted(tuple(r) for r in divergence.audit(docs, 10, 7).collect())
    assert got == plain_audit(rows, 10, 7)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_picked_takes_exact_names(spark):
    df = spark.createDataFrame([(1, "a", "b", 2.0)], "a int, b string, c string, d double").toDF("ID", "id", "a.b", "c")
    assert [tuple(r) for r in picked(df, id="string", **{"a.b": "string"}).collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        picked(df, text="string")
