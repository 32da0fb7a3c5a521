"""simhash, tokens, topk and mixing against brute force, with the odd rows."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from strikegraph.llm import mixing, simhash, tokens, topk
from strikegraph.llm.common import connected_components

DOCS = "doc_id long, text string, source string, extra string"
ODD = [
    (None, "a b c d", "s1", "x"),
    (1, None, "s1", "x"),
    (2, "", "s1", None),
    (3, " \t\n", None, None),
    (4, "One two Three four five", "s1", "x"),
    (4, "One two Three four five", "s1", "x"),
    (5, "one TWO three four five", "s2", "x"),
    (6, "word " * 30000, "s1", "x"),
    (7, "Ünïcode é à l'été, don't stop. <|endoftext|> J̌X  nbsp", "s2", "x"),
]


def fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("pairwise", [64, 1])
def test_simhash_components(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(5)
    base = ["w%d" % rng.randrange(400) for _ in range(120)]
    rows = list(ODD)
    for i in range(150):
        w = list(base) if i % 2 else ["v%d" % rng.randrange(900) for _ in range(rng.randrange(1, 30))]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(5)
        rows.append((100 + i, " ".join(w), "s", None))
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in simhash.components(spark.createDataFrame(rows, DOCS)).collect()}
    fps = [(r[0], fingerprint(r[1])) for r in rows]
    assert set(got) == set(fps)
    distinct = sorted({f for _, f in fps})
    root = closure([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2], distinct)
    name = {}
    for d, f in fps:
        if d is not None:
            name[root[f]] = min(d, name.get(root[f], d))
    assert got == {(d, f): name.get(root[f]) for d, f in fps}


def test_simhash_links_of_flipped_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 8)
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(400):
        f = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randrange(1, 4)):
            f ^= 1 << b
        fps.add(f)
    signed = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    want = closure([(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2], signed)
    assert {n: roots.get(n, n) for n in signed} == want


def test_simhash_empty(spark):
    assert simhash.components(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 90)] + [(200, 201), (5, 5), (3, 2)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(91)}, 200: 200, 201: 200}


def test_dac_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.random(n) ** 6 * 2**31).astype(np.uint32)
        dac = tokens.Dac(tokens.dac_encode(ids))
        assert len(dac) == n
        assert dac.slice(0, n).tolist() == ids.tolist()
        for i in rng.integers(0, n, 40).tolist() if n else []:
            assert dac[i] == ids[i]
        for a in rng.integers(0, n + 1, 20).tolist():
            b = int(rng.integers(a, n + 1))
            assert dac.slice(a, b).tolist() == ids[a:b].tolist()


@pytest.fixture(scope="module")
def word_bpe():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_words_encode_as_whole_texts(word_bpe):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(word_bpe)
    rng = random.Random(3)
    signs = "aAzZéÉßñÑ09.,;:!?'\"-_*#%|<>~ \n\t\r\x0b\x0c\x1c\x85  ́̌̇İΣſK漢字🙂"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += [" ".join(rng.choice(["The", "of.", "it's", "DON'T", "<|endoftext|>", "<|ENDOFTEXT|>.", "word,", "é,", "x..", "J̌"]) for _ in range(20)) for _ in range(200)]
    latin = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x100)]] + ["'s", "'LL", "'Re"]
    texts += [" ".join("".join(rng.choice(latin) for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(300)]
    encode = tokens.WordEncoder(word_bpe, 1, limit=50)
    for i in range(0, len(texts), 100):
        ids, sizes = encode(texts[i : i + 100])
        want = [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts[i : i + 100]]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


def test_token_files(spark, tmp_path, word_bpe):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(word_bpe)
    tokens.write_token_files(spark.createDataFrame(ODD, DOCS).repartition(3), word_bpe, f"{tmp_path}/t")
    got = sorted(tokens.read_token_files(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    at = 0
    for row, (doc_id, text, *_) in zip(got, sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        assert tuple(row) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    tokens.write_token_files(spark.createDataFrame([], DOCS), word_bpe, f"{tmp_path}/e")
    assert tokens.read_token_files(spark, f"{tmp_path}/e").count() == 0


def test_other_tokenizers_get_whole_texts(spark, tmp_path, word_bpe):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    assert tokens.by_words(word_bpe) and not tokens.by_words(path)
    texts = ["Two  Words\n\nand CASE", "", None, " leading", "é 漢字 🙂"]
    tokens.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, f"{tmp_path}/t", end_id=0)
    whole = Tokenizer.from_file(path)
    want = [zlib.crc32(np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for t in texts]
    assert [r.ids_crc32 for r in tokens.read_token_files(spark, f"{tmp_path}/t").orderBy("doc_id").collect()] == want


def test_top_k(spark, monkeypatch):
    for name, value in (("SHARD", 16), ("BLOCK", 4), ("STRIP", 3), ("FAN_IN", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (103, [float("inf")] * 4), (None, [1.0] * 4), (150, [0.1, 0.2]), (151, [1.0, 1.0]), (3, rows[3][1]), (200, []), (50, [20.0, -10.0, 0.0, 20.0]), (50, [20.0, -10.0, 0.0, 20.0])]
    v = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect()))
    vec = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for a, (q, x) in enumerate(vec):
        if q % 50 == 0:
            s = sorted((-sum(m * n for m, n in zip(x, y)), c) for b, (c, y) in enumerate(vec) if a != b and len(x) == len(y))[:5]
            want += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    assert got == sorted(want)
    assert sum(r[0] == 50 for r in got) == 15 and got.count((50, 1, 50, 900 * 256**2)) == 2

    import duckdb
    import pandas as pd

    embeddings = pd.DataFrame([(i, e) for i, e in rows if i is None or i < 150], columns=["vec_id", "embedding"])  # noqa: F841
    sql = topk.TOP_K_SQL.replace("FROM embeddings", "FROM (SELECT vec_id::BIGINT AS vec_id, embedding FROM embeddings)")
    assert sorted(duckdb.sql(sql).fetchall()) == [r for r in got if r[0] < 150]
    empty = topk.quantize(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert topk.top_k(empty, empty).count() == 0


def test_large_scores_are_exact():
    q, c = np.array([[2**29 + 1, 3]]), np.array([[2**29 - 1, 5], [7, 2**30]])
    assert topk._scores(q, c).tolist() == [[(2**29 + 1) * (2**29 - 1) + 15, 7 * (2**29 + 1) + 3 * 2**30]]


def test_mixing_rates_and_odd_rows(spark):
    docs = spark.createDataFrame([(i, None if i % 7 else "t", "a" if i % 3 else "b", None) for i in range(6000)] + [(None, "n", None, "x")], DOCS)
    got = mixing.mix(docs, {"a": 1.0, "b": 3.0}, total=60000).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert set(n) == {"a", "b"} and abs(n["a"] - 15000) < 600 and abs(n["b"] - 45000) < 900
    named = {r["source"]: r["rate"] for r in mixing.rates(docs, {"a": 1.0, None: 1.0, "gone": 5.0}, total=700).collect()}
    assert named["b"] == 0.0 and named["a"] > 0 and (named.get(None) is None or named[None] > 0)
    assert {r["rate"] for r in mixing.rates(docs, {}).collect()} == {0.0}
    one = mixing.mix(docs, seed=9)
    assert one.columns == ["doc_id", "text", "source", "extra", "replica", "n_copies", "shuffle_key"]
    assert sorted(one.select("doc_id", "replica").na.fill(-1).collect()) == sorted(mixing.mix(docs.repartition(7), seed=9).select("doc_id", "replica").na.fill(-1).collect())
    clash = mixing.mix(docs.withColumn("replica", docs.doc_id))
    assert clash.columns.count("replica") == 1
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_poisson_is_inverted(spark):
    docs = spark.range(20000).selectExpr("id doc_id", "'t' text", "'s' source")
    from math import exp, factorial

    for total in (20000, 60000, 440000):
        mean = total / 20000
        counts = mixing.mix(docs, total=total).groupBy("doc_id").count().groupBy("count").count().collect()
        p = {r[0]: r[1] / 20000 for r in counts}
        assert abs(sum(k * x for k, x in p.items()) - mean) < 0.1
        for k in range(1, 6):
            assert abs(p.get(k, 0) - exp(-mean) * mean**k / factorial(k)) < 0.015


def test_rows_without_own_ids_draw_for_themselves(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL", 700)
    rows = [(None, f"t{i}", "a", "x") for i in range(2000)] + [(7, f"r{i}", "a", "x") for i in range(2000)] + [(None, "same", "a", "x")] * 2000 + [(10 + i, "u", "a", "x") for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    by = lambda some: [r for r in got if some(r)]
    for part in (by(lambda r: r.text[0] == "t"), by(lambda r: r.text[0] == "r"), by(lambda r: r.text == "same"), by(lambda r: r.text == "u")):
        assert abs(len(part) - 2000) < 200
        assert abs(sum(r.replica == 1 for r in part) - 1264) < 100 and {r.n_copies for r in part} >= {1, 2, 3}
    assert len({r.shuffle_key for r in got}) == len(got)
    other = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.shuffle_key, r.text) for r in other) == sorted((r.shuffle_key, r.text) for r in got)
    alone = mixing.mix(docs.where("doc_id >= 10")).select("doc_id", "replica", "shuffle_key").collect()
    assert set(alone) == set(r[0:1] + r[4:5] + r[6:7] for r in by(lambda r: r.text == "u"))
