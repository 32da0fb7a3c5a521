"""Operators that carry all columns, on tables whose other columns have the names that operators use, dots or other cases."""

import random

import pytest

import corpus_pipeline
from strikegraph.llm import backoff, decontam, langid, mixing, pii, quality, secrets, simhash, simhash_similarity, tokens

MORE = ["_digest", "_row", "row", "_text", "_cdf", "_source", "_h", "_n", "_k", "_seed", "c0", "a.b", "Text", "DOC_ID", "_found", "keep", "quality", "replica", "held_out"]
WORDS = ["".join(random.Random(i).choices("aeioulnrst", k=2 + i % 6)) for i in range(500)]


def table(spark, ids):
    rng = random.Random(3)
    rows = [(i, ". ".join(" ".join(rng.choices(WORDS, k=9)).capitalize() for _ in range(6)) + ".", "en", f"s{i % 2 if i else 0}", 9) for i in ids]
    rows = [tuple(r) + tuple(f"{name} of {r[0]}" for name in MORE) for r in rows]
    kinds = "a long, b string, c string, d string, e long, " + ", ".join(f"x{i} string" for i in range(len(MORE)))
    return spark.createDataFrame(rows, kinds).toDF("doc_id", "text", "lang", "source", "n_chars", *MORE), rows


def same(out, rows, some=False):
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows) if some else sorted(got, key=repr) == sorted(rows, key=repr)
    return got


@pytest.mark.parametrize("ids", [list(range(40)), [*range(30), None, None, 3, 3]])
def test_all_columns_pass(spark, ids):
    docs, rows = table(spark, ids)
    out = simhash_similarity.deduplicate(docs)
    assert out.columns == docs.columns
    same(out, rows)
    items = spark.createDataFrame([(1, rows[4][1][:200])], "item_id long, text string")
    out = decontam.clean(docs, items)
    assert out.columns == docs.columns
    same(out, [r for r in rows if r is not rows[4]])
    out = mixing.mix(docs)
    assert out.columns == [c for c in docs.columns if c != "replica"] + ["replica", "n_copies", "shuffle_key"]
    at = [i for i, c in enumerate(docs.columns) if c != "replica"]
    assert {tuple(r)[:-3] for r in out.collect()} <= {tuple(r[i] for i in at) for r in rows}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    assert same(out, rows, some=True)
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    same(out, rows)
    assert quality.classify(docs).columns == [c for c in docs.columns if c not in ("quality", "keep")] + ["quality", "weak_good", "keep"]


def test_other_columns_are_not_read(spark, tmp_path):
    docs, rows = table(spark, range(30))
    assert langid.identify(docs).count() == simhash.components(docs, words=3, distance=2).count() == 30
    assert secrets.scan(docs).count() == backoff.score_corpus(docs, order=2).count() == pii.find(docs, pii.train(docs)).count() == 30
    assert backoff.count(docs, order=2).words == sum(len(r[1].split()) for r in rows)
    assert decontam.matches(docs, docs.toDF("item_id", *docs.columns[1:])).count() == 30
    import public_tokenizers

    tokens.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "t"))
    assert tokens.read_token_files(spark, str(tmp_path / "t")).count() == 30


def test_pipeline_carries_them(spark, tmp_path):
    docs, rows = table(spark, range(60))
    docs = docs.toDF(*(c if c not in ("Text", "DOC_ID") else c + "2" for c in docs.columns))  # Parquet can't be written with them
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a text that no document holds at all, not even in parts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        same(out, rows, some=True)
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
    assert 0 < corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() < 120
