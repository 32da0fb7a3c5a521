"""Language identification by mixture inference.

Every language has smoothed probabilities of hashed letter trigrams, counted over all training
documents. A document is a mixture: each of its words comes from one language, with the likelihood of
its trigrams, and expectation-maximisation estimates the proportions. The set of languages is the one of the
highest likelihood after a penalty for every language beyond the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, rows_of, slices

#: Buckets of hashed trigrams at most, and entries of the broadcast model (4 bytes each): more languages get fewer buckets.
BUCKETS, ENTRIES = 1 << 15, 1 << 23
#: Rounds of expectation-maximisation over all languages, and at most over a set; those end once proportions move less than ``STILL``.
ROUNDS, SET_ROUNDS, STILL = 12, 80, 1e-4
#: Letters times languages that are looked up at once.
AT_ONCE = 4_000_000
#: A document's set is looked for among so many languages first, those that win most of its words; others are added as long as they could raise its likelihood.
CANDIDATES = 16
#: Languages of a model at most: the labels of most documents; rarer ones are taken for dirt and teach nothing.
LANGUAGES = 1 << 13
#: The log likelihood of a word in no language.
NEVER = -1e5
#: The penalty for each language beyond the first is this times the logarithm of the number of words.
PENALTY = 2.0
#: Added to every count.
SMOOTH = 0.1

_LETTER: list[np.ndarray] = []


def _is_letter(cp: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x10000)], dtype=bool))
    out = _LETTER[0][np.minimum(cp, 0xFFFF)]
    if (far := cp > 0xFFFF).any():
        known, at = np.unique(cp[far], return_inverse=True)
        out[far] = np.array([chr(c).isalpha() for c in known.tolist()], dtype=bool)[at]
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each letter's trigram, the place of each word's first trigram, and each word's text.

    A word is a run of letters; a trigram is a letter with its neighbours, where other signs count as one blank.
    """
    low = [t.lower() for t in texts]
    cp = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _is_letter(cp)
    code = np.where(letter, cp, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    h = code[at - 1] * np.uint32(0x9E3779B1) + code[at] * np.uint32(0x85EBCA77) + code[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum(np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1)
    return (h >> np.uint32(17)).astype(np.int32), first, np.searchsorted(ends, at[first] - 1, side="right")


def buckets(n_languages: int) -> int:
    """A power of two that keeps the model within ``ENTRIES``."""
    return min(BUCKETS, 1 << max(0, (ENTRIES // max(1, n_languages)).bit_length() - 1))


def _count_task(languages: list[str]):
    size = buckets(len(languages))
    place = {x: i for i, x in enumerate(languages)}
    schema = pa.schema([("lang_at", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) * size, dtype=np.int64)
        for part, texts in slices(batches):
            bucket, first, doc = trigrams(texts)
            if not len(bucket):
                continue
            lang = np.array([place[x] for x in part.column("lang").to_pylist()], dtype=np.int64)
            of = np.repeat(lang[doc] * size, np.diff(np.append(first, len(bucket))))
            counts += np.bincount(of + bucket % size, minlength=len(counts))
        some = np.flatnonzero(counts)
        for a in range(0, len(some), 1 << 16):
            s = some[a : a + (1 << 16)]
            yield rows_of(schema, lang_at=s // size, bucket=s % size, n=counts[s])

    return run


@dataclass
class LanguageModel:
    """``log_p[bucket, language]``; languages in ascending order."""

    languages: list[str]
    log_p: np.ndarray


def train(docs: DataFrame) -> LanguageModel:
    """Counts the trigrams of all of ``docs(text, lang)``; rows with a null text or lang teach nothing.

    The names of at most ``LANGUAGES`` languages and the bounded model pass the driver; with many languages the model gets coarser.
    """
    known = picked(docs, text="string", lang="string").where("text is not null and lang is not null")
    frequent = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    languages = sorted(r["lang"] for r in frequent.collect())
    if len(languages) == LANGUAGES:
        known = known.where(F.col("lang").isin(languages))
    counts = np.zeros((buckets(len(languages)), len(languages)))
    if languages:
        total = known.mapInArrow(_count_task(languages), "lang_at int, bucket int, n long").groupBy("lang_at", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[total["bucket"], total["lang_at"]] = total["n"]
    return LanguageModel(languages, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * len(counts))).astype(np.float32))


def _distinct_words(bucket: np.ndarray, first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text, told apart by a hash of their trigrams: a word's place, its text, and how often it occurs."""
    lengths = np.diff(np.append(first, len(bucket)))
    at = (np.arange(len(bucket)) - np.repeat(first, lengths)).astype(np.uint64)
    x = (bucket.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (at + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    key = np.add.reduceat((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), first)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
    return order[new], d[new], np.diff(np.append(new, len(k)))


def _likelihoods(model_p: np.ndarray, bucket: np.ndarray, first: np.ndarray, words: np.ndarray, columns) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs ``a, b`` of ``words`` with their log likelihoods, a word's trigrams added up: for all languages, or those that ``columns(a, b)`` names by word."""
    lengths = np.append(first[1:], len(bucket))[words] - first[words]
    wide = model_p.shape[1] if columns is None else columns(0, 1).shape[1]
    run = (np.cumsum(lengths) - 1) // max(1, AT_ONCE // wide)
    cut = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(words)]
    for a, b in zip(cut, cut[1:]):
        n = lengths[a:b]
        start = np.cumsum(n) - n
        letters = bucket[np.arange(n.sum()) + np.repeat(first[words[a:b]] - start, n)] % len(model_p)
        of = model_p[letters] if columns is None else model_p[letters[:, None], np.repeat(columns(a, b), n, axis=0)]
        yield a, b, np.add.reduceat(of, start).astype(np.float64)


def _sums(model_p: np.ndarray, bucket: np.ndarray, first: np.ndarray, words: np.ndarray, at: np.ndarray, value) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts with the sums over their words of ``value(a, b, likelihoods)`` for all languages, some texts at a time; ``at``: the words' texts, ascending."""
    held = None
    for a, b, w in _likelihoods(model_p, bucket, first, words, None):
        texts, start = np.unique(at[a:b], return_index=True)
        sums = np.add.reduceat(value(a, b, w), start)
        if held is not None and held[0] == texts[0]:
            sums[0] += held[1]
        elif held is not None:
            yield np.array([held[0]]), held[1][None]
        if len(texts) > 1:
            yield texts[:-1], sums[:-1]
        held = texts[-1], sums[-1]
    if held is not None:
        yield np.array([held[0]]), held[1][None]


def _candidates(model_p: np.ndarray, bucket: np.ndarray, first: np.ndarray, words: np.ndarray, at: np.ndarray, times: np.ndarray, n_docs: int) -> np.ndarray:
    """By text the languages to begin with, in ascending order: the likeliest for the whole text and ``CANDIDATES`` that are it for most of its words; all, if there are no more. -1 stands for none."""
    n_langs = model_p.shape[1]
    if n_langs <= CANDIDATES:
        return np.tile(np.arange(n_langs), (n_docs, 1))
    best, alone = np.empty(len(words), dtype=np.int64), np.empty(n_docs, dtype=np.int64)

    def value(a: int, b: int, w: np.ndarray) -> np.ndarray:
        best[a:b] = w.argmax(axis=1)
        return w * times[a:b, None]

    for texts, sums in _sums(model_p, bucket, first, words, at, value):
        alone[texts] = sums.argmax(axis=1)
    pair, of = np.unique(at * n_langs + best, return_inverse=True)
    votes = np.bincount(of, weights=times)
    text, lang = pair // n_langs, pair % n_langs
    order = np.lexsort((lang, -votes, text))
    place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    out = np.full((n_docs, CANDIDATES + 1), -1)
    some = place < CANDIDATES
    out[text[order][some], place[some]] = lang[order][some]
    out[:, -1] = np.where((out == alone[:, None]).any(axis=1), -1, alone)
    return np.sort(out, axis=1)


def _mixture(like: np.ndarray, times: np.ndarray, start: np.ndarray, n: np.ndarray, pi: np.ndarray, rounds: int, still: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document after some rounds from ``pi``, and the sum of the words' log likelihoods under them.

    ``times``: how often each word occurs; ``n``: the number of distinct words of a document.
    """
    at = np.repeat(np.arange(len(n)), n)
    total = np.add.reduceat(times, start)[:, None]
    for _ in range(rounds):
        r = like * pi[at]
        r *= (times / (r.sum(axis=1) + 1e-30))[:, None]
        before, pi = pi, np.add.reduceat(r, start) / total
        if np.abs(pi - before).max(initial=0.0) < still:
            break
    return pi, np.add.reduceat(times * np.log((like * pi[at]).sum(axis=1) + 1e-30), start)


def infer(model_p: np.ndarray, bucket: np.ndarray, first: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions ``(n_docs, candidates)`` under the chosen language set (zeros without a word), the candidates, and the set's size.

    The candidates grow, see ``_chosen``, until no other language could raise a text's likelihood. Memory follows the distinct words times
    the candidates, time the letters times the languages.
    """
    width = min(model_p.shape[1], CANDIDATES)
    size = np.zeros(n_docs, dtype=np.int64)
    if not len(first):
        return np.zeros((n_docs, width)), np.tile(np.arange(width), (n_docs, 1)), size
    words, of_doc, times = _distinct_words(bucket, first, doc)
    some, at = np.unique(of_doc, return_inverse=True)
    langs = _candidates(model_p, bucket, first, words, at, times, len(some))
    out, cand = np.zeros((n_docs, langs.shape[1])), np.tile(np.arange(langs.shape[1]), (n_docs, 1))
    left = np.arange(len(some))
    while len(left):
        here = np.isin(at, left)
        pi, chosen, more = _chosen(model_p, bucket, first, words[here], np.searchsorted(left, at[here]), times[here], langs)
        if (wider := langs.shape[1] - out.shape[1]) > 0:
            out, cand = np.pad(out, ((0, 0), (0, wider))), np.pad(cand, ((0, 0), (0, wider)), constant_values=-1)
        done = (more < 0).all(axis=1)
        rows = some[left[done]]
        out[rows, : langs.shape[1]], cand[rows, : langs.shape[1]], size[rows] = pi[done], langs[done], chosen[done]
        left, langs = left[~done], np.sort(np.hstack([langs, more])[~done], axis=1)
    return out, cand, size


def _chosen(model_p: np.ndarray, bucket: np.ndarray, first: np.ndarray, words: np.ndarray, at: np.ndarray, times: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``infer`` among the candidates ``langs`` of each text, and the languages to add to them, -1 for none.

    The likelihood is concave in the proportions, so its slope bounds what any mixture of all languages reaches, and most texts are settled
    by it. Of the others, those go on with more candidates that have another language whose slope at the candidates' mixture is above one a word:
    without such a language no mixture of all languages is likelier than the candidates' best.
    """
    n_langs, width = model_p.shape[1], langs.shape[1]
    _, start, n = np.unique(at, return_index=True, return_counts=True)
    likely = np.empty((len(words), width))
    for a, b, w in _likelihoods(model_p, bucket, first, words, lambda a, b: langs[at[a:b]]):
        likely[a:b] = np.where(langs[at[a:b]] < 0, NEVER, w)
    alone = np.add.reduceat(likely * times[:, None], start)
    top = likely.max(axis=1, keepdims=True)
    like, shift = np.exp(likely - top), np.add.reduceat(top[:, 0] * times, start)
    best = alone.max(axis=1)
    pi = np.eye(width)[alone.argmax(axis=1)]
    size = np.ones(len(n), dtype=np.int64)
    count = np.add.reduceat(times, start)
    penalty = PENALTY * np.log(count + 1.0)
    full, log_l = _mixture(like, times, start, n, np.full_like(pi, 1.0 / width), ROUNDS)
    weight = times / (like * full[at]).sum(axis=1)
    slope = np.add.reduceat(like * weight[:, None], start).max(axis=1)
    more = np.full((len(n), CANDIDATES), -1)
    if n_langs > CANDIDATES:
        with np.errstate(over="ignore"):
            value = lambda a, b, w: np.exp(w - top[a:b]) * weight[a:b, None]
            for texts, sums in _sums(model_p, bucket, first, words, at, value):
                slope[texts] = np.maximum(slope[texts], sums.max(axis=1))
                own = np.zeros((len(texts), n_langs + 1), dtype=bool)
                np.put_along_axis(own, langs[texts], True, axis=1)
                sums[own[:, :-1]] = 0.0  # -1 marks the column beyond the languages
                order = np.argsort(-sums, axis=1, kind="stable")[:, :CANDIDATES]
                steep = np.take_along_axis(sums, order, axis=1) > count[texts, None] * (1 + 1e-9)
                more[texts] = np.where(steep, order, -1)
    open_ = np.flatnonzero(log_l + slope - count + shift - best > penalty)
    more[np.setdiff1d(np.arange(len(n)), open_)] = -1
    open_ = open_[(more[open_] < 0).all(axis=1)]
    if len(open_) and width > 1:
        reached = best.copy()
        order = np.argsort(-full, axis=1, kind="stable")
        # The set grows in the order of the proportions by one language at a time, as long as that pays or the last step did.
        for k in range(2, width + 1):
            here = np.isin(at, open_)
            m = n[open_]
            mask = np.zeros((len(open_), width))
            np.put_along_axis(mask, order[open_, :k], 1.0 / k, axis=1)
            p, ll = _mixture(like[here], times[here], np.cumsum(m) - m, m, mask, SET_ROUNDS, STILL)
            ll += shift[open_] - (k - 1) * penalty[open_]
            better = ll > reached[open_]
            reached[open_[better]] = ll[better]
            pi[open_[better]] = p[better]
            size[open_[better]] = k
            open_ = open_[better] if k > 2 else open_  # three may pay where two don't
            if not len(open_):
                break
    return pi, size, more


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_langs", pa.int32()), ("mixture", pa.map_(pa.string(), pa.float64()))])


def _predict_task(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = model.languages
        for part, texts in slices(batches):
            none = np.zeros((len(texts), 1)), np.zeros((len(texts), 1), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            pi, langs, size = infer(model.log_p, *trigrams(texts), len(texts)) if names else none
            at = langs[np.arange(len(pi)), pi.argmax(axis=1)]
            yield rows_of(
                _OUT,
                doc_id=part.column("doc_id"),
                held_out=part.column("held_out"),
                lang_pred=[names[a] if s else "und" for a, s in zip(at.tolist(), size.tolist())],
                score=np.clip(pi.max(axis=1), 0.0, 1.0),
                n_langs=size,
                mixture=[[(names[own[j]], float(p[j])) for j in np.flatnonzero(p > 1e-3)] for p, own in zip(pi, langs)],
            )

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_langs, mixture`` for every row of ``docs(doc_id, text, held_out)``.

    ``lang_pred`` is the language of the largest proportion (ties: the first by name), ``score`` its proportion,
    ``mixture`` the proportions above 0.001 in the chosen set. A text that is null or has no letter, and any
    text under a model without languages, is ``und`` with score 0. Repeated rows and null ids stay; an
    empty table gives no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return picked(docs, doc_id="long", text="string", held_out="boolean").mapInArrow(_predict_task(held), "doc_id long, held_out boolean, lang_pred string, score double, n_langs int, mixture map<string,double>")


def held_out():
    """True where crc32 of the id as text leaves 2 when divided by 4; such rows teach nothing, rows without an id do."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the rows that are not held out and predicts every row."""
    marked = picked(docs, doc_id="long", text="string", lang="string").withColumn("held_out", held_out())
    return predict(marked, train(marked.where(~F.col("held_out"))))
