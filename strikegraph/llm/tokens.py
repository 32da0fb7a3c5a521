"""Token ids in directly addressable files.

A shard keeps the ids of a run of documents as directly addressable codes: every id is cut into
bytes; level 0 holds the lowest byte of every id, level ``l`` the next byte of those ids that go on, a
bitmap per level tells which do, and a directory of ranks (set bits before each block of 512) finds an id's
place on the next level. Any token is read with one lookup a level, without decoding its neighbours.

The files are a Parquet table with one row a shard, so Spark's writers and readers handle commit, retry
and remote stores; the codes are in its binary columns.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, rows_of, shared_dir, slices

#: A shard is closed once it has so many ids; documents are not split.
SHARD_IDS = 1 << 20
BLOCK_BITS = 512
MAGIC = b"DAC1"


def dac_encode(ids: np.ndarray) -> bytes:
    """``MAGIC``, the number of levels and of ids, then for each level its size, bytes, bitmap and ranks."""
    left = ids.astype(np.uint32)
    out, levels = [], 0
    while True:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        full = np.zeros(-(-len(more) // BLOCK_BITS) * (BLOCK_BITS // 8), dtype=np.uint8)
        full[: len(bits)] = bits
        ones = np.bitwise_count(full.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype=np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        out += [np.array([len(left)], dtype="<u4").tobytes(), (left & 0xFF).astype(np.uint8).tobytes(), full.tobytes(), ranks.tobytes()]
        levels += 1
        left = left[more] >> np.uint32(8)
        if not len(left):
            break
    return MAGIC + np.array([levels, len(ids)], dtype="<u4").tobytes() + b"".join(out)


class Dac:
    """A view of encoded ids: ``len``, ``dac[i]`` by ranks, and ``slice(a, b)``."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a DAC shard")
        levels, self.n = (int(x) for x in np.frombuffer(blob, "<u4", 2, 4))
        self.levels, at = [], 12
        for _ in range(levels):
            n = int(np.frombuffer(blob, "<u4", 1, at)[0])
            blocks = -(-n // BLOCK_BITS)
            data = np.frombuffer(blob, np.uint8, n, at + 4)
            bits = np.frombuffer(blob, np.uint8, blocks * BLOCK_BITS // 8, at + 4 + n)
            ranks = np.frombuffer(blob, "<u4", blocks, at + 4 + n + len(bits))
            self.levels.append((data, bits, ranks))
            at += 4 + n + len(bits) + 4 * blocks

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place ``i``."""
        _, bits, ranks = self.levels[level]
        block = i // BLOCK_BITS
        if block == len(ranks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        first = block * BLOCK_BITS // 8
        whole = int(np.bitwise_count(bits[first : i // 8]).sum())
        return int(ranks[block]) + whole + int(int(bits[i // 8]) & ((1 << i % 8) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = level = 0
        while True:
            data, bits, _ = self.levels[level]
            value |= int(data[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def slice(self, a: int, b: int, level: int = 0) -> np.ndarray:
        data, bits, _ = self.levels[level]
        out = data[a:b].astype(np.uint32)
        more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
        if more.any():
            first = self._rank(level, a)
            out[more] |= self.slice(first, first + int(more.sum()), level + 1) << np.uint32(8)
        return out


# How the files of word tokenizers normalise and split a text. Nothing in them looks across white space.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(path: str) -> bool:
    """Whether the tokenizer at ``path`` is known to encode a text word by word."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    return made.get("normalizer") == WORD_NORMALIZER and made.get("pre_tokenizer") == WORD_SPLIT


class TextEncoder:
    """The ids of whole texts by any tokenizer, each text given to the library as it is."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's with the end id, and the number of ids of each text."""
        found = [self.tokenizer.encode(t, add_special_tokens=False).ids + [self.end_id] for t in texts]
        return np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64)


class WordEncoder:
    """The ids of whole texts from those of their words, for tokenizers that never join text across white space.

    ``word_bpe_49k.json`` drops white space and looks at letters, digits and other signs within a word only,
    so the ids of a text are those of its words in turn; each distinct word goes to the library once. The store
    of words is emptied at ``limit`` words, which bounds memory and changes no id.
    """

    def __init__(self, path: str, end_id: int, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.limit = Tokenizer.from_file(path), end_id, limit
        self.clear()

    def clear(self) -> None:
        # No word is empty, so b"" can stand for the end of a document.
        self.at, self.ids, self.start = {b"": 0}, array("I", [self.end_id]), array("q", [0, 1])

    def _encode(self, word: bytes) -> list[int]:
        if word.isalpha():  # ASCII letters: one piece for the model, and its byte-level form is itself
            return [t.id for t in self.tokenizer.model.tokenize(word.lower().decode())]
        stem = word[:-1]
        if word[-1:] in (b".", b",") and stem.isalpha():
            return self._encode(stem) + self._encode_text(word[-1:])
        return self._encode_text(word)

    def _encode_text(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's with the end id, and the number of ids of each text."""
        words: list[bytes] = []
        sizes = np.empty(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            b = t.encode("utf-8")
            # Lower case gives fewer distinct words; where it might matter (marks that join letters, names of special tokens) the library does it alone.
            part = (b.lower() if t.isascii() and "<|" not in t else b).split()
            words += part
            words.append(b"")
            sizes[i] = len(part) + 1
        if len(self.at) > self.limit:
            self.clear()
        found = list(map(self.at.get, words))
        if None in found:
            for j, x in enumerate(found):
                if x is None:
                    w = words[j]
                    x = self.at.get(w)
                    if x is None:
                        x = self.at[w] = len(self.at)
                        self.ids.extend(self._encode(w))
                        self.start.append(len(self.ids))
                    found[j] = x
        at = np.fromiter(found, dtype=np.int64, count=len(found))
        start, ids = np.frombuffer(self.start, dtype=np.int64), np.frombuffer(self.ids, dtype=np.uint32)
        begin, n = start[at], start[at + 1] - start[at]
        ends = np.cumsum(n)
        out = ids[np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        del start, ids  # they lock the arrays' size
        per = np.add.reduceat(n, np.cumsum(sizes) - sizes) if len(sizes) else sizes
        return out, per


_ENCODERS: dict = {}


def encoder(path: str, end_id: int) -> WordEncoder | TextEncoder:
    """One for each Python worker, kept from task to task; by words only where the tokenizer allows it."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = (WordEncoder if by_words(path) else TextEncoder)(path, end_id)
    return _ENCODERS[path, end_id]


_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("codes", pa.binary())])
_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _write_task(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, end_id), TaskContext.get().partitionId()
        shard = start = 0
        held_ids, held_docs, held_sizes, n = [], [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held_ids)
            return rows_of(_SHARD, part=[part], shard=[shard], start=[start], n_ids=[n], doc_ids=[held_docs], doc_sizes=[np.concatenate(held_sizes).tolist()], codes=[dac_encode(ids)])

        for rows, texts in slices(batches):
            ids, sizes = encode(texts)
            held_ids.append(ids.astype(np.uint32))
            held_docs += rows.column("doc_id").to_pylist()
            held_sizes.append(sizes)
            n += len(ids)
            if n >= SHARD_IDS:
                yield row()
                shard, start, n = shard + 1, start + n, 0
                held_ids, held_docs, held_sizes = [], [], []
        if held_docs:
            yield row()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 1) -> None:
    """Encodes ``docs(doc_id, text)`` and writes the files to ``out``, ids in ascending order of doc_id.

    Null ids come first; rows that share an id are ordered by a hash of the text and otherwise as they come.
    A null text is empty; an empty text still has its end id. An empty table gives a table without shards.
    """
    rows = picked(docs, doc_id="long", text="string").withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = parts.mapInArrow(_write_task(tokenizer_path, end_id), "part int, shard int, start long, n_ids long, doc_ids array<long>, doc_sizes array<long>, codes binary")
    shards.write.mode("overwrite").option("compression", "zstd").parquet(out)


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            dac, sizes = Dac(row["codes"]), np.array(row["doc_sizes"], dtype=np.int64)
            ids = dac.slice(0, len(dac)).astype("<u4")
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(ids[b - s : b]) for b, s in zip(ends.tolist(), sizes.tolist())]
            yield rows_of(_DOC, doc_id=row["doc_ids"], start=row["base"] + ends - sizes, n_tokens=sizes, ids_crc32=crc)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files at ``path``."""
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each file's partition
    bases, base = [], 0
    for r in totals:
        bases.append((r["part"], base))
        base += r["n"]
    offsets = spark.createDataFrame(bases, "part int, before long")
    placed = shards.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("start")).alias("base"), "doc_ids", "doc_sizes", "codes")
    return placed.mapInArrow(_read_task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_dir(spark: SparkSession, label: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/strikegraph/{label}-{uuid.uuid4().hex}"
