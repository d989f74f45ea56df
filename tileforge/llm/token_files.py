"""Operator 5: token ids in binary blocks with Elias-Fano coded document boundaries.

A token file is a Parquet folder of blocks. A block holds the concatenated ids
of consecutive documents (little-endian, 2 bytes each where the vocabulary
allows it, else 4) and the ends of its documents as an Elias-Fano sequence:
the low bits packed, the high bits in unary, and the position of every 64th
set bit, packed to the bits that the last one needs. `EliasFano.select` reaches
any boundary by scanning a few bytes from the sample before it; readers get
all offsets from it. Boundaries take about 2 + log2(ids / documents) bits each
instead of 64. Blocks are numbered within shards; shards are ranges of doc_id,
so blocks in the order (shard, block) hold documents in ascending order.
Spark's own writer commits the folder, so lost executors and retried tasks
leave no trace.

Ids are those of the tokenizer's own encode. Where its file states a plain
byte-level BPE with that kind's usual split, words are split here and the
library's model is called for distinct words; all other files, texts with other
characters, and texts with the string of an added token (which is that token)
go to the library whole.

Defined cases: a null text counts as empty and has only the end id; null keys
come first; rows of equal keys are kept, in the order of their texts' hashes;
an empty table makes no blocks; extra columns are ignored; a text, however
long, is encoded whole and must fit in a worker.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, lean, scratch_dir, table

BLOCK_IDS = 1 << 20
SAMPLE = 64
#: Of each of two generations of words, each entry some 200 bytes; characters of text encoded at a time.
MEMO_WORDS, STEP_CHARS = 260_000, 3 << 20
#: Texts of these characters are split here, as the tokenizer's own pattern does; others are left to the library whole.
_KNOWN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-ɏ]*")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
SCHEMA = "shard int, block int, start long, n_ids long, width int, keys array<bigint>, ids binary, low_bits int, low binary, high binary, sample_bits int, samples binary"


def _pack(values: np.ndarray, bits: int) -> bytes:
    return np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8), bitorder="little").tobytes()


def _packed(raw: bytes, i: int, bits: int) -> int:
    first = i * bits
    return int.from_bytes(raw[first // 8 : (first + bits + 7) // 8], "little") >> (first % 8) & ((1 << bits) - 1)


class EliasFano:
    """A non-decreasing sequence of integers below 2**62."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, sample_bits: int, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.sample_bits, self.samples = n, low_bits, low, high, sample_bits, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", 0, b"")
        low_bits = max(0, int(values[-1] // n).bit_length() - 1)
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        sample_bits = max(1, int(ones[-1]).bit_length())
        return cls(n, low_bits, _pack(values, low_bits), np.packbits(bits, bitorder="little").tobytes(), sample_bits, _pack(ones[::SAMPLE], sample_bits))

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = _packed(self.samples, i // SAMPLE, self.sample_bits)
        left, byte = i % SAMPLE, at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | _packed(self.low, i, self.low_bits)

    def span(self, i: int) -> tuple[int, int]:
        """Begin and end of the i-th of the pieces that the values end."""
        return (self.select(i - 1) if i else 0), self.select(i)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _is_plain(file: dict) -> bool:
    """Whether words and their ids are what this module makes of them: byte-level BPE with the usual split and nothing beside it."""
    before, model = file.get("pre_tokenizer") or {}, file["model"]
    usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    nothing = not any([file.get("normalizer"), file.get("truncation"), file.get("padding"), model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("byte_fallback")])
    return bool(usual and nothing and model.get("type") == "BPE")


@functools.cache
def _encoder(path: str) -> _Encoder:
    """One for each worker process, whose memo serves all its tasks."""
    return _Encoder(path)


class _Encoder:
    """Ids of texts; each call looks up its distinct words only, and a bounded memo holds the words' ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = _is_plain(json.loads(self.tokenizer.to_str()))
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pack = {2: "H", 4: "I"}[self.type.itemsize]
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: from the memo, the older memo, or the library's model, whose input has a letter for each byte."""
        if len(self.memo) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        found = list(map(self.memo.get, words))
        memo, older, tokenize, letters, pack = self.memo, self.older, self.tokenizer.model.tokenize, self.letters, self.pack
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = older.get(word)
                if ids is None:
                    ids = array(pack, [t.id for t in tokenize(word.encode().decode("latin-1").translate(letters))]).tobytes()
                found[i] = memo[word] = ids
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        own = [t if self.plain and _KNOWN.fullmatch(t) and not any(a in t for a in self.added) else None for t in texts]
        split = [_SPLIT.findall(t) if t else [] for t in own]
        coded = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        parts = self._ids(coded.dictionary.to_pylist())
        flat, size = np.frombuffer(b"".join(parts), self.type), self.type.itemsize
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // size
        firsts = np.cumsum(lengths) - lengths
        word = np.asarray(coded.indices)
        long = lengths[word]
        ends = np.cumsum(long)
        raw = flat[np.repeat(firsts[word] - (ends - long), long) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        ends = np.concatenate(([0], ends)) * size
        cut = ends[np.cumsum([0] + [len(words) for words in split])].tolist()
        return [raw[i:j] if t is not None else np.asarray(self.tokenizer.encode(x, add_special_tokens=False).ids, self.type).tobytes() for t, x, i, j in zip(own, texts, cut, cut[1:], strict=False)]


def _blocks(path: str, end_id: int, block_ids: int):
    def write(batches):
        from pyspark import TaskContext

        encode, shard, block, start = _encoder(path), TaskContext.get().partitionId(), 0, 0
        end = np.asarray([end_id], encode.type).tobytes()
        keys: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def flush():
            nonlocal block, start, keys, parts, size
            ends = np.cumsum([len(p) // encode.type.itemsize for p in parts])
            ef = EliasFano.of(ends)
            row = {"shard": shard, "block": block, "start": start, "n_ids": int(ends[-1]), "width": encode.type.itemsize, "keys": keys, "ids": b"".join(parts), "low_bits": ef.low_bits, "low": ef.low, "high": ef.high, "sample_bits": ef.sample_bits, "samples": ef.samples}
            block, start, keys, parts, size = block + 1, start + int(ends[-1]), [], [], 0
            fields = [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("keys", pa.list_(pa.int64())), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("sample_bits", pa.int32()), ("samples", pa.binary())]
            return pa.RecordBatch.from_pylist([row], pa.schema(fields))

        for own, texts, _ in bounded(batches, STEP_CHARS):
            for key, ids in zip(own, encode(texts), strict=True):
                keys.append(key)
                parts.append(ids + end)
                size += len(ids) // encode.type.itemsize + 1
                if size >= block_ids:
                    yield flush()
        if keys:
            yield flush()

    return write


def write_token_file(docs: DataFrame, tokenizer_path: str, out: str, key: str = "doc_id", text: str = "text", end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every text and writes the blocks to folder `out` in ascending order of key."""
    pieces = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(pieces, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(lean(_blocks(tokenizer_path, end_id, block_ids)), SCHEMA).write.parquet(out)


def _boundaries(row: dict) -> EliasFano:
    return EliasFano(len(row["keys"]), row["low_bits"], row["low"], row["high"], row["sample_bits"], row["samples"])


def _documents(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            ids, ends = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4"), _boundaries(row)
            spans = [ends.span(i) for i in range(ends.n)]
            columns = [pa.array([row["shard"]] * ends.n, pa.int32()), pa.array(row["keys"], pa.int64()), pa.array([row["start"] + a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "in_shard", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """key and ids of the documents of these keys, each fetched from its block by its boundaries."""
    wanted = set(keys)

    def found(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ends, ids = _boundaries(row), np.frombuffer(row["ids"], f"<u{row['width']}")
                own = [(key, ids[slice(*ends.span(i))]) for i, key in enumerate(row["keys"]) if key in wanted]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([x.astype(np.int64) for _, x in own], pa.list_(pa.int64()))], ["key", "ids"])

    blocks = spark.read.parquet(path).where(F.arrays_overlap("keys", F.array(*[F.lit(k).cast("long") for k in keys])))
    return blocks.mapInArrow(found, "key long, ids array<long>")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document: key, start, n_tokens and ids_crc32, all from the blocks.

    Each shard's total, one number, gives the shards' first positions.
    """
    blocks = spark.read.parquet(path)
    first, at = [], 0
    for row in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        first.append((row["shard"], at))
        at += row["n"]
    starts = spark.createDataFrame(first, "shard int, first long")
    found = blocks.mapInArrow(_documents, "shard int, key long, in_shard long, n_tokens long, ids_crc32 long").join(F.broadcast(starts), "shard")
    return found.select("key", (F.col("first") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_file(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    out = scratch_dir(spark)
    write_token_file(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_token_file(spark, out).withColumnRenamed("key", "doc_id")
