"""Operator 10: byte-level BPE with Spark's higher-order functions.

Encoding a text: the split pattern cuts it into words; each distinct word's
bytes are folded, one ranked merge a step, by `aggregate` over an array of
pieces, where ranks come from a literal map; the ids of the words, in order,
are the ids of the text. Decoding looks up the binary piece of each id and
concatenates the pieces.

Texts are read in one pass without a shuffle. A Python stage splits some
`CHUNK_BYTES` of consecutive texts and hands on their distinct words that are
no pieces, as arrays of byte ids, and behind them the texts as word numbers;
Spark folds the words; a second Python stage puts the ids in the words' places.
What a task holds is bounded by the chunk, however large the partition is, and
a lost executor costs its tasks only. Words that a sample of the rows has most
often, at most `COMMON_WORDS`, are folded beforehand, once, so that not every
chunk folds them anew; this changes the time, not the result.

The rank map is one array of longs, the rows of the table of pairs laid over
one another so that none of their entries meet: two lookups find a pair or
tell that it has no rank. Array and pieces enter the plan as scalar subqueries
over one-row tables. Spark puts their values in place as literals before the
tasks start; plan texts, which the driver keeps, don't show them.

The fold's state is an array of the pieces with the ranks of their pairs, and
the least of these, so that a merge looks up only the two pairs that it makes.
Words of more than `LONG_WORD` bytes are first cut where no piece of the
vocabulary that occurs in them reaches across, which no merge can either; the
parts' ids follow one another.

Defined cases: a null text counts as empty, has no ids and decodes to nothing;
an empty table gives an empty table; rows of equal key stay rows of their own;
other columns are dropped. One text must fit in a Python worker with its
words, some 60 bytes each. A part of a long word that can't be cut (one letter
a hundred thousand times) takes time that grows with the square of its length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import bounded, lean, materialise, table

#: Letters and numbers that newer Unicode versions have beyond Unicode 16, to which the split keeps.
_NEWER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: In texts of these characters the classes are short lists, which the standard library matches faster.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-ɏ]*")
_PLAIN_CLASSES = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"\p{N}": "0-9²³¹¼½¾"}

#: Bytes of text whose words are made distinct together, and of those that are split at a time.
CHUNK_BYTES, STEP_BYTES = 16 << 20, 1 << 20
#: Words handed on in a row, ids put in place at a time, bytes beyond which a word is cut first, and rows decoded at a time.
ROW_WORDS, STEP_IDS, LONG_WORD = 8192, 1 << 18, 256
DECODED_ROWS = 256
#: Common words: at most so many, of at most so many characters, from a sample of that share of the rows.
COMMON_WORDS, COMMON_LENGTH, SAMPLE, SEED = 400_000, 64, 0.2, 1
#: Counts beyond this are as this.
HIGHEST = 4096
#: Of an entry of the fold's state: id, place and rank begin at bits 0, PLACE and RANK.
PLACE, RANK = 20, 42
_WORDS = pa.schema([("words", pa.list_(pa.list_(pa.int64()))), ("keys", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("codes", pa.binary())])


@functools.cache
def splitter(pattern: str):
    """A function from a text to its words, for a pattern with \\p{L}, \\p{N} and \\s."""
    ranges = lambda more: "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in more.split())
    plain, full = pattern, pattern
    for name, members in _PLAIN_CLASSES.items():
        plain = plain.replace(f"{name}+", f"[{members}]+").replace(name, members)
    spaces = "\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    letters, numbers = rf"[\p{{L}}--[{ranges(_NEWER_LETTERS)}]]", rf"[\p{{N}}--[{ranges(_NEWER_NUMBERS)}]]"
    for name, members in ((r"[^\s\p{L}\p{N}]", f"[^[{spaces}]||{letters}||{numbers}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]"), (r"\p{L}", letters), (r"\p{N}", numbers)):
        full = full.replace(name, members)
    plain_find, full_find = re.compile(plain).findall, regex.compile(full, regex.V1).findall
    return lambda text: plain_find(text) if _PLAIN.fullmatch(text) else full_find(text)


def load_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file by id; ids must be 0..n-1."""
    with open(path, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    if sorted(found) != list(range(len(found))) or not {bytes([i]) for i in range(256)} <= set(found.values()):
        raise ValueError("ids must be consecutive and hold all single bytes")
    return [found[i] for i in range(len(found))]


def rank_map(pieces: list[bytes]) -> np.ndarray:
    """The rank map as an array.

    Entry a < len(pieces) is where row a begins; a row's entry b is
    c << RANK | a if the pieces a and b make the piece c. Rows overlap where
    they have no entries. Ranks are ids. All lookups of ids are within the array.
    """
    ids = {p: i for i, p in enumerate(pieces)}
    rows: dict[int, list[tuple[int, int]]] = {}
    for piece, merged in ids.items():
        for cut in range(1, len(piece)):
            a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, merged))
    n = len(pieces)
    if n >= 1 << PLACE:
        raise ValueError("the vocabulary is too large")
    size = n + 4 * sum(map(len, rows.values())) + 1
    entries = np.full(size + n, -1, np.int64)  # no id has the low bits of -1
    begins = np.full(n, n + size, np.int64)  # of empty rows: behind all others
    draw = np.random.default_rng(0)
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        columns, merged = np.array(row, np.int64).T
        while True:
            at = int(draw.integers(0, size - int(columns.max())))
            if (entries[columns + at] < 0).all():
                break
        entries[columns + at] = merged << RANK | a
        begins[a] = n + at
    return np.concatenate([begins, entries])


def _constant(spark: SparkSession, values: pa.Array) -> Column:
    """An array that the plan holds as a value but doesn't print."""
    one = pa.table({"values": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)})
    return spark.createDataFrame(one).scalar()


def fold(words: Column, ranks: Column) -> Column:
    """The ids of words (arrays of byte ids) after all merges; ranks as `rank_map` has them.

    The state's array q has for each piece its id in the low bits and in the
    high ones the rank of its pair with the next piece. With places between
    them, the least entry m tells the merge: the first of the least rank.
    """
    ids, places, unranked, open_ = F.lit((1 << PLACE) - 1), F.lit((1 << RANK - PLACE) - 1), F.lit(1 << 62), F.lit(-1).cast("bigint")

    def body(table: Column) -> Column:
        def entry(a: Column, b: Column) -> Column:
            found = table[table[a] + b]
            return F.when(found.bitwiseAND(ids) == a, found).otherwise(a + unranked)

        def find(s: Column) -> Column:
            return F.struct(s.q.alias("q"), F.array_min(F.transform(s.q, lambda x, i: x + F.shiftleft(i.cast("bigint"), PLACE))).alias("m"))

        def merged(q: Column, c: Column, place: Column) -> Column:
            made = entry(c, F.get(q, place + 2).bitwiseAND(ids))
            return F.filter(F.transform(q, lambda x, i: F.when(i == place, made).when(i == place + 1, open_).when(i == place - 1, entry(x.bitwiseAND(ids), c)).otherwise(x)), lambda x: x >= 0)

        def merge(s: Column) -> Column:
            place = F.array(F.shiftright(s.m, PLACE).bitwiseAND(places).cast("int"))
            return F.struct(F.get(F.transform(place, lambda i: merged(s.q, F.shiftright(s.m, RANK), i)), F.lit(0)).alias("q"), open_.alias("m"))

        def one(word: Column) -> Column:
            begin = F.struct(F.transform(word, lambda a, i: entry(a, F.get(word, i + 1))).alias("q"), open_.alias("m"))
            # two steps a merge, which finds the least and carries it out; without a rank nothing changes
            return F.aggregate(F.concat(word, word), begin, lambda s, _: F.when(s.m < 0, find(s)).when(s.m < unranked, merge(s)).otherwise(s), lambda s: F.transform(s.q, lambda x: x.bitwiseAND(ids)))

        return F.transform(words, one)

    return F.get(F.transform(F.array(ranks), body), F.lit(0))


def _folded(rows: DataFrame, ranks: np.ndarray) -> DataFrame:
    """rows with words folded; higher-order functions take no subqueries themselves."""
    held = rows.withColumn("ranks", _constant(rows.sparkSession, pa.array(ranks)))
    return held.withColumn("words", fold(F.col("words"), F.col("ranks"))).drop("ranks")


def _common(rows: DataFrame, vocabulary: Vocabulary, ranks: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Words that a sample has most often, twice at least, and their ids; at most COMMON_WORDS."""
    counts = rows.sample(SAMPLE, SEED).mapInArrow(lean(functools.partial(_counted, vocabulary)), "word string, n long").groupBy("word").agg(F.least(F.sum("n"), F.lit(HIGHEST)).alias("n"))
    counts = materialise(counts.where("n > 1"))
    least, total = HIGHEST + 1, 0
    for row in counts.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():
        total += row["c"]
        if total > COMMON_WORDS:
            break
        least = row["n"]
    lists = counts.where(F.col("n") >= least).mapInArrow(functools.partial(_word_rows, vocabulary.bytes()), "word array<string>, words array<array<bigint>>")
    done = _folded(lists.repartition(rows.sparkSession.sparkContext.defaultParallelism), ranks).select("word", F.col("words").cast("array<array<int>>").alias("ids")).toArrow()
    return done["word"].combine_chunks().flatten(), done["ids"].combine_chunks().flatten()


def _word_rows(byte_ids: np.ndarray, batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_WORDS):
            words = batch.column("word").slice(at, ROW_WORDS)
            ends = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, _byte_ids(words.cast(pa.binary()), byte_ids))], ["word", "words"])


def encode(docs: DataFrame, pieces: list[bytes], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, ids) for each row of docs; keys may be null or repeated."""
    return _encoded(docs, pieces, pattern, key, text, "ids array<int>")


def _encoded(docs: DataFrame, pieces: list[bytes], pattern: str, key: str, text: str, schema: str, then: Callable = iter) -> DataFrame:
    """Key and the columns of schema, which `then` makes of batches (key, ids) where they arise."""
    ranks, vocabulary = rank_map(pieces), Vocabulary(pattern, pieces)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    words, ids = _common(rows, vocabulary, ranks)
    split = rows.mapInArrow(lean(functools.partial(_split, Vocabulary(pattern, pieces, words))), "words array<array<bigint>>, keys array<bigint>, ends array<bigint>, codes binary")
    placed = functools.partial(_placed, len(pieces), ids)
    return _folded(split, ranks).mapInArrow(lean(lambda batches: then(placed(batches))), f"key long, {schema}").withColumnRenamed("key", key)


class Vocabulary:
    """What splits and numbers words: below `first` a code is the id of a piece or len(pieces) + the number of a common word."""

    def __init__(self, pattern: str, pieces: list[bytes], common: pa.Array | None = None):
        self.pattern, self.pieces, self.common = pattern, tuple(pieces), common
        self.first = len(pieces) + (0 if common is None else len(common))

    def bytes(self) -> np.ndarray:
        ids = {p: i for i, p in enumerate(self.pieces) if len(p) == 1}
        return np.array([ids[bytes([i])] for i in range(256)], np.int64)

    def known(self) -> tuple[pa.Array, np.ndarray]:
        """Words and their codes: one that is a piece is that piece."""
        words, codes = [], []
        for i, piece in enumerate(self.pieces):
            try:
                words.append(piece.decode())
                codes.append(i)
            except UnicodeDecodeError:
                pass
        pieces = pa.array(words, pa.string())
        if self.common is None:
            return pieces, np.array(codes, np.int32)
        return pa.concat_arrays([pieces, self.common]), np.array([*codes, *range(len(self.pieces), self.first)], np.int32)


def _byte_ids(words: pa.Array, byte_ids: np.ndarray) -> pa.ListArray:
    """Binary words as lists of the ids of their bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.empty(0, np.uint8)
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(byte_ids[raw]))


def _counted(vocabulary: Vocabulary, batches):
    """Words that are no pieces, and how often they occur among some texts."""
    split, (known, _) = splitter(vocabulary.pattern), vocabulary.known()
    for _, texts, _ in bounded(batches, STEP_BYTES):
        found = pa.array([w for t in texts for w in split(t)], pa.string()).value_counts()
        words = found.field("values")
        own = pc.and_(pc.invert(pc.is_in(words, value_set=known)), pc.less_equal(pc.utf8_length(words), COMMON_LENGTH))
        yield pa.RecordBatch.from_arrays([words.filter(own), found.field("counts").filter(own)], ["word", "n"])


@functools.cache
def _long_word_cutter(pieces: tuple[bytes, ...]):
    """A function from a word's text to its parts; places that an occurring piece reaches across are no cuts."""
    import ahocorasick

    search = ahocorasick.Automaton()
    for piece in pieces:
        if len(piece) > 1:
            search.add_word(piece.decode("latin-1"), len(piece))
    search.make_automaton()

    def cut(word: bytes) -> list[bytes]:
        spans = np.zeros(len(word) + 1, np.int32)
        for last, size in search.iter(word.decode("latin-1")):
            spans[last - size + 2] += 1
            spans[last + 1] -= 1
        at = [0, *(np.flatnonzero(np.cumsum(spans)[1:-1] == 0) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(at, at[1:], strict=False)]

    return cut


class _Chunk:
    """Texts as codes: from vocabulary.first on the number of a word that is to be folded."""

    def __init__(self):
        self.keys: list[int | None] = []
        self.coded: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []

    def add(self, keys: list, words: list[list[str]]) -> None:
        self.keys += keys
        self.sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
        self.coded.append(pa.array([w for some in words for w in some], pa.string()).dictionary_encode())

    def rows(self, vocabulary: Vocabulary, known: tuple[pa.Array, np.ndarray], byte_ids: np.ndarray):
        """Rows of words to fold, then the row of the texts."""
        coded = pa.chunked_array(self.coded).unify_dictionaries()
        words = coded.chunk(0).dictionary
        place = pc.index_in(words, value_set=known[0])
        new = np.asarray(pc.is_null(place))
        long = np.asarray(pc.greater(pc.binary_length(words), LONG_WORD)) & new
        code = np.append(known[1], np.int32(0))[np.asarray(pc.fill_null(place, len(known[1])))]
        short = new & ~long
        code[short] = vocabulary.first + np.arange(short.sum())
        fold = [words.filter(pa.array(short)).cast(pa.binary())]
        numbers, parts = {}, []
        for i in np.flatnonzero(long).tolist():
            own = []
            for part in _long_word_cutter(vocabulary.pieces)(words[i].as_py().encode()):
                if len(part) >= 1 << RANK - PLACE:
                    raise ValueError("a word is too long")
                own.append(numbers.setdefault(part, vocabulary.first + len(fold[0]) + len(numbers)))
            code[i] = -1 - len(parts)
            parts.append(np.array(own, np.int32))
        fold.append(pa.array(list(numbers), pa.binary()))
        codes, sizes = np.concatenate([code[np.asarray(c.indices)] for c in coded.chunks]), np.concatenate(self.sizes)
        del coded
        self.coded.clear()
        if parts and len(codes):
            at = np.flatnonzero(codes < 0)
            owner = np.searchsorted(np.cumsum(sizes), at, side="right")
            runs, last = [], 0
            for i, d in zip(at.tolist(), owner.tolist(), strict=True):
                runs += [codes[last:i], parts[-1 - codes[i]]]
                sizes[d] += len(runs[-1]) - 1
                last = i + 1
            codes = np.concatenate([*runs, codes[last:]])
        for some in fold:
            for at in range(0, len(some), ROW_WORDS):
                lists = _byte_ids(some.slice(at, ROW_WORDS), byte_ids)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists), *(pa.nulls(1, f.type) for f in list(_WORDS)[1:])], schema=_WORDS)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (self.keys, np.cumsum(sizes))]
        raw = pa.BinaryArray.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, codes.nbytes], np.int32)), pa.py_buffer(codes.astype("<i4", copy=False))])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, _WORDS.field("words").type), *lists, raw], schema=_WORDS)


def _split(vocabulary: Vocabulary, batches):
    split, parts = splitter(vocabulary.pattern), (vocabulary, vocabulary.known(), vocabulary.bytes())
    chunk, size = _Chunk(), 0
    for keys, texts, n in bounded(batches, STEP_BYTES):
        chunk.add(keys, [split(t) for t in texts])
        size += n
        if size >= CHUNK_BYTES:
            yield from chunk.rows(*parts)
            chunk, size = _Chunk(), 0
    if chunk.keys:
        yield from chunk.rows(*parts)


def _placed(pieces: int, common: pa.Array, batches):
    """Ids of the texts, whose words' ids are in the rows before them."""
    offsets = common.offsets.to_numpy()
    flat = [np.arange(pieces, dtype=np.int32), common.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int32)]
    lengths = [np.ones(pieces, np.int64), np.diff(offsets).astype(np.int64)]
    for batch in batches:
        for row in range(batch.num_rows):
            words = batch.column("words")[row]
            if words.is_valid:
                lists = words.values
                offsets = lists.offsets.to_numpy()
                flat.append(lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int32))
                lengths.append(np.diff(offsets).astype(np.int64))
                continue
            keys, ends = batch.column("keys")[row].values, batch.column("ends")[row].values.to_numpy()
            codes = np.frombuffer(batch.column("codes")[row].as_buffer(), "<i4")
            ids, sizes = np.concatenate(flat), np.concatenate(lengths)
            firsts = np.cumsum(sizes) - sizes
            yield from _texts(keys, ends, codes, ids, sizes, firsts)
            flat, lengths = flat[:2], lengths[:2]


def _texts(keys: pa.Array, ends: np.ndarray, codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, firsts: np.ndarray):
    """(key, ids) of the texts, some STEP_IDS ids in a batch."""
    at = 0
    while at < len(ends):
        begin = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, begin + STEP_IDS, side="right")))
        some = codes[begin : ends[until - 1]]
        long = sizes[some]
        last = np.cumsum(long)
        place = np.repeat(firsts[some] - (last - long), long) + np.arange(last[-1] if len(last) else 0)
        cuts = np.concatenate(([0], last))[np.concatenate(([0], ends[at:until] - begin))]
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids[place], pa.int32()))
        yield pa.RecordBatch.from_arrays([keys.slice(at, until - at), lists], ["key", "ids"])
        at = until


class Decoder:
    """Texts of ids, by concatenating binary pieces."""

    def __init__(self, pieces: list[bytes]):
        self.raw = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: pa.ListArray) -> pa.Array:
        """A binary for each list of ids; null for null."""
        offsets = ids.offsets.to_numpy()
        flat = ids.values.to_numpy()[offsets[0] : offsets[-1]]
        long = self.sizes[flat]
        last = np.cumsum(long)
        raw = self.raw[np.repeat(self.firsts[flat] - (last - long), long) + np.arange(last[-1] if len(last) else 0)]
        ends = np.concatenate(([0], last))[offsets - offsets[0]]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
        return pc.if_else(ids.is_valid(), found, None) if ids.null_count else found


def decode(encoded: DataFrame, pieces: list[bytes], ids: str = "ids") -> DataFrame:
    """encoded with its bytes in column decoded, which may not exist; null ids decode to null."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def decoded(batches):
        of = Decoder(pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                some = batch.slice(at, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([*some.columns, of(some.column(ids)).cast(pa.binary())], [*some.schema.names, "decoded"])

    return encoded.mapInArrow(decoded, schema)


def digests(docs: DataFrame, pieces: list[bytes], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the decoded ids)."""

    def digested(batches):
        decimal, of = [str(i) for i in range(len(pieces))], Decoder(pieces)
        for batch in batches:
            ids = batch.column("ids")
            joined = [hashlib.sha256(",".join([decimal[i] for i in x.tolist()]).encode()).hexdigest() for x in (v.values.to_numpy() for v in ids)]
            texts = [hashlib.sha256(x.as_buffer()).hexdigest() for x in of(ids)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pc.list_value_length(ids).cast(pa.int64()), pa.array(joined), pa.array(texts)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, pieces, pattern, "doc_id", "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", digested)


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    pieces = load_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(table(spark, sf_dir, "documents"), pieces, public_tokenizers.PATTERN)
