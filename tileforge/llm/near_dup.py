"""Operator 6: near-duplicates by bottom-k sketches from one hash function.

Texts are linked when their sets of 5-word shingles have a Jaccard similarity
of 0.75 or more; linked texts form components, of which one document stays.

1. Each text is hashed once: its set of shingle hashes, of which the `K` least
   are the sketch. Texts with equal sets form a class, which goes on as one
   under the row number of its first text.
2. Inverted lists hold the classes that retain a value. Two linked classes
   share at least c of their retained values: exactly 3/4 of a set of up to
   48, else 29 of 64, which a linked pair misses with a chance of 1e-7. So
   a class is listed only under its rarest values, all but c - 1 of them
   (values that no other class retains are rarest and need no list).
3. In each list every member is paired with one pivot, a random member that
   differs by list. Pairs whose union sketch puts the similarity six standard
   deviations below 0.75 go, which never asks for more than step 2 does; the others are verified on full sets.
4. What one round of joining these links puts together needs no further pairs.
   Only lists whose members lie in different components are searched for the
   pairs that pivots missed: short ones pair by pair. Members of long ones,
   texts that share a common passage, are listed anew among themselves under
   the rarest of `REFINED` retained values each (all their shingles, if they
   have no more), where only texts meet that share most of what they have;
   steps 3 and 4 are made again there. What is still long and open goes in
   blocks, where products of two incidence matrices, some columns at a time,
   give all intersections of two blocks. So a group of any number of copies
   costs one pair for each member and list, and no link between different
   texts is lost.

Sets, lists, links and components stay distributed; the driver sees counts.

Defined cases: a null text, or one without words, has no shingles and is
linked with nothing, and stays; fewer than five words are one shingle; rows of
equal id and different texts are different documents; of rows of equal id and
text, or without an id, one is a document like any other. The row that stays of
a component is the first by (doc_id, nulls last, text hash), and nulls never
name a component that has other ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialise, slices, table

K = 64
WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4
LEAST_SHARED = 29
#: Values of members of long lists, and the least that two of them share: six deviations below three quarters.
REFINED, LEAST_REFINED = 512, 325
#: At 64 values six deviations keep pairs that share 28, one less than the lists ask for.
DEVIATIONS = 6
#: Of the union sketch, what a pair shares that is verified first, so that most of them are linked.
LIKELY_SHARE = 0.8
LONG_LIST = 64
#: A block's members and shingles, and the columns of a product.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 200_000, 4096
MEMO_WORDS = 150_000
#: Bytes of text hashed at a time.
STEP_BYTES = 2 << 20
#: Bits for each key of a filter, those set for it, and the most in all (8 MB); a filter of more than a quarter as many keys isn't made.
KEY_BITS, KEY_PLACES, MAX_BITS = 16, 3, 1 << 26


class _Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; words keep their hash in a bounded memo."""

    _MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            found = self.memo[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.int64)
        hashes = np.fromiter(map(self._hash, words), np.uint64, len(words))
        size = min(WORDS, len(words))
        n = len(words) - size + 1
        mixed = np.full(n, size, np.uint64)
        for k in range(size):
            mixed ^= hashes[k : k + n] * self._MIX[k]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed.view(np.int64))


def _digest(s: np.ndarray) -> bytes | None:
    """What tells a class; texts without shingles are in none."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketches(batches):
    shingles = _Shingler()
    for batch in (part for whole in batches for part in slices(whole, STEP_BYTES)):
        sizes, keys, sketches = [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py())
            sizes.append(len(s))
            keys.append(_digest(s))
            sketches.append(s[:K])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "th", "n", "key", "sketch"])


def _sets(batches):
    shingles = _Shingler()
    for batch in (part for whole in batches for part in slices(whole, STEP_BYTES)):
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "s"])


def _lists(classes: DataFrame, k: int = K, least_shared: int = LEAST_SHARED) -> DataFrame:
    """v, cls, n: the inverted lists of values that two classes retain (k at most), without the c - 1 commonest of each class."""
    values = classes.select("cls", F.explode("sketch").alias("v"))
    shared = materialise(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    some = values if shared.count() * 4 > MAX_BITS else _likely(values, ["v"], shared)  # most values are no other class's
    by_class = some.join(shared, "v").repartition("cls").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("x"))  # else each row is shuffled as a list of one
    by_class = by_class.join(classes.select("cls", "n"), "cls")
    least = f"if(n <= {k * NUMERATOR // DENOMINATOR}, (n * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR}, {least_shared})"
    kept = by_class.withColumn("keep", F.expr(f"cast(size(x) - {least} + 1 as int)")).where("keep > 0")
    return kept.select("cls", "n", F.explode(F.expr("slice(x, 1, keep)")).alias("y")).select(F.col("y.v").alias("v"), "cls", "n")


def _likely(df: DataFrame, columns: list[str], wanted: DataFrame) -> DataFrame:
    """Rows of df whose columns are among those of wanted, and a few more.

    The filter is a bit set, packed on the executors into one row, which is
    all that is broadcast: 2 to 4 bytes a key, where a hash table takes 100.
    """
    keys = wanted.count()
    if keys * 4 > MAX_BITS:
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
        return df.join(wanted.select(*(F.col(c).alias(f"__{c}") for c in columns)), same, "left_semi")
    bits = min(max(1 << (KEY_BITS * keys).bit_length(), 1 << 12), MAX_BITS)
    places = [F.expr(f"pmod(xxhash64({', '.join(columns)}, {k}), {bits}L)") for k in range(KEY_PLACES)]
    longs = wanted.select(F.explode(F.array(*places)).alias("b")).groupBy(F.expr("b div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("x"))
    longs = df.sparkSession.range(bits // 64).select(F.col("id").alias("at")).join(longs, "at", "left").select("at", F.coalesce("x", F.lit(0)).alias("x"))
    parts = longs.groupBy(F.expr("at div 1024").alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("xs"))
    row = materialise(parts.agg(F.expr("flatten(transform(sort_array(collect_list(struct(part, xs.x as xs))), p -> p.xs))").alias("__bits")))
    there = " and ".join(f"(shiftrightunsigned(__bits[cast(__b{k} div 64 as int)], cast(__b{k} % 64 as int)) & 1L) = 1L" for k in range(KEY_PLACES))
    return df.withColumns({f"__b{k}": place for k, place in enumerate(places)}).join(F.broadcast(row), F.expr(there)).select(*df.columns)


_RATIO = f"least(n_a, n_b) * {DENOMINATOR} >= greatest(n_a, n_b) * {NUMERATOR}"


def _plausible(pairs: DataFrame, classes: DataFrame, k: int = K) -> DataFrame:
    """Pairs (a, b) whose sizes and union sketch allow a link, and the share of the sketch that is common."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_RATIO)
    both = both.withColumn("u", F.expr(f"slice(array_sort(array_union(s_a, s_b)), 1, {k})"))
    share = "size(array_intersect(u, array_intersect(s_a, s_b))) / size(u)"
    return both.where(f"{share} >= {NUMERATOR / DENOMINATOR} - {DEVIATIONS} * 0.4331 / sqrt(size(u))").select("a", "b", F.expr(share).alias("share"))


def _links(pairs: DataFrame, sets: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Those pairs that are linked, by their full sets (cls, s), or (key, s) where members (cls, key) are given.

    By keys, sets that were made distinct by them aren't shuffled once more.
    """
    key = "key" if members else "cls"
    if members:
        sets = sets.dropDuplicates(["key"])
        for x in "ab":
            pairs = pairs.join(members.select(F.col("cls").alias(x), F.col("key").alias(f"key_{x}")), x)
    else:
        pairs = pairs.withColumns({"key_a": F.col("a"), "key_b": F.col("b")})
    side = lambda x: sets.select(F.col(key).alias(f"key_{x}"), F.col("s").alias(f"s_{x}"))
    both = pairs.join(side("a"), "key_a").join(side("b"), "key_b").withColumn("i", F.size(F.array_intersect("s_a", "s_b")))
    return both.where(f"i * {DENOMINATOR} >= (size(s_a) + size(s_b) - i) * {NUMERATOR}").select("a", "b")


def _spanned(pairs: DataFrame, sets: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Links among the pairs (a, b, share) that connect all that their links connect.

    One pair of each class is verified first, if it can one that is surely
    linked, and with the same few classes; of the others only those whose ends
    these don't connect, and whose words allow it. So a group costs some one
    set for each member, where all pairs with its pivots cost one for each pair.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "share").union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "share"))
    hubs = both.groupBy("x").agg(F.min_by("y", F.struct(F.col("share") < LIKELY_SHARE, F.xxhash64("y"))).alias("y"))
    first = materialise(hubs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    links = materialise(_links(first, sets, members))
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    found = components(links, complete=False)
    for x in "ab":
        rest = rest.join(found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")), x, "left")
    rest = materialise(rest.where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b"))
    members = materialise((members if members else sets.withColumn("key", F.col("cls"))).join(_members(rest), "cls", "left_semi").select("cls", "key"))
    if "key" not in sets.columns:
        sets = sets.withColumnRenamed("cls", "key")
    rest = materialise(_possible(rest, _likely(sets, ["key"], members), members))
    members = members.join(_members(rest), "cls", "left_semi")
    return links.union(_links(rest, _likely(sets, ["key"], materialise(members)), members))


def _possible(pairs: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs that may be linked by 16 bits of each shingle, a quarter of what their sets take; no link goes.

    A common shingle has common bits, and is the only one with them but for
    those that a set has twice; so the bits that two sets share and the fewer
    of their repeats bound the intersection.
    """
    bits = "array_distinct(transform(s, x -> cast((x & 65535) - 32768 as smallint)))"
    short = materialise(sets.selectExpr("key", f"{bits} as w", "size(s) as n").dropDuplicates(["key"]).join(members, "key").select("cls", "n", "w"))
    side = lambda x: short.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("w").alias(f"w_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("i", F.expr("size(array_intersect(w_a, w_b)) + least(n_a - size(w_a), n_b - size(w_b))"))
    return both.where(f"i * {DENOMINATOR} >= (n_a + n_b - i) * {NUMERATOR}").select("a", "b")


def components(edges: DataFrame, complete: bool = True) -> DataFrame:
    """node, component (its least node) for all nodes of the edges (a, b).

    Alternates the large-star and small-star steps, which link a node's
    neighbours to the least of them, until the edges are stars and stay so.
    Unless complete, one round is made: equal components are connected then,
    but not all that is connected has equal components.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("u", "w")).select("u", "m"))
        edges = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")))
        small = edges.join(least, "u").select(F.greatest("v", "m").alias("u2"), F.col("m").alias("v2")).where("u2 <> v2").union(least)
        edges = materialise(small.toDF("u", "v").distinct())
        if not complete:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after


def _block_links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between components within one pair of blocks of a long list; one for each two components."""
    value, left_block, right_block = key
    left, right = rows[rows["block"] == left_block], rows[rows["block"] == right_block]
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        sets = [*left["s"], *right["s"]]
        sizes = np.array([len(x) for x in sets])
        _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        common = (count > 1)[number]
        owner, column = owner[common], (np.cumsum(count > 1) - 1)[number[common]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[owner[part], column[part] - at] = 1
            shared += m[: len(left)] @ m[len(left) :].T
        na, nb = sizes[: len(left)], sizes[len(left) :]
        linked = shared * DENOMINATOR >= (na[:, None] + nb[None, :] - shared) * NUMERATOR
        ca, cb = left["comp"].to_numpy(), right["comp"].to_numpy()
        seen = set()
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = sorted((ca[i], cb[j]))
            if x != y and (x, y) not in seen:
                seen.add((x, y))
                out.append((left["cls"].iloc[i], right["cls"].iloc[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return _rows(docs).drop("th")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay; they are told by (doc_id, text hash), also where the id is null."""
    keys = _rows(docs).groupBy("doc_id", "th").agg(F.max("kept").alias("kept"), F.max(F.col("n_shingles") > 0).alias("linkable"), F.count("*").alias("c"))
    keys = materialise(keys.where("not kept or (linkable and c > 1)").withColumnsRenamed({"doc_id": "__id", "th": "__key"}))
    rows = docs.withColumn("__th", F.xxhash64("text"))
    of = lambda some: [F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__key")), some]
    gone, repeated = keys.where("not kept"), keys.where("kept")
    if not repeated.isEmpty():
        once = rows.join(repeated, *of("left_semi")).dropDuplicates(["doc_id", "__th"])
        return rows.join(keys, *of("left_anti")).union(once).drop("__th")
    return rows.join(gone, *of("left_anti")).drop("__th")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept: one row of each component is kept, and all rows without shingles."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    own = materialise(rows.mapInArrow(lean(_sketches), "doc_id long, th long, n long, key binary, sketch array<bigint>").withColumn("row", F.monotonically_increasing_id()))
    classes = materialise(own.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th", "row")).alias("f"), F.min("n").alias("n"), F.first("sketch").alias("sketch")).select(F.col("f.row").alias("cls"), "n", "sketch", F.col("f.doc_id").alias("first_id"), F.col("f.th").alias("th"), "key"))

    def sets_of(members: DataFrame) -> DataFrame:
        """key, s of the members (cls, key, doc_id, th), some of them more than once, and of a few other texts."""
        return materialise(_likely(rows, ["doc_id", "th"], members).select("text").mapInArrow(lean(_sets), "key binary, s array<bigint>"))

    def members_of(wanted: DataFrame) -> DataFrame:
        return materialise(wanted.join(classes, "cls").select("cls", "key", F.col("first_id").alias("doc_id"), "th"))

    lists = materialise(_lists(classes))
    pairs = materialise(_pivoted(lists))
    tried = materialise(_plausible(pairs, _likely(classes, ["cls"], _members(pairs))))
    members = members_of(_members(tried))
    links = materialise(_spanned(tried, sets_of(members), members))
    short, long = _open(lists, links)
    pairs = materialise(_pairs(short).join(tried, ["a", "b"], "left_anti"))
    missed = materialise(_plausible(pairs, _likely(classes, ["cls"], _members(pairs))))
    members = members_of(_members(missed).union(long.select("cls")).distinct())
    sets = materialise(sets_of(members).dropDuplicates(["key"]).join(members, "key").select("cls", "s"))
    links = materialise(links.union(_links(missed, sets)))
    if not long.isEmpty():
        links = materialise(links.union(_refined(long, sets, links)))
    found = components(links)

    least_id = classes.select("cls", "first_id", "th", "key").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least_id = materialise(least_id)
    names = materialise(least_id.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "th", "cls")).alias("f")).select("component", F.col("f.first_id").alias("component_id"), F.col("f.cls").alias("first")))
    named = materialise(least_id.join(names, "component").select("key", "component_id", "first"))
    out = own.select("doc_id", "th", "row", "n", "key").join(named, "key", "left")
    name = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), name.alias("component_id"), F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("kept"))


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()


def _pivoted(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's members with a random one of them, where sizes allow a link."""
    least = lambda c: F.min_by(c, F.xxhash64("cls", "v"))
    pivots = materialise(lists.groupBy("v").agg(least("cls").alias("pivot"), least("n").alias("n_b"), F.count("*").alias("c")).where("c > 1").select("v", "pivot", "n_b"))
    near = lists.withColumnRenamed("n", "n_a").join(pivots, "v").where("cls <> pivot").where(_RATIO)
    return near.select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()


def _open(lists: DataFrame, links: DataFrame, complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """v, cls, n, comp, c and total (of shingles) of the lists with members in different components: short and long ones."""
    found = components(links, complete)  # unless complete, the least node has none of its own, so it stands for itself
    placed = materialise(lists.join(found.select(F.col("node").alias("cls"), "component"), "cls", "left").select("v", "cls", "n", F.coalesce("component", "cls").alias("comp")))
    mixed = materialise(placed.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("total")).where("lo < hi").select("v", "c", "total"))
    both = materialise(placed.join(mixed, "v"))
    return both.where(f"c <= {LONG_LIST}"), both.where(f"c > {LONG_LIST}")


def _pairs(short: DataFrame) -> DataFrame:
    """All pairs (a, b) within short lists whose components differ and whose sizes allow a link."""
    a, b = (short.select("v", F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    return a.join(b, "v").where("a < b and comp_a <> comp_b").where(_RATIO).select("a", "b").distinct()


def _refined(long: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """The links between members of long lists that join components, up to what other links give."""
    classes = materialise(long.select("cls", "n").distinct().join(sets, "cls").select("cls", "n", F.slice("s", 1, REFINED).alias("sketch")))
    lists = materialise(_lists(classes, REFINED, LEAST_REFINED))
    sketches = classes.withColumn("sketch", F.slice("sketch", 1, K))  # most sets have no more than REFINED shingles, so that a longer sketch costs what its set does
    tried = materialise(_plausible(_pivoted(lists), sketches))
    found = materialise(_spanned(tried, sets))
    short, rest = _open(lists, links.union(found), complete=True)
    missed = _plausible(_pairs(short).join(tried, ["a", "b"], "left_anti"), sketches)
    blocks = rest.withColumn("blocks", F.expr(f"cast(ceil(greatest(c / {BLOCK}, total / {BLOCK_SHINGLES})) as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    dealt = blocks.select("v", "cls", "comp", "block", F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, block) as x, greatest(o, block) as y))")).alias("p")).select("v", "p.x", "p.y", "block", "cls", "comp")
    in_blocks = dealt.join(sets, "cls").groupBy("v", "x", "y").applyInPandas(_block_links, "a long, b long")
    return found.union(_links(missed, sets)).union(in_blocks)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and the closure of their links.
OP6_SQL = """
with recursive docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), shingles as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from docs where len(w) > 0)
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), edges as (
    select a, b from links union all select b, a from links
), reached(doc_id, c) as (
    select doc_id, doc_id from documents union select edges.b, reached.c from reached join edges on edges.a = reached.doc_id
), named as (
    select doc_id, min(c) as component_id from reached group by doc_id
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from named left join sizes using (doc_id)
"""
