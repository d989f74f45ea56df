"""Operator 7: benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of a-z, 0-9 and characters from U+0080 up, after lower-casing
A-Z. Every 10 consecutive words of a benchmark item are a window (an item with
fewer words is one window). Every place of every document is held against a
bit set of the windows' first two words (or their one); where that passes, the
window's words are hashed and looked up in the hash set; what is found is
verified word by word.

The hash set is broadcast where the benchmark's windows are at most
`BROADCAST_WINDOWS` and, with their items' ids, some `BROADCAST_BYTES`; a larger
benchmark is joined by shuffling the hashes.
Documents are matched with their hits by row key (doc_id and text hash), so
repeated rows get equal results.

Defined cases: null or empty texts and items have no words; items with a null
item_id still mark words but aren't counted as items; equal items are counted
each; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

WINDOW = 10
BROADCAST_WINDOWS = 1_000_000
#: Of the windows' words and item ids, with what a row and an array take beside them.
BROADCAST_BYTES = 128 << 20
#: Of the bit set, which is a literal: 8 for each of a million windows. With many more, more places pass.
MAX_BITS = 1 << 23
#: The characters of words once A-Z are lower-cased. Java matches a class of a few ranges ten times faster than the complement of the others.
_IN_WORD = r"0-9a-z\x{80}-\x{10FFFF}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str = "text") -> Column:
    return F.expr(f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), r'[{_IN_WORD}]+', 0)")


def _gram_hash(words: str, start: str, n: int) -> str:
    return "xxhash64(" + ", ".join(f"{words}[{start} + {k}]" for k in range(n)) + ")"


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: __len, __hash, __window (its words) and __items (their ids)."""
    split = items.select("item_id", words_of().alias("w")).where(F.size("w") > 0)
    cut = split.select("item_id", F.explode(F.expr(f"if(size(w) < {window}, array(w), transform(sequence(0, size(w) - {window}), i -> slice(w, i + 1, {window})))")).alias("__window"))
    found = cut.groupBy("__window").agg(F.collect_set("item_id").alias("__items")).withColumn("__len", F.size("__window"))
    return found.withColumn("__hash", F.expr("case __len " + " ".join(f"when {n} then {_gram_hash('__window', '0', n)}" for n in range(1, window + 1)) + " end"))


def _first_words_filter(windows: DataFrame, n: int, count: int) -> str:
    """SQL that says whether a window of n words from place i of w can be one of the windows; true too often, never false wrongly."""
    first = min(n, 2)
    bits = min(max(1 << (32 * count).bit_length(), 1 << 12), MAX_BITS)
    places = windows.where(F.col("__len") == n).select(F.expr(f"pmod({_gram_hash('__window', '0', first)}, {bits}L)").alias("b"))
    packed = [0] * (bits // 64)
    for row in places.groupBy(F.expr("b div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("word")).collect():
        packed[row["at"]] = row["word"]
    longs = ",".join(map(str, packed))
    return f"aggregate(array(pmod({_gram_hash('w', 'i', first)}, {bits}L)), false, (z, b) -> (shiftrightunsigned(from_json('[{longs}]', 'array<bigint>')[b div 64], cast(b % 64 as int)) & 1L) = 1L)"


def _can_broadcast(windows: DataFrame) -> bool:
    text = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.octet_length(x.cast("string")) + 16)
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(text("__window") + text("__items") + 100), F.lit(0)).alias("bytes")).first()
    return size["n"] <= BROADCAST_WINDOWS and size["bytes"] <= BROADCAST_BYTES


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, hits (sorted word positions) and item_ids (those with a window in the text)."""
    windows = materialise(windows_of(items, window))
    sizes = {r["__len"]: r["n"] for r in windows.groupBy("__len").agg(F.count("*").alias("n")).collect()}
    small = _can_broadcast(windows)
    keyed = docs.withColumns({"__text_hash": F.xxhash64("text"), "__doc": F.col("doc_id")})
    split = keyed.select("__doc", "__text_hash", words_of().alias("w"))
    hits = None
    for n in sorted(sizes):
        own = windows.where(F.col("__len") == n).select("__hash", "__window", "__items")
        own = F.broadcast(own) if small else own
        places = f"filter(sequence(0, size(w) - {n}), i -> {_first_words_filter(windows, n, sizes[n])})"
        places = f"if(size(w) < {n}, array(), transform({places}, i -> struct(i as pos, {_gram_hash('w', 'i', n)} as hash)))"
        cut = split.select("__doc", "__text_hash", F.explode(F.expr(places)).alias("x")).select("__doc", "__text_hash", F.col("x.pos").alias("__pos"), F.col("x.hash").alias("__hash"))
        one = cut.join(own, "__hash").select("__doc", "__text_hash", F.struct("__pos", "__window", "__items").alias("__hit"))
        hits = one if hits is None else hits.unionByName(one)
    counted = keyed.withColumn("n_words", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[A-Z{_IN_WORD}]+")).cast("long"))
    if hits is None:
        return counted.withColumns({"n_hit": F.lit(0).cast("long"), "hits": F.expr("cast(array() as array<int>)"), "item_ids": F.expr("cast(array() as array<string>)")}).drop("__doc", "__text_hash")
    by_doc = hits.groupBy("__doc", "__text_hash").agg(F.collect_set("__hit").alias("__hits")).withColumnsRenamed({"__doc": "__doc2", "__text_hash": "__text_hash2"})
    joined = keyed.join(by_doc, F.col("__doc").eqNullSafe(F.col("__doc2")) & F.col("__text_hash").eqNullSafe(F.col("__text_hash2")), "left")
    counted = joined.withColumn("n_words", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[A-Z{_IN_WORD}]+")).cast("long"))
    split = counted.withColumn("__w", F.when(F.col("__hits").isNotNull(), words_of()))
    true = split.withColumn("__hits", F.expr("filter(coalesce(__hits, array()), h -> slice(__w, h.__pos + 1, size(h.__window)) = h.__window)"))
    true = true.withColumn("hits", F.expr("array_sort(array_distinct(flatten(transform(__hits, h -> sequence(h.__pos, h.__pos + size(h.__window) - 1)))))"))
    true = true.withColumn("item_ids", F.expr("array_sort(array_distinct(flatten(transform(__hits, h -> transform(h.__items, i -> cast(i as string))))))"))
    return true.withColumn("n_hit", F.size("hits").cast("long")).drop("__w", "__hits", "__doc", "__doc2", "__text_hash", "__text_hash2")


def decontaminate(docs: DataFrame, items: DataFrame, by: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents, or with the hit words cut out of their texts (by="spans").

    Spaces and punctuation between two removed words go with them. All columns
    of docs stay as they are, also those named like the ones of find_hits.
    """
    if by not in ("documents", "spans"):
        raise ValueError("by must be documents or spans")
    if own := {c: f"__own_{c}" for c in docs.columns if c in ("n_words", "n_hit", "hits", "item_ids")}:
        return decontaminate(docs.withColumnsRenamed(own), items, by, window).withColumnsRenamed({b: a for a, b in own.items()})
    found = find_hits(docs, items, window)
    if by == "documents":
        return found.where("n_hit = 0").select(*docs.columns)
    pieces = found.withColumn("__pieces", F.expr(f"regexp_extract_all(text, r'[A-Z{_IN_WORD}]+|[^A-Z{_IN_WORD}]+', 0)"))
    pieces = pieces.withColumn("__first", F.expr(f"if(text rlike r'^[A-Z{_IN_WORD}]', 0, 1)"))
    at = "cast((j - __first) div 2 as int)"
    kept = pieces.withColumn("__kept", F.expr(f"filter(__pieces, (p, j) -> if((j - __first) % 2 = 0, not array_contains(hits, {at}), j < __first or not (array_contains(hits, {at}) and array_contains(hits, {at} + 1))))"))
    return kept.withColumn("text", F.when(F.col("n_hit") > 0, F.array_join("__kept", "")).otherwise(F.col("text"))).select(*docs.columns)


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = f"""
with docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), items as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), windows as (
    select distinct item_id, len(w[i : i + {WINDOW} - 1]) as n, array_to_string(w[i : i + {WINDOW} - 1], ' ') as g
    from (select item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) as i from items where len(w) > 0)
), grams as (
    select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as g
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from windows) where len(w) >= n)
), hits as (
    select doc_id, i, n, item_id from grams join windows using (n, g)
), marked as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id
), found as (
    select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join marked using (doc_id) left join found using (doc_id)
"""
