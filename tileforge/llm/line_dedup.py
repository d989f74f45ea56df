"""Operator 2: deletes later copies of repeated line runs, by a suffix array over line ids.

The corpus is one sequence of lines in the order (doc_id nulls last, text hash, line),
cut between documents; blank lines are left out of it. A run is a stretch of
consecutive lines of one document. A line is deleted if it lies in a run of
at least `min_words` words that also occurs earlier in the corpus.

How it is found:

1. Lines get ids; only lines that occur twice or more can be in a repeated
   run, so only they go on.
2. Prefix doubling gives r_k(i), the rank of the 2**k lines from i among all
   such stretches: pairs (r_k(i), r_k(i + 2**k)) are counted, those that occur
   once drop out, the rest are sorted by range partitions and numbered. Ranks
   are those of the suffix array ordered by its first 2**k lines.
3. For every line the shortest run of `min_words` words that starts there and
   the shortest that ends there have m <= min_words lines, since each line has
   a word, so doubling ends after log2(min_words) rounds at any input size.
   Suffixes that share their first m lines are one interval of the suffix
   array with a longest common prefix of m lines or more; two overlapping
   ranks, r_k(i) and r_k(i + m - 2**k), name it.
4. In each interval the first occurrence stays, the others are later copies.
   Each maximal repeated run is the union of the shortest runs in it that
   start or end at its lines, so deleting these deletes it whole.

Defined cases: null texts stay null; documents of equal doc_id and text are one
document and get the same result; of two texts with one doc_id that of the
smaller hash is earlier; documents without a doc_id come last, in the order of
their texts' hashes. Columns n_lines and n_removed of the input are
replaced, other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_WORD, materialise, table
from .sharding import number_rows

MIN_WORDS = 50
_DOC = ["__unnamed", "__doc", "__text"]


def _key(docs: DataFrame) -> list:
    """The columns _DOC, none of them null, in the order of documents."""
    return [F.col("doc_id").isNull().alias("__unnamed"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("__doc"), F.xxhash64("text").alias("__text")]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row for each line with a word: its place, its hashes, and the lengths of the shortest runs from and to it."""
    body = docs.select(*_key(docs), F.expr(f"transform(filter(split(coalesce(text, ''), '\\n', -1), l -> l rlike r'{SPACED_WORD}'), l -> struct(xxhash64(l) as h1, hash(l) as h2, regexp_count(l, r'{SPACED_WORD}') as n))").alias("__l"))
    counted = body.withColumn("__n", F.expr("transform(__l, x -> x.n)"))
    run = f"aggregate({{}}, struct(0 as s, 0 as m), (a, x) -> if(a.s >= {min_words}, a, struct(a.s + x as s, a.m + 1 as m)), a -> if(a.s >= {min_words}, a.m, 0))"
    forth = run.format(f"slice(__n, i + 1, {min_words})")
    back = run.format(f"reverse(slice(__n, greatest(i + 2 - {min_words}, 1), least(i + 1, {min_words})))")
    return counted.select(*_DOC, F.posexplode(F.expr(f"transform(__l, (x, i) -> struct(x.h1 as h1, x.h2 as h2, {forth} as forth, {back} as back))")).alias("seq", "x")).select(*_DOC, "seq", "x.*")


def _numbered(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks r of the keys that occur twice or more."""
    return number_rows(pairs.groupBy(*keys).agg(F.count("*").alias("__c")).where("__c > 1").select(*keys), keys, "r")[0]


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to delete: __unnamed, __doc, __text, start and m (in lines with a word); runs may overlap."""
    if min_words < 1:
        raise ValueError("min_words must be positive")
    lines = materialise(_lines(docs, min_words))
    ranked = lines.join(_numbered(lines, ["h1", "h2"]), ["h1", "h2"]).select(*_DOC, "seq", "forth", "back", "r")
    level = base = materialise(ranked.dropDuplicates([*_DOC, "seq"]))  # rows of one document count once
    level = level.select(*_DOC, "seq", "r")
    levels = [level]
    while 2 ** len(levels) <= min_words:
        step = 2 ** (len(levels) - 1)
        ahead = level.select(*_DOC, (F.col("seq") - step).alias("seq"), F.col("r").alias("b"))
        pairs = level.withColumnRenamed("r", "a").join(ahead, [*_DOC, "seq"])
        pairs = materialise(pairs)
        level = materialise(pairs.join(_numbered(pairs, ["a", "b"]), ["a", "b"]).select(*_DOC, "seq", "r"))
        levels.append(level)
    ranks = None
    for k, one in enumerate(levels):
        one = one.withColumn("k", F.lit(k))
        ranks = one if ranks is None else ranks.unionByName(one)
    runs = base.select(*_DOC, F.explode(F.expr("array(struct(seq as start, forth as m), struct(seq - back + 1 as start, back as m))")).alias("x")).select(*_DOC, "x.*").where("m > 0")
    runs = runs.withColumn("k", F.expr("cast(floor(log2(m)) as int)"))
    first = ranks.select(*_DOC, "k", F.col("seq").alias("start"), F.col("r").alias("a"))
    named = runs.join(first, [*_DOC, "k", "start"]).withColumn("tail", F.expr("start + m - cast(shiftleft(1, k) as int)"))
    last = ranks.select(*_DOC, "k", F.col("seq").alias("tail"), F.col("r").alias("b"))
    named = materialise(named.join(last, [*_DOC, "k", "tail"]).select(*_DOC, "start", "m", "a", "b"))
    place = F.struct(*_DOC, "start")
    intervals = materialise(named.groupBy("m", "a", "b").agg(F.min(place).alias("__first"), F.max(place).alias("__last")).where("__first < __last").drop("__last"))
    return named.join(intervals, ["m", "a", "b"]).where(place > F.col("__first")).select(*_DOC, "start", "m")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with its text cleaned, and n_lines, n_removed: lines with a word before, and those deleted."""
    gone = later_copies(docs.select("doc_id", "text"), min_words)
    gone = gone.select(*_DOC, F.explode(F.expr("sequence(start, start + m - 1)")).alias("seq")).distinct()
    gone = gone.groupBy(*_DOC).agg(F.collect_list("seq").alias("__gone")).withColumnsRenamed({c: f"{c}2" for c in _DOC})
    keyed = docs.withColumns({**dict(zip(_DOC, _key(docs), strict=True)), "__lines": F.split(F.coalesce("text", F.lit("")), "\n", -1)})
    joined = keyed.join(gone, [F.col(c) == F.col(f"{c}2") for c in _DOC], "left")
    joined = joined.withColumn("__full", F.expr(f"filter(sequence(0, size(__lines) - 1), i -> __lines[i] rlike r'{SPACED_WORD}')"))
    joined = joined.withColumns({"n_lines": F.size("__full").cast("long"), "n_removed": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")})
    kept = F.expr("array_join(transform(array_except(sequence(0, size(__lines) - 1), transform(__gone, s -> __full[s])), i -> __lines[i]), '\\n')")
    return joined.withColumn("text", F.when(F.col("n_removed") > 0, kept).otherwise(F.col("text"))).drop(*_DOC, *(f"{c}2" for c in _DOC), "__lines", "__gone", "__full")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op2_sql(min_words: int = MIN_WORDS) -> str:
    """Every run of every document, compared by its text."""
    word = "[^\\x20\\x09-\\x0D]"
    return f"""
with raw as (
    select doc_id, unnest(a) as l, unnest(range(1, len(a) + 1)) as k from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents)
), full_lines as (
    select doc_id, l, k, row_number() over (partition by doc_id order by k) as i, len(regexp_extract_all(l, '{word}+')) as n from raw where regexp_matches(l, '{word}')
), docs as (
    select doc_id, list(l order by i) as a, list(n order by i) as w from full_lines group by doc_id
), runs as (
    select doc_id, s, e, md5(array_to_string(a[s:e], chr(10))) as h
    from (select doc_id, a, w, s, unnest(range(s, len(a) + 1)) as e from (select doc_id, a, w, unnest(range(1, len(a) + 1)) as s from docs)) where list_sum(w[s:e]) >= {min_words}
), firsts as (
    select h, min(struct_pack(d := doc_id, s := s)) as f from runs group by h
), gone as (
    select distinct doc_id, unnest(range(s, e + 1)) as i from runs join firsts using (h) where struct_pack(d := doc_id, s := s) > f
), counts as (
    select doc_id, count(*) as n_removed from gone group by doc_id
), kept as (
    select doc_id, string_agg(l, chr(10) order by k) as text from raw left join full_lines using (doc_id, l, k) left join gone using (doc_id, i) where gone.i is null group by doc_id
), sizes as (
    select doc_id, count(*) as n_lines from full_lines group by doc_id
)
select documents.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, case when n_removed > 0 then coalesce(kept.text, '') else documents.text end as text
from documents left join sizes using (doc_id) left join counts using (doc_id) left join kept using (doc_id)
"""
