"""Operator 8: line-first quality rules.

Every line is judged on its own by rules on punctuation, navigation and
boilerplate; lines that fail are removed, and a document that loses too large
a share of its words is rejected. Document-wide counts (symbols, repeated
lines and word triples) are computed beside it. All of it is one pass over
each row in the JVM: no shuffle, no Python.

Defined cases: a null text counts as empty; an empty text has no words and
fails the base rule; blank lines are neither judged nor counted; repeated
rows are judged alike. Other columns of the input pass through `clean_lines`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_WORD, table

#: Phrases that mark a line as boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "lorem ipsum",
    "subscribe to our",
    "click here",
    "sign up for",
    "skip to content",
    "licensed under",
    "released under the",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; shares are of a line's characters or words."""

    max_symbol_share: float = 0.05
    max_upper_share: float = 0.7
    max_bangs_per_word: float = 0.3
    min_separators: int = 3
    max_words_between: float = 3.0
    unended_words: int = 30
    boilerplate_words: int = 30
    min_kept_share: float = 0.6


_SYMBOLS = "[^#*$%&|<>]+"
#: The low bits of a hash that give way to its position.
_MASK = "shiftleft(1L, cast(ceil(log2(size(__words) + 1)) as int)) - 1L"


def _count(text: str, keep_not: str) -> str:
    """Characters of text that a negated class leaves."""
    return f"char_length(regexp_replace({text}, r'{keep_not}', ''))"


def line_verdict(line: str, rules: LineRules) -> str:
    """SQL for the first rule that a line breaks, or null: punctuation, navigation or boilerplate."""
    words = f"size(regexp_extract_all({line}, r'{SPACED_WORD}', 0))"
    letters, upper = _count(line, r"[^\p{L}]+"), _count(line, r"[^\p{Lu}]+")
    phrases = "|".join(BOILERPLATE)
    return f"""case
        when {_count(line, '[^|>»·•]+')} >= greatest({rules.min_separators}, {words} / {rules.max_words_between + 1}) then 'navigation'
        when {_count(line, _SYMBOLS)} > {rules.max_symbol_share} * char_length({line}) then 'punctuation'
        when {_count(line, '[^!]+')} > {rules.max_bangs_per_word} * {words} and {words} >= 3 then 'punctuation'
        when {upper} > {rules.max_upper_share} * {letters} and {letters} >= 12 then 'punctuation'
        when {words} >= {rules.unended_words} and not {line} rlike r'[.!?:;…"”»)\\]]\\s*$' then 'punctuation'
        when {words} <= {rules.boilerplate_words} and lower({line}) rlike '{phrases}' then 'boilerplate'
        end"""


def clean_lines(df: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """df with clean_text (its good lines), n_lines, n_bad_lines and kept_share (of words, null without words)."""
    lines = df.withColumn("__lines", F.expr(f"filter(split(coalesce({text}, ''), '\\n', -1), l -> l rlike r'{SPACED_WORD}')"))
    judged = lines.withColumn("__good", F.expr(f"filter(__lines, l -> ({line_verdict('l', rules)}) is null)"))
    joined = judged.withColumn("clean_text", F.array_join("__good", "\n"))
    words = lambda x: F.size(F.regexp_extract_all(x, F.lit(SPACED_WORD), F.lit(0)))
    counted = joined.withColumns({"n_lines": F.size("__lines"), "n_bad_lines": F.size("__lines") - F.size("__good"), "__all": words(F.array_join("__lines", "\n"))})
    return counted.withColumn("kept_share", F.when(F.col("__all") > 0, words(F.col("clean_text")) / F.col("__all"))).drop("__lines", "__good", "__all")


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Word triples are told by 64-bit hashes. Where some repeat, they are found by
    sorting, within the row, the hashes with their positions in the low bits;
    equal neighbours are repeats. Where two different hashes agree in the bits
    that are left, the row's hashes are sorted whole, beside their positions.
    This takes n log n steps for n words, however often they repeat.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("__words", F.regexp_extract_all(body, F.lit(SPACED_WORD), F.lit(0)))
    out = out.withColumn("__lines", F.expr(f"filter(split(coalesce({text}, ''), '\\n', -1), l -> l rlike r'{SPACED_WORD}')"))
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace(body, _SYMBOLS, "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__triples": F.expr("if(size(__words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"),
            "__mask": F.expr(_MASK),
        }
    )
    out = out.withColumn("__distinct", F.size(F.array_distinct("__triples")))
    packed = "sort_array(transform(__triples, (h, i) -> (h & ~__mask) | i))"
    whole = "transform(sort_array(transform(__triples, (h, i) -> struct(h, cast(i as bigint) as i))), x -> x.i)"
    parted = "size(array_distinct(transform(__triples, h -> h & ~__mask))) = __distinct"
    out = out.withColumn("__sorted", F.expr(f"case when __distinct = size(__triples) then cast(array() as array<bigint>) when {parted} then {packed} else {whole} end"))
    here = "element_at(__triples, cast((x & __mask) as int) + 1)"
    other = lambda j: f"element_at(__triples, cast((__sorted[{j}] & __mask) as int) + 1)"
    repeated = f"filter(__sorted, (x, j) -> (j > 0 and {other('j - 1')} = {here}) or (j < size(__sorted) - 1 and {other('j + 1')} = {here}))"
    out = out.withColumn("__repeated", F.expr(repeated))
    covered = "size(array_distinct(flatten(transform(__repeated, x -> array(x & __mask, (x & __mask) + 1, (x & __mask) + 2)))))"
    return out.withColumn("n_repeat_words", F.expr(f"if(size(__repeated) = 0, 0, {covered})").cast("long")).drop("__words", "__lines", "__triples", "__mask", "__distinct", "__sorted", "__repeated")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(df: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """df with the base counts, the line cleaning, base_failed and kept."""
    out = clean_lines(base_counts(df), rules).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("kept_share") >= rules.min_kept_share, F.lit(False)))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_line_verdict(rules: LineRules) -> str:
    words = "len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'))"
    count = lambda keep_not: f"length(regexp_replace(l, '{keep_not}', '', 'g'))"
    phrases = "|".join(BOILERPLATE)
    return f"""not ({count('[^|>»·•]+')} >= greatest({rules.min_separators}, {words} / {rules.max_words_between + 1})
        or {count(_SYMBOLS)} > {rules.max_symbol_share} * length(l)
        or ({count('[^!]+')} > {rules.max_bangs_per_word} * {words} and {words} >= 3)
        or ({count('[^\\p{Lu}]+')} > {rules.max_upper_share} * {count('[^\\p{L}]+')} and {count('[^\\p{L}]+')} >= 12)
        or ({words} >= {rules.unended_words} and not regexp_matches(l, '[.!?:;…"”»)\\]]\\s*$'))
        or ({words} <= {rules.boilerplate_words} and regexp_matches(lower(l), '{phrases}')))"""


def op8_sql(rules: LineRules = LineRules()) -> str:
    return f"""
with docs as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), triples as (
    select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from docs)
), again as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from triples) where n > 1
), repeats as (
    select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id
), lines as (
    select doc_id, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from docs) where regexp_matches(l, '[^\\x20\\x09-\\x0D]')
), judged as (
    select doc_id, count(*) - count(distinct l) as n_dup_lines, sum(n) as n_all, sum(case when {_sql_line_verdict(rules)} then n else 0 end) as n_good from lines group by doc_id
), base as (
    select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '{_SYMBOLS}', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, n_all, n_good
    from docs left join repeats using (doc_id) left join judged using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(n_good::double / n_all >= {rules.min_kept_share}, false) as kept
from base
"""
