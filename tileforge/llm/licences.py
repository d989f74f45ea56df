"""Operator 4: licence scan by the Dice coefficient over word bigrams.

Texts are compared as lower-case words to licence templates: Dice = 2 |A and
B| / (|A| + |B|) over sets of word bigrams. A score of t or more is only
possible while |A| lies between |B| t / (2 - t) and |B| (2 - t) / t, and with
|B| t / (2 - t) bigrams in common. Compared are

1. units: every line and every paragraph of several lines, and
2. windows: every stretch of as many words as a template has, wherever it lies
   in the text, so that a notice counts within a line, over line ends and
   within a paragraph.

Each unit counts with its best template. Of the windows the best is taken
first (by Dice, length, place, id), then the best that overlaps none taken; a
window that overlaps a unit's match counts only if its licence is another and
its score higher.

One pass in the JVM, no shuffle: the templates are a literal of bounded size.
Texts that have fewer bigrams of a template than any match needs end there.

Defined cases: null and empty texts have no licences; a unit of fewer than two
words has no bigrams and matches nothing; of equally good templates the
smallest id counts; repeated rows get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licence_texts import WORDINGS

THRESHOLD = 0.75
MAX_TEMPLATES = 1000

#: Licence id, class, wording of the notice.
TEMPLATES = (
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ARR", "proprietary", "All rights reserved."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "permissive", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "permissive", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "noncommercial", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "permissive", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "permissive", "This is free and unencumbered software released into the public domain."),
)

_WORDS = r"[\p{L}\p{N}]+"


def _bigrams(words: str) -> str:
    return f"array_distinct(transform(sequence(0, size({words}) - 2), i -> concat({words}[i], ' ', {words}[i + 1])))"


def scan(docs: DataFrame, templates=TEMPLATES + WORDINGS, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with licences: array of (id, class, dice, unit), for each unit that matches and each window taken.

    unit is the text that matched; of a window, its words. Columns of docs pass through.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    none = "cast(array() as array<struct<id: string, class: string, dice: double, unit: string>>)"
    session = docs.sparkSession
    rows = session.createDataFrame([tuple(t) for t in templates], "id string, class string, wording string")
    prepared = rows.withColumn("w", F.regexp_extract_all(F.lower("wording"), F.lit(_WORDS), F.lit(0))).where("size(w) > 1").select("id", "class", F.size("w").alias("n"), F.expr(_bigrams("w")).alias("grams")).distinct().orderBy("id", "grams").collect()
    if not prepared:
        return docs.withColumn("licences", F.expr(none))
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    strings = lambda values: f"split({quoted('|'.join(values))}, '[|]')"
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    need = lambda t: max(1, math.ceil(len(t["grams"]) * low - 1e-9))
    literal = "array(" + ", ".join(f"named_struct('id', {quoted(t['id'])}, 'class', {quoted(t['class'])}, 'n', {t['n']}, 'need', {need(t)}, 'grams', {strings(t['grams'])})" for t in prepared) + ")"
    every = strings(sorted({g for t in prepared for g in t["grams"]}))
    words = lambda x: f"regexp_extract_all(lower({x}), r'{_WORDS}', 0)"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    dice = lambda a, b: f"2D * size(array_intersect({a}, {b})) / (size({a}) + size({b}))"
    overlap = "{0}.at < {1}.at + {1}.n and {1}.at < {0}.at + {0}.n"

    # Units (unit, w, at): at is the place of the first word among the text's words.
    def units_of(pattern: str) -> str:
        ends = "aggregate(__p, cast(array(0) as array<int>), (a, u) -> concat(a, array(element_at(a, -1) + size(u.w))))"
        return let("__p", f"transform(split({text}, '{pattern}', -1), u -> struct(u as unit, {words('u')} as w))", let("__e", ends, "transform(__p, (u, i) -> struct(u.unit as unit, u.w as w, __e[i] as at))"))

    units = rf"concat({units_of(r'\\n')}, filter({units_of(r'\\n\\s*\\n')}, u -> contains(trim(BOTH '\n' FROM u.unit), '\n')))"
    units = f"transform(filter({units}, u -> size(u.w) > 1), u -> struct(u.unit as unit, u.at as at, size(u.w) as n, {_bigrams('u.w')} as grams))"
    scored = f"transform(filter(__t, t -> size(u.grams) between size(t.grams) * {low}D and size(t.grams) * {high}D), t -> struct(-({dice('u.grams', 't.grams')}) as worse, t.id as id, t.class as class))"
    units = f"filter(transform({units}, u -> struct(u.unit as unit, u.at as at, u.n as n, array_min({scored}) as best)), u -> -u.best.worse >= {threshold}D)"

    # Windows (worse, shorter, at, id, class, n) that hold any `need` successive bigrams of their template, wherever those are in the text.
    first, last = "greatest(__h[i + t.need - 1] - t.n + 2, 0)", "least(__h[i], size(__w) - t.n)"
    starts = f"array_distinct(flatten(transform(filter(sequence(0, size(__h) - t.need), i -> {first} <= {last}), i -> sequence({first}, {last}))))"
    window = f"struct(-({dice('array_distinct(slice(__g, s + 1, t.n - 1))', 't.grams')}) as worse, -t.n as shorter, s as at, t.id as id, t.class as class, t.n as n)"
    row = "struct<worse: double, shorter: int, at: int, id: string, class: string, n: int>"
    windows = let("__h", "filter(__hits, p -> array_contains(t.grams, __g[p]))", f"if(size(__h) < t.need, cast(array() as array<{row}>), filter(transform({starts}, s -> {window}), x -> -x.worse >= {threshold}D))")
    windows = let("__hits", "filter(sequence(0, size(__g) - 1), p -> array_contains(__own, __g[p]))", f"flatten(transform(__t, t -> {windows}))")
    told = f"exists(__units, u -> {overlap.format('u', 'x')} and (u.best.worse <= x.worse or u.best.id = x.id))"
    windows = f"aggregate(array_sort(filter({windows}, x -> not {told})), cast(array() as array<{row}>), (a, x) -> if(exists(a, b -> {overlap.format('b', 'x')}), a, concat(a, array(x))))"

    of_units = "transform(__units, u -> struct(u.best.id as id, u.best.class as class, -u.best.worse as dice, u.unit as unit))"
    of_windows = f"transform({windows}, x -> struct(x.id as id, x.class as class, -x.worse as dice, array_join(slice(__w, x.at + 1, x.n), ' ') as unit))"
    found = let("__units", units, f"concat({of_units}, {of_windows})")

    # Only texts that share enough bigrams with a template go on to units and windows.
    found = let("__t", f"filter({literal}, t -> size(__own) >= t.need and size(array_intersect(__own, t.grams)) >= t.need)", f"if(size(__t) = 0, {none}, {found})")
    found = let("__own", f"array_intersect(__g, {every})", f"if(size(__own) = 0, {none}, {found})")
    found = let("__g", "transform(sequence(0, size(__w) - 2), i -> concat(__w[i], ' ', __w[i + 1]))", found)
    return docs.withColumn("licences", F.expr(let("__w", words(f"coalesce({text}, '')"), f"if(size(__w) < 2, {none}, {found})")))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join(F.expr("array_sort(array_distinct(transform(licences, x -> x.id)))"), ",")
    classes = F.array_join(F.expr("array_sort(array_distinct(transform(licences, x -> x.class)))"), ",")
    return found.select("doc_id", F.size("licences").cast("long").alias("n_matches"), ids.alias("licence_ids"), classes.alias("classes"), F.round(F.expr("array_max(transform(licences, x -> x.dice))"), 9).alias("best_dice"))


def op4_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    values = ", ".join(f"('{i}', '{c}', '{w}')" for i, c, w in templates)
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return f"""
with templates as (
    select id, class, {grams('w')} as b from (select id, class, regexp_extract_all(lower(wording), '{_WORDS}') as w from (values {values}) v(id, class, wording))
), units as (
    select doc_id, row_number() over () as n, u from (
        select doc_id, unnest(string_split(text, chr(10))) as u from documents
        union all
        select doc_id, p from (select doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) as p from documents) where contains(trim(p, chr(10)), chr(10)))
), cut as (
    select doc_id, n, {grams('w')} as a from (select doc_id, n, regexp_extract_all(lower(u), '{_WORDS}') as w from units) where len(w) > 1
), scored as (
    select doc_id, n, id, class, 2.0::double * len(list_intersect(a, b)) / (len(a) + len(b)) as dice from cut, templates
), best as (
    select doc_id, n, id, class, dice from scored where dice >= {threshold} qualify row_number() over (partition by n order by dice desc, id) = 1
), by_doc as (
    select doc_id, count(*) as n_matches, string_agg(distinct id, ',' order by id) as licence_ids, string_agg(distinct class, ',' order by class) as classes, max(dice) as best_dice from best group by doc_id
)
select doc_id, coalesce(n_matches, 0)::bigint as n_matches, coalesce(licence_ids, '') as licence_ids, coalesce(classes, '') as classes, round(best_dice, 9) as best_dice
from documents left join by_doc using (doc_id)
"""
