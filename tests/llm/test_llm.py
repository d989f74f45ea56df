"""Small fixtures for the ten operators: brute force, round trips, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tileforge.llm import bpe, decontaminate, licences, line_dedup, near_dup, quality_model, quality_rules, sharding, token_files, toxicity
from tileforge.llm.common import SPACED_WORD

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def words(n, seed=0, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two Words"), (6, words(30)), (7, words(30)), (8, words(20_000, 5)), (9, "Ünïcode ß é 日本語 x y \x1c z 😀 it's I'LL 1²½"),
    (10, "a  b\n\n\nc   d"), (11, "x" * 300), (None, "no id"), (12, "same"), (12, "same"), (12, "other"), (13, "<|endoftext|> | > # !!"), (14, "hi <|endoftext|> there"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns named like those that operators make."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("n_words", "hits", "kept", "shard", "score", "seq", "cls", "v", "ids", "w", "x", "th", "size"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    return {r.doc_id: r for r in rows}


def saved(spark, path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


# ---- 9


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(spark, n):
    image = [sharding.permute(i, n, 5) for i in range(n)]
    assert sorted(image) == list(range(n)) and [sharding.unpermute(y, n, 5) for y in image] == list(range(n))
    found = spark.range(n).select(F.col("id").alias("__row")).select(sharding.permuted(F.col("__row"), n, 5)).collect()
    assert [r[0] for r in found] == image


def test_shards_are_even_and_slots_gapless(spark, odd, empty, tmp_path):
    docs = odd.select("doc_id", "text", "shard")
    found = sharding.shard(docs, ["doc_id", "text"], 3, 7).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert len(found) == len(ODD) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(empty, ["doc_id"], 3).count() == 0
    n = len(ODD)
    assert all(sharding.row_at(*sharding.place(i, n, 3, 7), n, 3, 7) == i for i in range(n))
    rows = sharding.op9_feistel_shards(spark, saved(spark, tmp_path, documents=odd)).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ODD}


def test_shards_equal_their_sql(spark, odd, tmp_path):
    more = spark.createDataFrame([(None, "no id"), (None, None), (4, "one"), (4, "another")], SCHEMA)
    path = saved(spark, tmp_path, documents=odd.select("doc_id", "text").union(more))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    rows = sorted(map(str, duck.execute(sharding.op9_sql()).fetchall()))
    assert rows == sorted(str(tuple(r)) for r in sharding.op9_feistel_shards(spark, path).collect())


# ---- 8


def base_counts(text):
    w = re.findall(SPACED_WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(SPACED_WORD, x)]
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {p for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, odd, empty):
    texts = [t for _, t in ODD] + ["a b c a b c a", "l\nl\n\nm\nl", "a b c d\n" * 40]
    rows = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == {i: base_counts(t) for i, t in enumerate(texts)}
    assert quality_rules.judge(odd).count() == len(ODD) and quality_rules.judge(empty).count() == 0
    good = "\n".join(words(11, 700 + i, 5000).capitalize() + "." for i in range(8))
    menu = good + "\nHome | News | About | Contact | Help\nAll rights reserved."
    junk = "\n".join(words(11, 800 + i, 5000).replace(" ", "*** ") + "###" for i in range(8))
    found = by_id(quality_rules.judge(spark.createDataFrame([(1, good), (2, menu), (3, junk)], SCHEMA)).collect())
    assert found[1].kept and found[2].kept and not found[3].kept and found[2].clean_text == good and found[2].n_bad_lines == 2


def test_repeated_triples_whose_hashes_agree_in_part(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_MASK", "shiftleft(1L, 62) - 1L")  # two bits of a hash are left
    texts = [*(words(60, 40 + i, 12) for i in range(6)), words(300, 50, 5000), "a b c a b c", "a b c", ""]
    rows = quality_rules.base_counts(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {i: base_counts(t)[-1] for i, t in enumerate(texts)}
    assert any(r.n_repeat_words for r in rows[:6])


# ---- 7


def word_list(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_decontamination_matches_brute_force(spark, odd, empty):
    long = words(40, 3)
    items = [(1, words(25, 1)), (2, "Short item É"), (3, None), (4, ""), (5, long), (6, long), (None, words(12, 9))]
    docs = [*ODD, (20, "x " + words(25, 1).upper()), (21, "y, short: ITEM É! short item é"), (22, long[:60] + " cut"), (23, f"{words(12, 9)} {long}"), (24, "short item e")]
    windows = [(i, w[k : k + 10]) for i, t in items if (w := word_list(t)) for k in range(max(1, len(w) - 9))]

    def brute(text):
        w = word_list(text)
        hits, found = set(), set()
        for i, window in windows:
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hits |= set(range(k, k + len(window)))
                    found |= {i} - {None}
        return len(w), len(hits), sorted(map(str, found))

    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_hits(spark.createDataFrame(docs, SCHEMA), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found) == Counter((i, n, h, tuple(x)) for i, t in docs for n, h, x in [brute(t)])
    assert decontaminate.find_hits(empty, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).collect() == odd.collect()
    spans = by_id(decontaminate.decontaminate(spark.createDataFrame(docs, SCHEMA), bench, "spans").collect())
    assert spans[20].text == "x " and spans[24].text == "short item e" and spans[21].text == "y, ! short item é"
    kept = decontaminate.decontaminate(odd.union(spark.createDataFrame([(30, long)], SCHEMA).select("*", *[F.lit("mine") for _ in odd.columns[2:]])), bench)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in ODD} and all(r.hits == "mine" for r in kept.collect())


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    bench = spark.createDataFrame([(1, words(25, 1))], "item_id long, text string")
    docs = spark.createDataFrame([(1, words(25, 1)), (2, words(25, 2))], SCHEMA)
    assert {r.doc_id: r.n_hit for r in decontaminate.find_hits(docs, bench).collect()} == {1: 25, 2: 0}


def test_decontamination_by_items_of_few_words(spark):
    bench = spark.createDataFrame([(1, "canary"), (2, "two words"), (3, "Canary")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a CANARY, canary"), (2, "words two words"), (3, "canaries"), (4, None), (5, "canary")], SCHEMA)
    found = decontaminate.find_hits(docs, bench).collect()
    assert {r.doc_id: (r.n_hit, r.item_ids) for r in found} == {1: (2, ["1", "3"]), 2: (2, ["2"]), 3: (0, []), 4: (0, []), 5: (1, ["1", "3"])}


def test_decontamination_broadcasts_by_bytes(spark, monkeypatch):
    windows = decontaminate.windows_of(spark.createDataFrame([(i, words(11, 1)) for i in range(50)], "item_id long, text string"))
    assert decontaminate._can_broadcast(windows)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 500)
    assert not decontaminate._can_broadcast(windows)


# ---- 4


def test_licence_scan(spark, odd, empty):
    texts = ["Released under the MIT License.", "intro\nreleased UNDER the mit  license\nmore", "Released under the BSD License.", "This work is licensed under the GNU General Public License,\nversion 3.", "All rights", "All rights reserved."]
    found = licences.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    names = {r.doc_id: sorted({x.id for x in r.licences}) for r in found}
    assert [names[k] for k in (0, 1, 2, 4, 5)] == [["MIT"], ["MIT"], [], [], ["ARR"]]
    assert names[3] == ["GPL-2.0", "GPL-3.0"]  # the first line alone fits either, the paragraph fits the second
    assert licences.scan(odd).where("size(licences) > 0").count() == 0 and licences.scan(empty).count() == 0
    assert licences.scan(odd, ()).count() == len(ODD)


def test_licences_within_longer_text(spark):
    mit = next(w for i, _, w in licences.WORDINGS if i == "MIT" and w.startswith("Permission"))
    texts = {
        "This article may be shared freely by anyone. Released under the MIT License.": ["MIT"],
        "Copyright (c) 2020 Example Ltd. All rights reserved.": ["ARR"],
        "MIT License": ["MIT"],
        f"{words(40)}\n{words(9, 1)} This work is licensed under the GNU General\nPublic License, version 3. {words(60, 2)}\n{words(30, 3)}": ["GPL-3.0"],
        "# SPDX-License-Identifier: MIT": ["MIT"],
        "SPDX-License-Identifier: GPL-2.0-only": ["GPL-2.0"],
        f"Copyright 2020 X\n\n{mit[:200]}\n{mit[200:]}\n{words(500, 4)}": ["MIT"],
        "Licensed under CC BY-NC-SA 4.0 and nothing else than this, as was said before": ["CC-BY-NC-SA-4.0"],
        f"{words(300, 5)} released under the licence of the BSD kind {words(20, 6)}": [],
    }
    found = by_id(licences.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    assert {t: sorted({x.id for x in found[i].licences}) for i, t in enumerate(texts)} == texts


def test_licence_windows_match_brute_force(spark):
    draw = random.Random(3)
    templates = [("A", "x", "a b c d e"), ("B", "y", "c d e f a b"), ("C", "z", "b a")]
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 30))) for _ in range(60)]
    grams = lambda w: {" ".join(x) for x in zip(w, w[1:])}  # noqa: E731, B905
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    found = by_id(licences.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), templates).collect())
    for i, t in enumerate(texts):
        w = t.split()
        unit = min((-dice(grams(w), grams(x.split())), k) for k, _, x in templates)
        unit = unit if -unit[0] >= 0.75 else None
        windows = []
        for k, _, x in templates:
            n = len(x.split())
            windows += [(-d, -n, s, k) for s in range(len(w) - n + 1) if (d := dice(grams(w[s : s + n]), grams(x.split()))) >= 0.75]
        taken = []
        for v in sorted(windows):
            if unit and (unit[0] <= v[0] or unit[1] == v[3]):
                continue
            if all(v[2] >= o[2] - o[1] or o[2] >= v[2] - v[1] for o in taken):
                taken.append(v)
        expected = ([(unit[1], -unit[0])] if unit else []) + [(v[3], -v[0]) for v in taken]
        assert [(x.id, round(x.dice, 9)) for x in found[i].licences] == [(k, round(d, 9)) for k, d in expected], t


# ---- 2


def brute_lines(rows, least):
    docs = []
    for i, t in rows:
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if re.search(SPACED_WORD, x)]
        docs.append((i, lines, full, [len(re.findall(SPACED_WORD, lines[k])) for k in full]))
    places = defaultdict(list)
    for d, (_, lines, full, n) in enumerate(docs):
        for s in range(len(full)):
            for e in range(s, len(full)):
                if sum(n[s : e + 1]) >= least:
                    places[tuple(lines[k] for k in full[s : e + 1])].append((d, s))
    gone = defaultdict(set)
    for run, at in places.items():
        for d, s in at:
            if (d, s) > min(at):
                gone[d] |= set(range(s, s + len(run)))
    return {i: (len(full), len(gone[d]), "\n".join(x for k, x in enumerate(lines) if k not in {full[g] for g in gone[d]})) for d, (i, lines, full, _) in enumerate(docs)}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_matches_brute_force(spark, seed):
    draw = random.Random(seed)
    pool = [words(draw.choice([1, 2, 5, 9]), k, 9) for k in range(7)] + ["", " "]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(14)))) for i in range(14)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), 12).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in found} == brute_lines(rows, 12)


def test_line_dedup_odd_inputs(spark, odd, empty):
    passage = words(60, 77)
    more = spark.createDataFrame([(40, f"a\n{passage}\nb"), (41, f"c\n{passage}\nd"), (42, passage)], SCHEMA)
    found = line_dedup.dedup_lines(odd.select("doc_id", "text").union(more)).collect()
    texts = defaultdict(set)
    for r in found:
        texts[r.doc_id].add(r.text)
    assert texts[40] == {f"a\n{passage}\nb"} and texts[41] == {"c\nd"} and texts[42] == {""}
    assert all(t in texts[i] for i, t in ODD)
    assert line_dedup.dedup_lines(odd).columns[: len(odd.columns)] == odd.columns and line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_without_ids(spark):
    """Rows without an id lose what others have; repeated rows count once."""
    passage = f"{words(30, 78)}\n{words(30, 79)}\n{words(30, 80)}"
    rows = [(None, f"a\n{passage}"), (None, f"b\n{passage}"), (None, f"b\n{passage}"), (9, f"c\n{passage}"), (9, f"c\n{passage}")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in found), key=str) == sorted([(9, rows[3][1], 0)] * 2 + [(None, "a", 3)] + [(None, "b", 3)] * 2, key=str)
    found = line_dedup.dedup_lines(spark.createDataFrame(rows[:2], SCHEMA)).collect()
    assert sorted(r.n_removed for r in found) == [0, 3]


# ---- 10 and 5


def test_byte_bpe_matches_the_library(spark, odd, empty):
    import tiktoken

    pieces = bpe.load_ranks(BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    rows = bpe.decode(bpe.encode(odd, pieces, public_tokenizers.PATTERN), pieces).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in ODD)
    assert bpe.encode(empty, pieces, public_tokenizers.PATTERN).count() == 0
    long = dict(enumerate(["".join(random.Random(1).choice("abcdefXYZ0189+/") for _ in range(4000)), "日本語の文章" * 200, "=" * 700, f"{'Ünï' * 300} it's {'ab' * 200}"]))
    rows = bpe.encode(spark.createDataFrame(list(long.items()), SCHEMA), pieces, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: library.encode_ordinary(t) for i, t in long.items()}


def test_byte_bpe_in_small_chunks(spark, monkeypatch, tmp_path):
    """Chunks of a few texts, with and without common words."""
    import tiktoken

    pieces = bpe.load_ranks(BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    texts = {i: words(50, i, 300) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA).coalesce(2)
    common = bpe._common(docs.select(F.col("doc_id").alias("key"), "text"), bpe.Vocabulary(public_tokenizers.PATTERN, pieces), bpe.rank_map(pieces))
    assert len(common[0]) > 20 and all(library.encode_ordinary(w) == ids for w, ids in zip(common[0].to_pylist(), common[1].to_pylist(), strict=True))
    rows = bpe.digests(docs, pieces, public_tokenizers.PATTERN).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items() for x in [library.encode_ordinary(t)]}


@pytest.mark.parametrize("values", [[0], [5], [1, 1, 1], list(range(300)), sorted(np.random.default_rng(1).integers(0, 10**9, 1000).tolist())])
def test_elias_fano(values):
    coded = token_files.EliasFano.of(np.array(values))
    assert [coded.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_tokenizers_of_other_kinds_go_to_the_library(tmp_path):
    """Neither a prefix space nor a normaliser is known here."""
    import json

    from tokenizers import Tokenizer

    text = "Hello  World, it's <|endoftext|> x"
    assert token_files._Encoder(TOKENIZER).plain
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        with open(TOKENIZER) as f:
            file = json.load(f) | change
        (tmp_path / "own.json").write_text(json.dumps(file))
        encode = token_files._Encoder(str(tmp_path / "own.json"))
        ids = Tokenizer.from_file(str(tmp_path / "own.json")).encode(text, add_special_tokens=False).ids
        assert not encode.plain and np.frombuffer(encode([text])[0], encode.type).tolist() == ids


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_token_file_round_trip(spark, odd, empty, tmp_path, block):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    token_files.write_token_file(odd, TOKENIZER, str(tmp_path / "ids"), block_ids=block)
    found = sorted((r.start, r.key, r.n_tokens, r.ids_crc32) for r in token_files.read_token_file(spark, str(tmp_path / "ids")).collect())
    sums = defaultdict(list)
    for i, t in ODD:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        sums[i].append((len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
    assert [k for _, k, _, _ in found] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    at = 0
    for start, key, n, crc in found:
        assert start == at
        sums[key].remove((n, crc))
        at += n
    one = token_files.read_documents(spark, str(tmp_path / "ids"), [13, 8, 99]).collect()
    assert {r.key: list(r.ids) for r in one} == {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in ODD if i in (8, 13)}
    token_files.write_token_file(empty, TOKENIZER, str(tmp_path / "none"))
    assert token_files.read_token_file(spark, str(tmp_path / "none")).count() == 0


# ---- 6


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("long_list, block", [(64, 1024), (3, 8)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, long_list, block):
    """Groups of copies, chains of edits, a passage in many texts; also with nearly all lists searched in blocks."""
    monkeypatch.setattr(near_dup, "LONG_LIST", long_list)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "COLUMNS", 7 * block)
    draw = random.Random(3)
    rows, passage = [], words(40, 99)
    for g in range(12):
        text = words(draw.choice([3, 6, 30, 90, 200]), g, 5000).split()
        for _ in range(draw.choice([1, 2, 9])):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(max(1, len(text) // 60)):
                text[draw.randrange(len(text))] = f"n{draw.randrange(10**6)}"
    rows += [(len(rows) + k, f"{words(12, 500 + k)} {passage}".upper() if k % 2 else f"{words(12, 500 + k)}  {passage}") for k in range(20)]
    template = words(60, 98)  # with 9 words of its own a page is just linked to others, with 12 it isn't
    rows += [(len(rows) + k, f"{template} {words(9 if k % 3 else 12, 700 + k)}") for k in range(18)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_union_sketch_keeps_what_the_lists_keep(spark):
    """Of 64 values of the union as many are shared as a list needs, or a few more."""
    rows = []
    for shared in range(near_dup.LEAST_SHARED, 34):
        rows += [(f"{shared}a".encode(), 900, list(range(64))), (f"{shared}b".encode(), 700, list(range(shared)) + list(range(100, 164 - shared)))]
    classes = spark.createDataFrame(rows, "cls binary, n long, sketch array<bigint>")
    pairs = spark.createDataFrame([(rows[i][0], rows[i + 1][0]) for i in range(0, len(rows), 2)], "a binary, b binary")
    assert near_dup._plausible(pairs, classes).count() == pairs.count()


def test_near_duplicates_odd_inputs(spark, odd, empty):
    found = near_dup.near_duplicates(odd).collect()
    assert len(found) == len(ODD) and near_dup.near_duplicates(empty).count() == 0
    names = {r.doc_id: r.component_id for r in found}
    assert names[6] == names[7] == 6 and names[1] == 1 and names[2] == 2 and names[None] is None


def test_near_duplicates_go_by_row(spark):
    """A doc_id with two texts, repeated rows, and copies without an id."""
    a, b, c, d = (words(80, s, 5000) for s in (60, 61, 62, 63))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c + " x"), (None, d), (None, d), (None, d + " y"), (None, None), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = near_dup.near_duplicates(docs).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == 7
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    last = [t for i, t in left if i is None and t is not None]
    assert len(last) == 1 and last[0] in (d, d + " y")
    assert sorted(left, key=str) == sorted([(1, a), (2, b), (3, c), (None, last[0]), (None, None), (None, None), (4, "")], key=str)


@pytest.mark.parametrize("bits", [near_dup.MAX_BITS, 64])
def test_near_duplicates_broadcast_one_row(spark, monkeypatch, bits):
    """What goes to all executors by way of the driver is one row of bits, however many texts are fetched; or nothing, with more keys than the bits tell apart."""
    sent = []
    broadcast = F.broadcast
    monkeypatch.setattr(near_dup.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    monkeypatch.setattr(near_dup, "MAX_BITS", bits)
    rows = [(3 * k + j if k else None, f"{words(40, k, 5000)} end{j}") for k in range(40) for j in range(2)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i and i - i % 3 for i, _ in rows}
    assert sum(r.kept for r in found) == 40 and all(n == 1 for n in sent)


def test_pivots_pair_where_sizes_allow(spark):
    """A list's members whose sizes rule a link out are dropped before their sketches are fetched, and lists name classes by numbers."""
    classes = spark.createDataFrame([(1, 60, [5, 6]), (2, 61, [5, 6]), (3, 900, [5, 6])], "cls long, n long, sketch array<bigint>")
    lists = spark.createDataFrame([(v, c, n) for v in (5, 6) for c, n in ((1, 60), (2, 61), (3, 900))], "v long, cls long, n long")
    assert {(r.a, r.b) for r in near_dup._pivoted(lists).collect()} <= {(1, 2)}
    assert {r.cls for r in near_dup._likely(classes, ["cls"], classes.where("cls < 3")).collect()} >= {1, 2}


def test_a_group_verifies_about_one_pair_for_each_member(spark, monkeypatch):
    """Full sets are sent for pairs that join something, not for all pairs of members with pivots."""
    sent = []
    links = near_dup._links
    monkeypatch.setattr(near_dup, "_links", lambda pairs, *others: sent.append(pairs.count()) or links(pairs, *others))
    base = words(200, 5, 5000)
    rows = [(k, f"{base} own{k} other{k}") for k in range(40)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in found} == {0} and sum(sent) <= 2 * len(rows)


def test_short_hashes_drop_no_link(spark):
    """Pairs that 16 bits of each shingle rule out aren't linked; sets with equal bits stay to be verified."""
    sets = {1: [k << 16 for k in range(100)], 2: [k << 16 for k in range(10, 110)], 3: list(range(-400, 0)), 4: list(range(-440, -40)), 5: list(range(-700, -300))}
    given = spark.createDataFrame([(k, s) for k, s in sets.items()], "key long, s array<bigint>")
    members = spark.createDataFrame([(k, k) for k in sets], "cls long, key long")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    linked = {(a, b) for a in sets for b in sets if a < b and 4 * len({*sets[a]} & {*sets[b]}) >= 3 * len({*sets[a]} | {*sets[b]})}
    left = {(r.a, r.b) for r in near_dup._possible(pairs, given, members).collect()}
    assert {(1, 2)} <= linked <= left and (3, 5) not in left and (4, 5) not in left


# ---- 1 and 3


def labelled(spark, n=600):
    """Texts that are clean, full of symbols (quality 0), or hold a slur (toxic)."""
    draw, docs, labels = random.Random(1), [], []
    for i in range(n):
        kind = i % 5
        text = words(draw.randrange(20, 80), i).replace("w1", "the").capitalize() + "."
        if kind == 0:
            text = " ".join(w + "***" for w in text.split())
        if kind == 1:
            text = text.replace(" ", f" {draw.choice(['zork', 'blarg'])} ", 1)
        docs.append((i, text))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_model_on_held_out_rows(spark, odd, empty):
    docs, labels = labelled(spark)
    found = quality_model.score(docs, labels).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 != 0) for r in held]) > 0.95
    again = quality_model.score(odd, labels.limit(0)).collect()
    assert len(again) == len(ODD) and {r.score for r in again} == {0.5}
    assert quality_model.score(empty, labels).count() == 0
    assert quality_model.keep_good(odd, labels.limit(0)).collect() == odd.collect()


def test_quality_matches_brute_force(spark):
    """Features, ridge weights, out-of-fold scores and calibration, computed anew from whole arrays."""
    docs, labels = labelled(spark, 300)
    x = {r.doc_id: np.array(quality_model.statistics(r.text)) for r in docs.collect()}
    y = {r.doc_id: float(r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.quality in (0, 1)}
    fold = {r.id: r.f for r in spark.range(300).select("id", F.expr(f"cast(pmod(xxhash64(id), {quality_model.FOLDS}L) as int)").alias("f")).collect()}
    ids = sorted(y)
    raw = np.array([x[i] for i in ids])
    mean, spread = raw.mean(axis=0), raw.std(axis=0)
    spread[spread <= 1e-9] = 1.0
    d, draw = quality_model.DIMENSIONS, np.random.default_rng(quality_model.SEED)
    w = draw.normal(size=(raw.shape[1], d)) * np.sqrt(2.0 / raw.shape[1])
    b = draw.uniform(0, 2 * np.pi, d)
    lift = lambda v: np.append(np.sqrt(2 / d) * np.cos(np.clip((v - mean) / spread, -6, 6) @ w + b), 1.0)

    def ridge(own):
        z, t = np.array([lift(x[i]) for i in own]), np.array([y[i] for i in own])
        a = z.T @ z
        return np.linalg.solve(a + quality_model.RIDGE * len(own) * np.diag([1.0] * d + [0.0]) + 1e-9 * np.eye(d + 1), z.T @ t)

    whole = ridge(ids)
    parts = [ridge([i for i in ids if fold[i] != k]) for k in range(quality_model.FOLDS)]
    outside = {i: lift(x[i]) @ parts[fold[i]] for i in ids}
    bins = defaultdict(list)
    for i in ids:
        bins[int(np.clip((outside[i] + 0.5) / 2 * quality_model.BINS, 0, quality_model.BINS - 1))].append(i)
    at = [(np.mean([outside[i] for i in own]), np.mean([y[i] for i in own]), len(own)) for _, own in sorted(bins.items())]
    xs, levels = [p[0] for p in at], []
    for k in range(len(at)):  # the largest of the least means: isotonic regression by its formula
        levels.append(max(min(np.average([p[1] for p in at[i : j + 1]], weights=[p[2] for p in at[i : j + 1]]) for j in range(k, len(at))) for i in range(k + 1)))
    centres = {level: np.average([v for v, m in zip(xs, levels, strict=True) if m == level], weights=[p[2] for p, m in zip(at, levels, strict=True) if m == level]) for level in sorted(set(levels))}
    for r in quality_model.score(docs, labels).collect():
        expected = np.interp(lift(x[r.doc_id]) @ whole, list(centres.values()), list(centres))
        assert abs(r.score - expected) < 1e-4


def test_isotonic_pools_violators():
    x, y = quality_model.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert x.tolist() == [0, 1.5, 3] and y.tolist() == [0, 0.5, 1]


def test_toxicity_chain_on_held_out_rows(spark, odd, empty):
    docs, labels = labelled(spark)
    chain = toxicity.fit_chain(docs, labels.withColumn("low", 1 - F.col("quality")), ["low", "toxic"])
    found = toxicity.score(docs, chain).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.p_toxic >= 0.5) == (r.doc_id % 5 == 1) for r in held]) > 0.95
    assert toxicity.score(odd, chain).count() == len(ODD) and toxicity.score(empty, chain).count() == 0
    none = toxicity.fit_chain(empty, labels, ["toxic"])
    assert {r.p_toxic for r in toxicity.score(odd, none).collect()} == {0.5}


def test_toxicity_matches_brute_force(spark):
    """The chain, computed anew with lists and plain gradient steps."""
    docs, labels = labelled(spark, 200)
    names = ["quality", "toxic"]
    chain = toxicity.fit_chain(docs, labels, names)
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: [float(r.quality), float(r.toxic)] for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    present = {i: toxicity.features(t) for i, t in texts.items()}
    counts = Counter(f for i in known for f in present[i])
    share = np.mean(list(known.values()), axis=0)

    def distance(f):
        hit = np.sum([known[i] for i in known if f in present[i]], axis=0)
        return max(abs(h - counts[f] * p) / np.sqrt(counts[f] * p * (1 - p) + 1) for h, p in zip(hit, share, strict=True))

    best = sorted((f for f in counts if counts[f] > 1), key=lambda f: (-round(distance(f), 9), f))[: toxicity.MAX_FEATURES]
    assert set(chain.vocabulary) == set(best)
    order = sorted(chain.vocabulary, key=chain.vocabulary.get)
    row = lambda i: [float(f in present[i]) for f in order]

    def fitted(x, y):
        """Newton's method to the end, on the penalised likelihood."""
        x, y, w = np.array(x), np.array(y), np.zeros(len(x[0]))
        penalty = np.array([toxicity.RIDGE] * (len(w) - 1) + [1e-6])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve(x.T @ np.diag(p * (1 - p)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        return w

    sure = lambda z: 1 / (1 + np.exp(-np.clip(z, -12, 12)))
    ids = sorted(known)
    fold = {i: (i * 2654435761 >> 7) % toxicity.FOLDS for i in ids}
    first = [row(i) + [1.0] for i in ids]
    models, outside = [fitted(first, [known[i][0] for i in ids])], {}
    for part in range(toxicity.FOLDS):
        w = fitted([x for x, i in zip(first, ids, strict=True) if fold[i] != part], [known[i][0] for i in ids if fold[i] != part])
        outside |= {i: sure(np.dot(x, w)) for x, i in zip(first, ids, strict=True) if fold[i] == part}
    models.append(fitted([row(i) + [outside[i], 1.0] for i in ids], [known[i][1] for i in ids]))
    for r in toxicity.score(docs, chain).collect():
        p = sure(np.dot(row(r.doc_id) + [1.0], models[0]))
        q = sure(np.dot(row(r.doc_id) + [p, 1.0], models[1]))
        assert abs(p - r.p_quality) < 2e-3 and abs(q - r.p_toxic) < 2e-3


def test_toxicity_labels_of_one_category(spark):
    """Labels without a document use up no training rows, and each category takes the rows that have its label."""
    docs, labels = labelled(spark, 600)
    idle = spark.range(10**6, 10**6 + 5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    chain = toxicity.fit_chain(docs, labels.select("doc_id", "quality", "toxic").union(idle), ["quality", "toxic"], 500)
    full = toxicity.fit_chain(docs, labels, ["quality", "toxic"], 500)
    assert chain.vocabulary == full.vocabulary and all(np.allclose(a, b) for a, b in zip(chain.weights, full.weights, strict=True))
    bare = toxicity.fit_chain(docs, labels.withColumn("quality", F.lit(None).cast("int")), ["quality", "toxic"])
    held = [r for r in toxicity.score(docs, bare).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.p_toxic >= 0.5) == (r.doc_id % 5 == 1) for r in held]) > 0.9


# ---- the pipeline


def test_pipeline_takes_out_what_it_should(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    passage, item = words(70, 800), words(30, 801)
    clean = [(1000 + k, words(90, 900 + k, 5000).capitalize() + ".") for k in range(6)]
    copy = clean[0][1]
    near = " ".join(["changed", *copy.split()[1:]])
    planted = [(2000, copy), (2001, near), (2002, f"{words(60, 910, 5000)} {item}"), (2003, f"{words(50, 911, 5000)}.\n{passage}"), (2004, f"{words(50, 912, 5000)}.\n{passage}"), (2005, None), (2006, "")]
    rows = docs.union(spark.createDataFrame(clean + planted, SCHEMA)).select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    path = saved(spark, tmp_path, documents=rows, labels=labels, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    stage, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, path)
        assert stage.columns == rows.columns
        kept.append(by_id(stage.collect()))
    assert all(i in kept[-1] for i, _ in clean)
    assert not any(i % 5 == 0 for i in kept[0] if i < 300)
    assert 2000 not in kept[1] and passage in kept[1][2003].text and passage not in kept[1][2004].text and kept[1][2004].n_chars == len(kept[1][2004].text)
    assert 2001 not in kept[2] and 2002 in kept[2] and 2002 not in kept[3]
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} == set(kept[3])
    assert all(r.decoded_sha256 == hashlib.sha256((kept[3][r.doc_id].text or "").encode()).hexdigest() for r in out)
