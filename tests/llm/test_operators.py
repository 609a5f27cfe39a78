"""The operators for training data against brute force, their SQL, held-out labels, and awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronotag.llm import ORACLES, QUERIES, decontam, jaccard, langid, licenses, mixing, quality, rules, shards, stats, suffixes, urls
from chronotag.llm.common import table
from tests.compare import differences

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, key string, score string, shard string, size string, spans string"
AWKWARD = [
    (1, "", "en", "a", 0), (2, None, "en", None, None), (None, "the of and to in is it on for", None, "a", 1), (4, "   \n\t ", None, "b", 2),
    (5, "Ünïcode wörds, 日本語 \U0001f600 text", "de", "b", 3), (6, "x" * 300_000, "en", "a", 4), (7, "same line here\n" * 40, "en", "a", 5),
    (7, "same line here\n" * 40, "en", "a", 5), (8, "one two three four five six seven eight nine ten eleven", "fr", "b", 6),
    (8, "another text under the same id, which is long enough to be of use here", "fr", "b", 6), (9, "...!!! 123", None, "c", 7),
    (None, None, None, None, None), (10, "Released under the MIT License.", "en", "c", 8)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 1, "k", "s", "h", "z", "p") for r in AWKWARD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 4, 5, 6, 7, 8, 8)] + [(None, 1, 0), (9, None, 0)], "doc_id bigint, quality int, toxic int")


def words(text, low=False):
    data = (text or "").encode()
    return WORD.findall(data.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) if low else data)


def counts(text):
    w, text = words(text), text or ""
    lines, seen, dups = [x for x in text.split("\n") if words(x)], set(), 0
    for x in lines:
        dups += x in seen
        seen.add(x)
    runs = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for j in range(8)}
    return [len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered)]


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]


def test_counts_equal_brute_force(spark, sf_dir):
    import pyarrow as pa
    texts = [t for _, t in documents(spark, sf_dir)] + [r[1] for r in AWKWARD if r[1] is None or len(r[1]) < 10_000] + ["a b c d e f g h " * 3 + "\n\n x\n x\n", "|||"]
    got, _ = stats.batches(pa.array(texts, pa.string()))
    assert got.tolist() == [counts(t) for t in texts]


def similar(docs, k, percent):
    """component of each row by comparing all pairs of distinct sets."""
    sets = []
    for _, t in docs:
        w = words(t, low=True)
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    each, up = [s for s in set(sets) if s], {}
    where = collections.defaultdict(set)
    for i, s in enumerate(each):
        up[i] = i
        for g in s:
            where[g].add(i)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, s in enumerate(each):
        shared = collections.Counter(j for g in s for j in where[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(each[j]) - n):
                up[root(i)] = root(j)
    number = {s: root(i) for i, s in enumerate(each)}
    least = {}
    for (d, _), s in zip(docs, sets):
        if s and d is not None:
            least[number[s]] = min(d, least.get(number[s], d))
    return sorted(((d, len(s), least.get(number[s]) if s else d) for (d, _), s in zip(docs, sets)), key=repr)


def near_copies(seed=3):
    rng, made = random.Random(seed), [(100, "rare words " * 3)]
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    for i in range(160):  # one large group: copies of one text with few or many changed words
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10 ** 6)}"
        made.append((200 + i, " ".join(w)))
    return [*made, *[(400 + i, " ".join(base[:30 + i])) for i in range(40)]]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, sf_dir, k, percent):
    docs = [*documents(spark, sf_dir), *[(None if d is None else 10_000 + d, t) for d, t in near_copies()], *[(None if r[0] is None else 20_000 + r[0], r[1]) for r in AWKWARD]]
    got = jaccard.groups(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), k, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == similar(docs, k, percent)


@pytest.mark.parametrize("k,percent,tile", [(4, 85, 7), (2, 40, 256)])
def test_jaccard_links_equal_brute_force(spark, monkeypatch, k, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    docs = [(i, t) for i, (_, t) in enumerate([*near_copies(), *near_copies()[:20], *[r[:2] for r in AWKWARD]])] + [(3, near_copies()[3][1]), (3, "a row of its own")]
    sets = []
    for _, t in docs:
        w = words(t, low=True)
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    each = sorted({s for s in sets if s}, key=repr)
    pairs = {(i, j) for i, x in enumerate(each) for j, y in enumerate(each) if i != j and 100 * len(x & y) >= percent * len(x | y)}
    size, number = collections.Counter(sets), {s: i for i, s in enumerate(each)}
    want = collections.Counter()
    for i, j in pairs:
        want[i] += size[each[j]]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.n_links) for r in jaccard.groups(table, k, percent).collect())
    assert got == sorted((d, len(s), want[number[s]] + size[s] - 1 if s else 0) for (d, _), s in zip(docs, sets))
    links = [(r.a, r.b) for r in jaccard.join(table, k, percent)[1].collect()]
    assert 2 * len(links) == len(pairs) and len(set(links)) == len(links) and all(a < b for a, b in links)


def cut(docs):
    """n_bytes, n_removed, n_spans and digest of each row, by looking at every window."""
    first, out = {}, []
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        t = (t or "").encode()
        gone = np.zeros(len(t) + 2, bool)
        for s in range(len(t) - 49):
            owner = first.setdefault(t[s:s + 50], d)
            if owner != d:
                gone[s + 1:s + 51] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup_equals_brute_force(spark, sf_dir):
    rng = random.Random(5)
    common, made = "".join(rng.choice("abcdé ") for _ in range(130)), []
    for i in range(60):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(200)))
        a = rng.randrange(60)
        made.append((5000 + i, own + common[a:a + rng.choice([30, 48, 49, 50, 51, 60, 70, 130])] + own[::-1]))
    docs = [*documents(spark, sf_dir)[:120], *made, *[r[:2] for r in AWKWARD if r[1] is None or len(r[1]) < 10_000], (3, "ab" * 90), (2000, "ab" * 60)]
    got = suffixes.digests(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got), key=repr) == cut(docs)


def five(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_decontamination_equals_brute_force(spark, sf_dir):
    items = [(r.item_id, five(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    want = set()
    for d, t in documents(spark, sf_dir):
        have = five(t)
        want |= {(d, i) for i, g in items if g and len(g & have) >= 0.8 * len(g)}
    got = QUERIES["op4_decontamination"](spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    blocks = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), block_items=15).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == want


def test_copied_questions_count_without_their_answers(spark):
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    asked = {1: prose(13), 2: prose(8), 3: prose(7), 4: prose(90), 5: prose(30), 6: prose(12)}
    answers = {1: prose(3), 2: prose(30), 3: prose(25), 4: prose(60), 5: prose(10), 6: prose(9)}
    bench = spark.createDataFrame([(i, asked[i], answers[i]) for i in asked] + [(7, "two words", None), (1, prose(20), prose(5))], "item_id long, question string, answer string")
    texts = {10 * i: f"{prose(40)} {asked[i]} {prose(40)}" for i in asked} | {10 * i + 1: f"{prose(20)} {answers[i]} {prose(9)}" for i in asked}
    texts |= {10 * i + 2: f"{asked[i]} {answers[i]}" for i in asked} | {100: "these two words are prose " + prose(50), 101: " ".join(asked[5].split()[:15]) + " " + prose(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def grams(text):
        w = text.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    want = set()
    for d, text in texts.items():
        for i, q in asked.items():
            whole = grams(f"{q} {answers[i]}")
            alone = len(q.split()) >= 8 and len(grams(q) & grams(text)) >= 0.8 * len(grams(q))
            if alone or len(whole & grams(text)) >= 0.8 * len(whole):
                want.add((d, i))
    assert want == {(10 * i, i) for i in asked if i != 3} | {(10 * i + 2, i) for i in asked}
    for size in ({}, {"block_terms": 100}, {"block_items": 1}):
        got = decontam.matches(docs, bench, question="question", answer="answer", **size).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    assert all((r.question_overlap == 1) and (r.answer_overlap < 0.6 or r.doc_id % 10 == 2) for r in got)
    assert decontam.clean(docs, bench, question="question", answer="answer").count() == len(texts) - len({d for d, _ in want})


def test_wand_finds_all_above_the_threshold(spark, sf_dir):
    index = next(decontam.indexes(table(spark, sf_dir, "benchmark")))
    rng = np.random.default_rng(1)
    for _ in range(60):
        terms = np.unique(rng.integers(0, len(index.terms), 80))
        score = np.zeros(len(index.owner))
        for t in terms:
            at = slice(index.begin[t], index.begin[t + 1])
            score[index.segment[at]] += index.weight[at]
        for threshold in (0.02, 0.08, 0.2):
            assert sorted(s for s, _ in decontam.block_max_wand(index, terms, threshold)) == np.flatnonzero(score >= threshold - 1e-9).tolist()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) is None


def test_mix_reaches_targets_with_a_hot_source_and_full_sources(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(600)] + [(1000, "one two", "small"), (1001, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    assert abs(sum(x[0].target for x in by.values()) - sum(r.size for r in got)) < 1e-6
    for source, own in by.items():
        assert sum(r.taken for r in own) == int(own[0].target) and own[0].target <= 3 * own[0].source_size
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        assert all(r.position is None or 0 <= r.position <= 1 for r in own)
    assert by["small"][0].target == 6


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F
    shares = [i / 50 for i in range(51)]
    for w, knots in mixing.SCHEDULE.items():
        times = [r[0] for r in spark.createDataFrame([(x,) for x in shares], "x double").select(mixing.time_of(F.col("x"), F.lit(w))).collect()]
        t, h = zip(*knots)
        grid = np.linspace(0, 1, 20001)
        demand = np.cumsum(np.interp(grid, t, h))
        assert np.abs(np.interp(times, grid, demand / demand[-1]) - shares).max() < 1e-3


def test_shards(spark, sf_dir):
    rows = QUERIES["op7_sharding"](spark, sf_dir).collect()
    text = dict(documents(spark, sf_dir))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(rows) == len(text)


def test_shards_follow_weights(spark, tmp_path):
    docs = spark.range(6000).withColumnRenamed("id", "doc_id")
    n = collections.Counter(r.shard for r in shards.place(docs, weights=[1, 2, 0, 3]).collect())
    assert n[2] == 0 and abs(n[0] - 1000) < 150 and abs(n[1] - 2000) < 200 and abs(n[3] - 3000) < 250
    shards.write(docs, f"{tmp_path}/out", weights=[1, 1])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6000


def test_url_rules(spark):
    cases = [("http://net/x", "net", "/x", "net/", "block"), ("https://A.Example.NET/en/1?q=/de/", "a.example.net", "/en/1", "example.net/en/", "allow"),
             ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("http://badnet/x", "badnet", "/x", None, None),
             ("http://x.org/fr/#a", "x.org", "/fr/", "org/fr/", "allow"), ("http://x.org/FR/", "x.org", "/FR/", None, None), ("http://a.net", "a.net", "", None, None),
             ("http://a.net?x=/", "a.net", "", None, None), ("no scheme net/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("x://y://z", "y:", "//z", None, None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_url_rates_leave_out_the_own_fold(spark):
    rng = random.Random(4)
    rows = [(i, f"h{rng.randrange(12)}", rng.choice("st"), rng.choice("xyz"), rng.choice(["block", "allow", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, host string, suffix string, domain string, known string")
    fold = {r.host: r.f for r in df.select("host", F.expr("pmod(xxhash64(host), 4)").alias("f")).distinct().collect()}
    for r in urls.with_rates(df, 0.4).collect():
        for name, rate in (("suffix", r.suffix_rate), ("domain", r.domain_rate)):
            others = [k for _, h, s, d, k in rows if k and (s if name == "suffix" else d) == r[name] and (r.known is None or fold[h] != fold[r.host])]
            assert rate == pytest.approx((others.count("block") + 5 * 0.4) / (len(others) + 5))


def test_repeated_urls_are_judged_alike(spark):
    rows = [(i % 40, f"https://{'ab'[i % 2]}.example.{('com', 'net', 'io')[i % 3]}/{('de', 'en')[i % 4 > 1]}/{i % 40}") for i in range(120)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 120
    verdicts = collections.defaultdict(set)
    for r in got:
        verdicts[r.host, r.path].add((r.verdict, r.score))
    assert all(len(v) == 1 for v in verdicts.values()) and any(r.score is not None for r in got)


def test_learned_verdicts_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    held = {d: y for d, y in label.items() if zlib.crc32(str(d).encode()) % 4 == 2}
    got = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, folder).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert np.mean([got[d].predicted == y for d, y in held.items()]) > 0.9
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, folder).collect()}
    judged = [(got[d].kept, y) for d, y in held.items() if not got[d].base_failed]
    assert np.mean([kept == bool(y) for kept, y in judged]) > 0.9 and not any(r.kept for r in got.values() if r.base_failed)
    lang = {r.doc_id: r.lang for r in table(spark, folder, "documents").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op8_language_id"](spark, folder).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.98


def test_license_sequences(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following\nconditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or\nsubstantial portions of the Software."
    rows = [(1, mit), (2, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (3, "Some text. This licence is unknown."), (4, "nothing"), (5, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].licenses == "MIT" and got[2].licenses == "MIT;CC-BY-NC-4.0" and got[3].licenses == "" and got[3].n_unknown == 1 and set(got) == {1, 2, 3}


def test_every_known_sentence_is_found_alone(spark):
    for known in (licenses.SENTENCES, {"do what you like": "like", "a b": "ab", "ask me first": "ask"}):
        table = spark.createDataFrame(list(enumerate(known)), "doc_id long, text string")
        got = {r.doc_id: r.sentences for r in licenses.scan(table, known).collect()}
        assert got == dict(enumerate(known.values()))


def test_licenses_as_they_are_spelled(spark):
    gpl = ("This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n\n"
           "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
           "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n")
    want = [
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT", 0), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0", 0), ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only", 0),
        ("SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0-or-later", 0), (gpl.format(":", ",", 3), "GPL-3.0-or-later", 0), (gpl.format(";", ";", 2), "GPL-2.0-or-later", 0),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed", "MPL-2.0", 0),
        ("Licensed under CC BY 4.0\nAll rights reserved\ntext\n\nLicensed under the Apache License,\nVersion 2.0", "Apache-2.0;CC-BY-4.0;Proprietary", 0),
        ("Licensed under the MIT. License.", "", 2), ("the mit\n\nlicense \u0001 All rights reserved \u0001", "", 1), ("Not licensed under the MIT license.", "", 1)]
    want += [(f"Foo bar.\n{licenses.SPELLED.get(s, s)}.\nBaz", s, None) for s in licenses.SENTENCES]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(want)], "doc_id long, text string")).collect()}
    for i, (_, names, unknown) in enumerate(want):
        assert (rows[i].sentences, rows[i].n_unknown) == (licenses.KNOWN[names], 0) if unknown is None else (rows[i].licenses, rows[i].n_unknown) == (names, unknown)
    assert set(licenses.SPELLED) == {licenses.plain(s) for s in licenses.SPELLED.values()} and set(licenses.SPELLED) <= set(licenses.SENTENCES)
    own = licenses.scan(spark.createDataFrame([(1, "Ask me first: I may say no.")], "doc_id long, text string"), {"Ask me first: I may say no.": "ask"})
    assert own.first().sentences == "ask"


def test_awkward_rows(spark, awkward, labels):
    n = len(AWKWARD)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (3, ""), (None, "zz yy xx ww vv uu"), (1, "one two three four five six seven eight")], "item_id long, text string")
    assert quality.score(awkward, quality.fit(awkward, labels)).count() == n
    assert rules.judge(awkward, rules.fit(awkward, labels)).count() == n
    got = langid.predict(awkward, langid.fit(awkward), carry=["score", "key"]).collect()
    assert len(got) == n and {r.lang_pred for r in got if r.doc_id in (1, 2, 4, 9)} == {"und"}
    assert {r.doc_id for r in decontam.matches(awkward, bench).collect()} == {8}
    assert decontam.clean(awkward, bench).count() == n - 1
    assert jaccard.keep_first(awkward).columns == awkward.columns
    assert mixing.mix(awkward).count() == n and mixing.copies(awkward).columns == awkward.columns
    assert shards.layout(awkward).count() == n and shards.place(awkward).count() == n
    assert suffixes.cleaned(awkward).count() == n and suffixes.cleaned(awkward).columns == awkward.columns
    assert licenses.scan(awkward).count() == 1


def test_empty_tables(spark, awkward, labels):
    docs, bench = awkward.limit(0), spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).count() == 0 and quality.score(awkward, quality.fit(docs, labels.limit(0))).first().score == 0.5
    assert rules.judge(docs, rules.fit(docs, labels)).count() == 0
    assert langid.predict(docs, langid.fit(docs)).count() == 0 and langid.predict(awkward, langid.fit(docs)).where("lang_pred <> 'und'").count() == 0
    assert decontam.matches(awkward, bench).count() == 0 and decontam.clean(docs, bench).count() == 0
    assert jaccard.groups(docs).count() == 0 and mixing.mix(docs).count() == 0 and mixing.copies(docs).count() == 0
    assert shards.layout(docs).count() == 0 and suffixes.digests(docs).count() == 0 and licenses.scan(docs).count() == 0 and urls.judge(pages).count() == 0


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows, benchmark = {r.doc_id: r for r in docs.collect()}, [five(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    left = [(d, r.text) for d, r in rows.items() if any(c.isalpha() for c in r.text)]
    first = {d for d, n, c in similar(left, 5, 80) if n == 0 or c == d}
    want = {d for d in first if not any(g and len(g & five(rows[d].text)) >= 0.8 * len(g) for g in benchmark)}
    stage = docs
    for i, (_, run) in enumerate(corpus_pipeline.STAGES[:3]):
        stage = run(spark, stage, sf_dir)
        assert stage.columns == docs.columns
    assert {r.doc_id for r in stage.collect()} == want
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} <= want and all(0 <= r.shard < 40 for r in out)
    sizes = collections.Counter(r.source for r in out)
    assert set(sizes) == {rows[d].source for d in want}


def test_pipeline_stages_send_few_rows_a_batch(spark, sf_dir):
    docs, rows = table(spark, sf_dir, "documents").limit(40), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    try:
        for stage in (corpus_pipeline.language, corpus_pipeline.decontamination):
            for given, then in (("10000", "1000"), ("0", "1000"), ("7", "7")):
                spark.conf.set(rows, given)
                assert stage(spark, docs, sf_dir).schema.names == docs.schema.names and spark.conf.get(rows) == then
    finally:
        spark.conf.set(rows, before)


def test_pipeline_language_drops_wrong_labels(spark, tmp_path):
    words = {"en": "the house and with some water under this old bridge where children think about other things".split(),
             "de": "das haus und mit etwas wasser unter dieser alten br\u00fccke wo kinder \u00fcber andere sachen nachdenken".split()}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x, "web", "u") for i in range(120) for x in [("en", "de")[i % 2]]]
    odd = [(1000, " ".join(rng.choices(words["en"], k=30)), "de", "web", "u"), (1001, " ".join(rng.choices(words["de"], k=30)), None, "web", "u"), (1002, "12 34 5", "en", "web", "u")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, url string")
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} | {1001}
