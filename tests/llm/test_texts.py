"""Fill in the middle, token counts and phrases against brute force, and on awkward and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from chronotag.llm import QUERIES, infill, jaccard, licenses, phrases, tokens
from chronotag.llm.common import table
from chronotag.llm.components import components
from tests.llm.test_operators import AWKWARD, DOCS, documents

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["  ", "a", " a ", "  x y", "a\x1cb \x85c", "tail  \n", "<P> x", "x <S", "<M>", "< P> y", "(a+)+$ {3}+ \\Z $1 \\", "é" * 5000 + " ö", "\U0001f600 " * 50,
       "<|endoftext|> a<|endoftext|>b <|EndOfText|> don't we'll I'd 1234 x_y", "A.b,c;d:e!f?g", "ha " * 60, "İstanbul ΣΑΣ ﬁ ① é e ́ ‍", "\x00 a\x00b", "it's ’s"]


@pytest.fixture(scope="module")
def awkward(spark):
    extra = [(100 + i, t, "xx", "s", i, 1, "k", "s", "h", "z", "p") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*[(*r, 1, "k", "s", "h", "z", "p") for r in AWKWARD], *extra], DOCS).repartition(3)


def infilled(key, text, seed=42):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in infill.MARKERS) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 80
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_brute_force_and_is_undone(spark, awkward, sf_dir):
    from pyspark.sql import functions as F
    odd = [(1000 + i, t) for i, t in enumerate(ODD * 12)]
    for docs in (table(spark, sf_dir, "documents").select("doc_id", "text"), awkward, spark.createDataFrame(odd, "doc_id long, text string")):
        out = infill.transform(docs).withColumn("back", infill.restore(F.col("output"), F.col("form")))
        rows = out.collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == infilled(r.doc_id, r.text or "") and r.back == (r.text or "")
        assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_infill_keeps_columns_and_handles_long_texts(spark):
    text = "wörd \n" * 200_000 + "x" * 500_000
    docs = spark.createDataFrame([(i, text, "mine", "kept") for i in range(6)], "doc_id long, text string, Form string, row string")
    out = infill.transform(docs)
    assert out.columns == ["doc_id", "text", "row", *infill.RESULTS]
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == infilled(r.doc_id, text) and r.row == "kept" for r in out.collect())
    assert infill.digests(docs.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark, awkward, sf_dir):
    from tokenizers import Tokenizer
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(awkward.select("doc_id", "text")).repartition(4)
    rows = [r.text or "" for r in docs.collect()]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        want = collections.Counter((t, len(e.ids)) for t, e in zip(rows, library.encode_batch(rows, add_special_tokens=False)))
        assert tokens.Encoder(tokens.read_definition(path), tokens.Table()).words_apart == (name == "word_bpe_49k.json")
        first = tokens.frequent(docs, path, most=500)
        assert len(first.entries()) == 500 and all(len(library.model.tokenize(p)) == n for p, n in first.entries().items())
        for t in (None, first):
            got = tokens.count(docs, path, t, carry=["text"]).collect()
            assert collections.Counter((r.text or "", r.n_tokens) for r in got) == want
            assert all(r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 2048) for r in got)
    assert QUERIES["op12_token_counts"](spark, sf_dir).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_token_caches_that_are_too_small(spark, sf_dir):
    definition = tokens.read_definition(public_tokenizers.path("word_bpe_49k.json"))
    small, large = tokens.Encoder(definition, tokens.Table("the\nof".encode(), np.array([1, 1])), cache=7), tokens.Encoder(definition, tokens.Table())
    for _, text in documents(spark, sf_dir)[:60]:
        assert small.count(text.encode()) == large.count(text.encode())
    assert len(small.words) <= 7 and len(small.pieces) <= 9 and {"the", "of"} <= set(small.pieces)


def test_token_counts_of_empty_tables_and_clashing_names(spark, awkward):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.count(awkward.limit(0), path, tokens.frequent(awkward.limit(0), path)).count() == 0
    docs = awkward.withColumnsRenamed({"key": "n_tokens", "id": "k0", "spans": "t"})
    got = tokens.count(docs, path, carry=["n_tokens", "k0", "t", "doc_id"])
    assert got.columns == ["doc_id", "k0", "t", "n_bytes", "n_tokens", "over_limit"] and got.count() == len(AWKWARD) + len(ODD)


def ranked(docs, least, within, best):
    """(lang, rank, phrase, a, l, r, n, score) by counting every run of up to three words."""
    f = collections.Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    n, found = collections.Counter(), collections.defaultdict(list)
    for (lang, g), c in f.items():
        n[lang] += c * (len(g) == 1)
    longer = collections.Counter()
    for (lang, g), c in f.items():
        if len(g) == 3 and c >= least:
            for part in (g[:2], g[1:]):
                longer[lang, part] = max(longer[lang, part], c)
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least and not (len(g) == 2 and longer[lang, g] and 100 * longer[lang, g] >= within * a):
            score, k = min((10 ** 6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            found[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best]))


def collected(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("bits", [1, 12, 20])
def test_phrases_equal_brute_force(spark, awkward, bits):
    rng = random.Random(4)
    made = [(rng.choice(["en", "en", None, "de"]), " ".join(rng.choice(["The", "the", "of", "new york", "über", "a", "b\tc", "x.", "y, z", "q\nr"]) for _ in range(rng.randrange(40)))) for _ in range(300)]
    docs = [*made, *[(r.lang, r.text) for r in awkward.collect()]]
    rows = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    for least, within, best in ((2, 50, 2000), (10, 80, 15)):
        assert collected(phrases.phrases(rows, least, within, best, bits)) == ranked(docs, least, within, best)


def test_counts_follow_from_flows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = phrases.edges(docs, 1)
    pairs, words = phrases.flows(found)
    f = collections.Counter()
    for r in docs.select("lang", "text").collect():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((r.lang, " ".join(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    got = {(r.lang, r.gram): r.n for r in pairs.union(words).union(found.where("k = 3").select("lang", "gram", "n")).collect()}
    assert got == f


def test_paths_are_unary_and_hold_every_edge(spark):
    passage = " ".join(f"w{i}" for i in range(2500))
    texts = [passage] * 3 + ["ring a b c ring a b c ring a b c"] * 2 + ["u v x y"] * 3 + ["t v x z"] * 2 + ["s s s s"] * 2 + ["once only here"]
    found = phrases.edges(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"), 2)
    rows = phrases.paths(found, 2).collect()
    heavy = {r.gram: r.n for r in found.where("k = 3 and n >= 2").collect()}
    held = [(" ".join(r.words[i:i + 3]), n) for r in rows for i, n in enumerate(r.weights)]
    assert dict(held) == heavy and len(held) == len(heavy) and all(len(r.words) == len(r.weights) + 2 <= phrases.STRETCH + 2 for r in rows)
    parts = sorted((r.part, r.words) for r in rows if "w0" in r.words or r.words[0].startswith("w"))
    assert [len(w) for _, w in parts] == [1002, 1002, 500] and parts[0][1][:3] == ["w0", "w1", "w2"]
    assert not any({"u", "y"} <= set(r.words) for r in rows)  # (v x) is not unary: in from u and t, out to y and z


def test_phrases_of_empty_tables(spark, awkward):
    assert phrases.phrases(awkward.limit(0)).count() == 0
    assert phrases.phrases(spark.createDataFrame([(None, None), ("en", ""), ("en", " .,; ")], "lang string, text string")).count() == 0


def first_of_each(rows, k, percent):
    """The rows that stay, by comparing all pairs: of each component the least (id, null last, hash of the text)."""
    def shingles(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
        return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    sets, left, out = [shingles(t) for _, t in rows], set(range(len(rows))), []
    out += [rows[i] for i in range(len(rows)) if not sets[i]]
    left -= {i for i in left if not sets[i]}
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i in left:
                left.discard(i)
                group.add(i)
                todo += [j for j in left if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        out.append(min((rows[i] for i in group), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())))
    return sorted(out, key=repr)


def test_keep_first_never_loses_a_text(spark, awkward):
    one, two, three = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3).strip(), "another text with other words that is long enough to count here", "x y z"
    cases = [[(1, one), (8, one), (8, two)], [(8, two), (8, one), (1, one)], [(None, one), (None, one)], [(None, one), (3, one)], [(None, one), (None, two)],
             [(5, two), (5, two)], [(4, three), (4, one + " tail"), (2, one), (None, three), (None, three)]]
    # the cases side by side in one table, each with words of its own
    rows = [(d, " ".join(f"{i}{w}" for w in t.split())) for i, case in enumerate(cases) for d, t in case]
    rows += [(None, None), (None, ""), (2, " "), (2, " "), *[(r.doc_id, r.text) for r in awkward.collect()]]
    docs = spark.createDataFrame([(*r, "m", "n") for r in rows], "doc_id long, text string, mark string, hash string").repartition(3)
    got = jaccard.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == first_of_each(rows, 5, 80)


def scanned(text):
    """(sentences, n_unknown) by walking over words and ends."""
    low = re.sub(r"[.!?;:]+(?:[ \t\n\r]|\Z)|\n[ \t\r]*\n", "\u0001", text.translate(str.maketrans(licenses.UPPER + "\u0001", licenses.LOWER + " ")))
    units = re.findall("[a-z0-9]+|\n|\u0001", low)
    ends = ("\n", "\u0001")
    known = sorted(([[licenses.plain(x).split() for x in re.split(r"[.!?;:]+(?:[ \t\n\r]|\Z)", licenses.SPELLED.get(s, s))], i] for s, i in licenses.KNOWN.items()),
                   key=lambda x: -sum(map(len, x[0])))

    def match(at, parts):
        for n, words in enumerate(p for p in parts if p):
            for m, word in enumerate(words):
                while at < len(units) and ((m and units[at] == "\n") or (n and not m and units[at] in ends)):
                    at += 1
                if at >= len(units) or units[at] != word:
                    return None
                at += 1
        return at if at == len(units) or units[at] in ends else None
    found, left, at = [], [], 0
    while at < len(units):
        hit = None
        if units[at] not in ends and (at == 0 or units[at - 1] in ends):
            hit = next(((stop, i) for parts, i in known for stop in [match(at, parts)] if stop), None)
        if hit:
            found.append(hit[1])
            at = hit[0]
        else:
            left.append(units[at])
            at += 1
    lines = re.split("[\n\u0001]", " ".join(left))
    return ";".join(found), sum(bool(re.search(r"(^| )licen[sc](e|es|ed|ing)( |$)", x)) for x in lines)


def test_licence_sentences_equal_a_walk_over_words(spark, sf_dir):
    rng = random.Random(2)
    spelled = [licenses.SPELLED.get(s, s) for s in licenses.KNOWN]
    docs = [*documents(spark, sf_dir)]
    for i in range(300):
        parts = [rng.choice([rng.choice(spelled), rng.choice(spelled).upper(), rng.choice(spelled).replace(" ", "\n", 3), "some words", "a licence of sorts", "Licensed."]) for _ in range(rng.randrange(1, 6))]
        docs.append((10_000 + i, rng.choice(["", " ", "\n", "- "]) + "".join(p + rng.choice([". ", "\n", "\n\n", " ", "; ", "! \n "]) for p in parts)))
    got = {r.doc_id: (r.sentences, r.n_unknown) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {d: x for d, t in docs for x in [scanned(t or "")] if x != ("", 0)}
    assert got == want and len(want) > 250


def test_components_runs_few_tasks_over_few_links(spark):
    """The driver keeps a record of each task, so a table of a few links is not read again by a task for every shuffle partition."""
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21), (22, 21), (30, 30), (21, 20)], "a long, b long")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before, context = [spark.conf.get(n) for n in names], spark.sparkContext
    try:
        for name, value in zip(names, ("60", "false")):
            spark.conf.set(name, value)
        context.setJobGroup("few-tasks", "components of a few links")
        got = components(links)
        status = context.statusTracker()
        stages = {s for j in status.getJobIdsForGroup("few-tasks") for s in status.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert sorted(map(tuple, got.collect())) == [*((i, 1) for i in range(1, 10)), (20, 20), (21, 20), (22, 20)]
    assert tasks < 1600  # 1082; pinned half rounds took 2946


def test_counts_of_shingles_come_without_a_row_each(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j}" for j in range(30))) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "collect", lambda self: pytest.fail("a row for each bucket"))
    _, counts = jaccard.survey(docs, 5)
    expected = np.zeros(len(counts), np.int64)
    for i in range(40):
        text = " ".join(f"w{i * j}" for j in range(30)).encode()
        hashes, owner = jaccard.shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 5)
        expected += np.bincount(jaccard._bucket(np.unique(hashes)), minlength=len(counts))
    assert (counts == expected).all()
