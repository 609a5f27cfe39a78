"""One query per operator, over its whole table with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from chronotag.llm import decontam, infill, jaccard, langid, licenses, mixing, phrases, quality, rules, shards, suffixes, tokens, urls
from chronotag.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


@query
def op3_quality_rules(spark, folder):
    docs = table(spark, folder, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, folder, "labels")))


@query
def op8_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.fit(docs))


@query
def op2_mixing(spark, folder):
    mixed = mixing.ordered(mixing.mix(table(spark, folder, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_url_filter(spark, folder):
    return urls.judge(table(spark, folder, "pages"))


@query
def op7_sharding(spark, folder):
    return shards.layout(table(spark, folder, "documents"))


ORACLES["op2_mixing"] = mixing.SQL


@query
def op4_decontamination(spark, folder):
    return decontam.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op9_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


ORACLES["op9_license_scan"] = licenses.SQL


@query
def op5_ngram_jaccard(spark, folder):
    return jaccard.groups(table(spark, folder, "documents"), k=4, percent=85)


@query
def op10_suffix_dedup(spark, folder):
    return suffixes.digests(table(spark, folder, "documents"))


@query
def op11_infill(spark, folder):
    return infill.digests(table(spark, folder, "documents"))


ORACLES["op11_infill"] = infill.SQL


@query
def op12_token_counts(spark, folder, path=None):
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, folder, "documents")
    return tokens.count(docs, path, tokens.frequent(docs, path))


@query
def op13_phrases(spark, folder):
    return phrases.phrases(table(spark, folder, "documents"))


ORACLES["op13_phrases"] = phrases.SQL
