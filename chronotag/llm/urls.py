"""Operator 6, URL filters: host and path rules, and gradient-boosted trees for the urls no rule fits. DataFrame functions only.

The urls a rule fits are the labelled ones. Lexical features (lengths, depth, digit ratio, entropy, counts of parameters, labels and signs, how
often a host suffix is blocked among the labelled) train boosted trees (pyspark.ml), which judge the rest. A labelled url's own rates leave out
the fold of hosts it is in, so that the trees cannot read its label, or its host's, off them.

Nulls: a null url, or one without `://`, has empty host and path; no rule fits it and the trees judge its features.
Without labelled urls everything else is allowed; with labels of one kind only, that kind is the verdict. Repeated rows are
judged alike. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.llm.common import pinned

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "signs", "parameters", "fragment", "secure", "entropy", "suffix_rate", "domain_rate")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    def part(group):
        return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def add(total, c):
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return total - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))

    return F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), add)


def described(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, the rule's verdict, and the features that need no other rows."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    url, n = F.col("url"), F.greatest(F.length("url"), F.lit(1))
    labels = F.split("host", r"\.")
    return rows.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("known"),
        F.length(url).alias("length"), F.length("host").alias("host_length"), F.length("path").alias("path_length"),
        _count(F.col("path"), "/").alias("depth"), F.size(labels).alias("labels"), (_count(url, "[0-9]") / n).alias("digits"),
        _count(url, "[-_]").alias("hyphens"), _count(url, "[%~+@]").alias("signs"), _count(url, "[&=]").alias("parameters"),
        url.contains("#").cast("int").alias("fragment"), url.startswith("https").cast("int").alias("secure"), _entropy(url).alias("entropy"),
        F.element_at(labels, -1).alias("suffix"), F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)).alias("domain"))


def with_rates(rows: DataFrame, overall: float, strength: float = 5.0, folds: int = 4) -> DataFrame:
    """`rows` with suffix_rate and domain_rate: the share of blocked urls among the labelled ones of the same suffix or domain, drawn towards
    the overall share. For a labelled row only hosts of the other folds count; a fold is a hash of the host."""
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(folds)))
    for name in ("suffix", "domain"):
        blocked = F.sum((F.col("known") == "block").cast("long"))
        by_fold = rows.where(F.col("known").isNotNull()).groupBy(name, "fold").agg(blocked.alias("blocked"), F.count("*").alias("n"))
        # at most `folds` entries a group
        sums = by_fold.groupBy(F.col(name).alias("_name")).agg(
            F.sum("blocked").alias("_blocked"), F.sum("n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("blocked", "n")))).alias("_folds"))
        own = F.when(F.col("known").isNotNull(), F.try_element_at("_folds", F.col("fold")))
        counts = [F.coalesce(F.col(f"_{c}") - F.coalesce(own[c], F.lit(0)), F.lit(0)) for c in ("blocked", "n")]
        rows = rows.join(sums, rows[name] == sums["_name"], "left").withColumn(f"{name}_rate", (counts[0] + strength * overall) / (counts[1] + strength))
        rows = rows.drop("_name", "_blocked", "_n", "_folds")
    return rows.drop("fold")


def judge(pages: DataFrame, rules=RULES, most: int = 50_000, rounds: int = 12, depth: int = 3, seed: int = 7) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides). Trees learn from at most `most` labelled urls."""
    rows = pinned(described(pages, rules))
    share = rows.agg(F.avg((F.col("known") == "block").cast("double")), F.count("known")).first()
    if not share[1] or share[0] in (0.0, 1.0):
        rest = "block" if share[0] == 1.0 else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("known", F.lit(rest)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    rows = with_rates(rows, share[0])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    learn = rows.where(F.col("known").isNotNull()).select("page_id", "features", (F.col("known") == "block").cast("double").alias("label"))
    learn = pinned(learn.orderBy(F.xxhash64("page_id"), "page_id").limit(most).repartition(8, "page_id"))
    if learn.select("label").distinct().count() < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("known", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=64, seed=seed).fit(learn)
    from pyspark.ml.functions import vector_to_array
    judged = trees.transform(rows)
    score = F.when(F.col("known").isNull(), vector_to_array(F.col("probability"))[1])
    by_trees = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("known", by_trees).alias("verdict"), score.alias("score"))
