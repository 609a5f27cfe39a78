"""Operator 11, fill in the middle: a text is cut into prefix, middle and suffix, and the middle moves to the end. DataFrame functions only.

A unit is a word with the blanks before it, or the blanks that end the text. `regexp_count` gives a text's units, hashes of its
key choose how many of them (a, b) the prefix and the prefix with the middle have, and one match of a pattern made for the row,
`((?:unit){a}+)((?:unit){b-a}+)(.*)`, captures the three parts. All its quantifiers are possessive or greedy over single
characters, so the match is one walk over the text whatever its length, without recursion or a way back.

A null text is an empty one; empty texts and texts that hold a marker stay plain. A null key is hashed as an empty key, equal
keys are cut alike, ties of the two hashes give an empty middle. Very long texts are cut whole (the count holds a list of one text's units). Rows
are independent: repeated rows each give a row, an empty table gives none. `transform` keeps all other columns, but a column named like one of
its results is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed by the contract: the unit and the markers.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKERS = ("<P>", "<S>", "<M>")
#: The same unit, never giving back what it took.
OWNED = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def numbers(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def between(text: Column, left: str | None, right: str | None) -> Column:
    """The part of `text` after the first `left` and before the first `right`; null stands for the text's own ends."""
    begin = F.locate(left, text) + len(left) if left else F.lit(1)
    end = F.locate(right, text) if right else F.length(text) + 1
    return F.substring(text, begin, end - begin)


def parts(output: Column, form: Column, markers=MARKERS) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output that is not plain. A marker cannot arise where a part meets a marker."""
    p, s, m = markers
    prefix = F.when(form == "psm", between(output, p, s)).otherwise(between(output, p, m))
    suffix = F.when(form == "psm", between(output, s, m)).otherwise(between(output, s, p))
    return prefix, between(output, m, None), suffix


def restore(output: Column, form: Column, markers=MARKERS) -> Column:
    """The text an output was made of."""
    return F.when(form == "plain", output).otherwise(F.concat(*parts(output, form, markers)))


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, percent: int = 50, spm_percent: int = 80, markers=MARKERS) -> DataFrame:
    """`docs` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    `percent` of the texts are rearranged, `spm_percent` of those with the suffix first. The markers must start with `<`, end with `>` and
    hold neither sign inside.
    """
    p, s, m = markers
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.array(*numbers(F.col(f"`{key}`"), seed)).alias("h"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    marked = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    h = [F.col("h")[i] for i in range(4)]
    rows = rows.withColumns({
        "form": F.when((F.col("text") == "") | marked | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm"),
        "a": F.least(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)), "b": F.greatest(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1))})
    pattern = F.concat(F.lit(rf"(?s)\A({OWNED}{{"), F.col("a").cast("string"), F.lit(rf"}}+)({OWNED}{{"), (F.col("b") - F.col("a")).cast("string"), F.lit(r"}+)(.*)\z"))
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)))
    prefix, middle, _ = parts(F.col("output"), F.col("form"), markers)
    cut = F.col("form") != "plain"
    rows = rows.withColumns({"prefix_chars": F.when(cut, F.length(prefix).cast("long")), "middle_chars": F.when(cut, F.length(middle).cast("long"))})
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in RESULTS], *RESULTS)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of each output and of the text restored from it."""
    back = restore(F.col("output"), F.col("form"))
    return transform(docs.select("doc_id", "text")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM cuts),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS o FROM parts),
found AS (SELECT *, strpos(o, '<P>') AS p, strpos(o, '<S>') AS s, strpos(o, '<M>') AS m FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN substr(o, p + 3, s - p - 3) || substr(o, m + 3) || substr(o, s + 3, m - s - 3)
                        ELSE substr(o, p + 3, m - p - 3) || substr(o, m + 3) || substr(o, s + 3, p - s - 3) END) AS restored_sha256
FROM found"""
