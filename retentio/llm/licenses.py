"""Licence scan by canonical digest lookup.

Texts are brought to a canonical form (lower case, no copyright statements,
one spelling of words that licences spell in several ways, only letters and
digits) and digested; digests are hash-joined with the digests of known
licence texts, canonicalised alike. Line breaks play no part in the form of a
whole text. A document is looked up as a whole, and each of its lines as a
text of its own, which finds one-line notices.

The known table is broadcast up to ``MAX_KNOWN`` rows and shuffled beyond.

Defined cases: null text is empty; a text without letters or digits has no
digest and matches nothing; repeated rows match alike; of several known texts
with one digest the smallest name counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import license_texts
from retentio.llm.common import row_key, sized

MAX_KNOWN = 1_000_000

# Equivalent spellings (after lower-casing), first becomes second.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"), ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"), ("favour", "favor"), ("organisation", "organization"),
    ("whilst", "while"), ("https:", "http:"),
)
# A copyright statement is a sign or a year behind the word or
# the sign, and the holder: up to the end of the line, or to words that open a
# licence, whichever comes first (200 characters at most).
YEARS = r"(?:[0-9]{4}|<year>|\[year\]|\[yyyy\])(?:\s*[-–,]\s*(?:[0-9]{4}|present))*"
OPENERS = ("permission is hereby granted", "permission to use", "permission is granted", "redistribution and use",
           "licensed under", "released under", "distributed under", "this software is", "this program is", "this file is",
           "this library is", "this work is", "this source code", "boost software license", "everyone is permitted",
           "all rights reserved", "the above copyright")
STATEMENT = (rf"(?:(?:copyright\s*(?:\(c\)|©)|©)(?:\s*{YEARS})?|(?:copyright|\(c\))\s*{YEARS})"
             rf"[^\n]{{0,200}}?(\n|\z|{'|'.join(OPENERS)})")
RESERVED = "all rights reserved"
OTHERS = r"[^a-z0-9\x{80}-\x{10FFFF}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that have a letter or digit."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), STATEMENT, "$1")
    t = F.replace(t, F.lit(RESERVED), F.lit(""))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    lines = F.split(F.regexp_replace(t, OTHERS, " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def digest(lines: Column) -> Column:
    """Digest of canonical lines as one text; null where there are none."""
    return F.when(F.size(lines) > 0, F.md5(F.array_join(lines, " ")))


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license): digests of the given texts, or of the known ones
    (:mod:`retentio.llm.license_texts`): short texts with and without a title,
    standard headers, one-line notices by rule, long texts by digest."""
    if texts is None:
        rows = [*license_texts.texts(), *((f"{n} notice", t) for n, t in license_texts.notices())]
    else:
        rows = sorted(texts.items())
    known = spark.createDataFrame(rows, "license string, text string")
    known = known.select("license", digest(canonical_lines(F.col("text"))).alias("digest")).where("digest IS NOT NULL")
    if texts is None:
        long = [(name, d) for name, d in license_texts.DIGESTS.items()]
        known = known.unionByName(spark.createDataFrame(long, "license string, digest string"))
    return known.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, license (of the whole
    text), notices (sorted names found as lines, comma-joined), n_notices
    (lines found)."""
    known = sized(known.select(F.col("digest").alias("_d"), F.col("license").alias("_name")), MAX_KNOWN)
    d = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("_key"), "doc_id",
                    canonical_lines(F.col("text")).alias("_lines"))
    lines = d.select("_key", F.posexplode("_lines").alias("_at", "_line")).withColumn("_md5", F.md5("_line"))
    found = lines.join(known, F.col("_md5") == F.col("_d")).select("_key", "_at", "_name").distinct()
    per = found.groupBy("_key").agg(F.array_join(F.array_sort(F.collect_set("_name")), ",").alias("_notices"),
                                    F.count(F.lit(1)).alias("_n")).withColumnRenamed("_key", "_k")
    whole = d.select("_key", "doc_id", digest(F.col("_lines")).alias("digest"))
    whole = whole.join(known, F.col("digest") == F.col("_d"), "left")
    return whole.join(per, F.col("_key") == F.col("_k"), "left").select(
        "doc_id", "digest", F.col("_name").alias("license"), F.coalesce("_notices", F.lit("")).alias("notices"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_notices"))
