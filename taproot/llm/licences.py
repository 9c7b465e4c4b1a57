"""License scans by canonical digest, in DataFrame expressions only.

A text is made canonical: lower case A-Z, copyright lines out, equivalent
spellings alike, everything but letters and digits to single spaces.  The SHA-256
of that is hash-joined to the digests of known licences; so is that of each line
that speaks of a licence, to those of known notices.  The known texts are a fixed
table of a few rows, so it is broadcast.  A caller may give digests of more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm.licence_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COPYRIGHT = "(?m)^[ \\t#*/;%-]*(?:copyright(?: \\(c\\)| \u00a9)?|\\(c\\)|\u00a9)[ :]*(?:[0-9<\\[{y]|by )[^\\n]*$|^[ \\t#*/;%-]*all rights reserved\\.?[ \\t]*$"


def _where(text: Column, marks: list[str], change) -> Column:
    """``change(text)`` where the text has one of ``marks`` in it, else the text: a plain search is much cheaper than a pattern."""

    def one(x: Column) -> Column:
        held = F.contains(x, F.lit(marks[0]))
        for m in marks[1:]:
            held = held | F.contains(x, F.lit(m))
        return F.when(held, change(x)).otherwise(x)

    return F.transform(F.array(text), one).getItem(0)  # the text is computed once


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""

    def spelt(x: Column) -> Column:
        for usual, others in SPELLINGS.items():
            x = F.regexp_replace(x, F.lit(f"\\b(?:{'|'.join(others)})\\b"), F.lit(usual))
        return x

    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    out = _where(out, ["copyright", "(c)", "\u00a9", "all rights reserved"], lambda x: F.regexp_replace(x, F.lit(_COPYRIGHT), F.lit(" ")))
    out = F.trim(F.regexp_replace(out, F.lit("[^\\p{L}\\p{N}]+"), F.lit(" ")))
    return _where(out, [o for others in SPELLINGS.values() for o in others], spelt)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(digest, licence): one row for each known text."""
    row = F.explode(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])).alias("known_text", "licence")
    return spark.range(1).select(row).select(digest(F.col("known_text")).alias("digest"), "licence").distinct()


def known_texts(spark: SparkSession) -> DataFrame:
    """(digest, licence): one row for each text of TEXTS and each of DIGESTS."""
    longer = F.explode(F.create_map(*[F.lit(x) for n, ds in DIGESTS.items() for d in ds for x in (d, n)])).alias("digest", "licence")
    return known(spark, TEXTS).union(spark.range(1).select(longer))


def licences(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, canonical_sha256, licence, n_notices, notices.

    licence is the known licence that the whole text is, else null; notices are
    the distinct licences whose notices stand in it as lines, sorted and joined by
    commas, n_notices how many such lines there are.  Null, empty and blank texts
    have the digest of the empty text and no licence.  Repeated rows are scanned
    each; an empty table gives an empty result.  ``more(digest, licence)`` adds
    known texts by ``digest()``; the built-in name of a digest goes before its, the
    least of several.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike("(?i)licen[cs]|public domain|\\bcc "))
    marks = F.transform(lines, lambda x: F.sha2(canonical(x).cast("binary"), 256))
    rows = rows.select("doc_id", digest(F.col("text")).alias("canonical_sha256"), marks.alias("marks"))
    whole = known_texts(spark).select(F.col("digest").alias("canonical_sha256"), "licence")
    rows = rows.join(F.broadcast(whole), "canonical_sha256", "left")
    if more is not None:
        added = more.where("digest is not null").groupBy(F.lower("digest").alias("canonical_sha256")).agg(F.min("licence").alias("added"))
        rows = rows.join(added, "canonical_sha256", "left").withColumn("licence", F.coalesce("licence", "added")).drop("added")
    # Notices are few and fixed: their digests are one map literal, looked up in place.
    table = {d: n for d, n in known(spark, NOTICES).collect()}
    names = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    hits = F.filter(F.transform("marks", lambda d: F.element_at(names, d)), lambda x: x.isNotNull())
    rows = rows.withColumn("hits", hits)
    return rows.select("doc_id", "canonical_sha256", "licence", F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"))
