"""Deterministic reports: JSON rows, SARIF results, compact lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.functions import scalars


def json_rows(findings: DataFrame, fields: list[str]) -> DataFrame:
    """One JSON object a finding, fields in order, those that are null left out."""
    return findings.select(F.to_json(F.struct(F.lit("0.2").alias("schemaVersion"), *fields)).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(rule_id, uri, start, message): one result for each path; only the first carries the span."""
    rows = findings.select("issue_id", "start", "summary", F.posexplode("paths").alias("i", "path"))
    return rows.select(F.col("issue_id").alias("rule_id"), scalars.uri_path(F.col("path")).alias("uri"), F.when(F.col("i") == 0, F.col("start")).alias("start"), F.col("summary").alias("message"))


def sarif_document(findings: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(json): one SARIF 2.1.0 result a row, of findings and of diagnostics, in the order of their keys.

    The rows are the ``results`` array; a writer puts ``sarif_head`` before and
    ``]}]}`` after them, so no task holds a whole report.
    """
    places = sarif_results(findings).select("rule_id", F.lit("warning").alias("level"), "uri", F.col("start").cast("long").alias("start"), "message")
    notes = diagnostics.select(F.col("code").alias("rule_id"), F.when(F.col("blocks"), "error").otherwise("note").alias("level"), scalars.uri_path(F.col("path")).alias("uri"), F.col("start").cast("long").alias("start"), "message")
    rows = places.union(notes).distinct()
    place = F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), F.when(F.col("start").isNotNull(), F.struct(F.col("start").alias("byteOffset"))).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return rows.orderBy("uri", F.coalesce("start", F.lit(4294967295)), "rule_id", "message").select(F.to_json(result).alias("json"))


def sarif_head(version: str) -> str:
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "taproot", "version": version}}, "results": []}]})[: -len("]}]}")]


def human_lines(findings: DataFrame, ascii_only: bool = False) -> DataFrame:
    """A line a finding for people: mark, code, summary and paths, control characters replaced."""
    mark = "*" if ascii_only else "\u2022"
    paths = F.array_join(F.transform("paths", scalars.sanitized), ", ")
    return findings.select(F.concat(F.lit(mark + " "), "issue_id", F.lit("  "), scalars.sanitized(F.col("summary")), F.lit(" ("), paths, F.lit(")")).alias("line"))


def placed_lines(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """``path:line:column - CODE 'name' is unused``; a finding of several paths, or without a start, has no position."""
    rows = findings.select("issue_id", "name", "start", F.size("paths").alias("n"), F.explode("paths").alias("path"))
    at = scalars.line_and_column(F.col("text"), F.col("start").cast("int"))
    rows = rows.join(sources.select("path", "text"), "path", "left").withColumn("at", F.when((F.col("n") == 1) & F.col("start").isNotNull() & F.col("text").isNotNull(), F.concat_ws(":", F.lit(""), at["line"].cast("string"), at["column"].cast("string"))).otherwise(F.lit("")))
    return rows.select(F.concat(scalars.sanitized(F.col("path")), "at", F.lit(" - "), "issue_id", F.lit(" '"), scalars.sanitized(F.col("name")), F.lit("' is unused")).alias("line"))


def compact_lines(findings: DataFrame) -> DataFrame:
    """``path - CODE 'name' is unused``, a line for each path."""
    rows = findings.select("issue_id", "name", F.explode("paths").alias("path"))
    return rows.select(F.concat(scalars.sanitized(F.col("path")), F.lit(" - "), F.col("issue_id"), F.lit(" '"), scalars.sanitized(F.col("name")), F.lit("' is unused")).alias("line"))
