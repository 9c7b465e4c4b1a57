"""Policy over findings: suppression, retain rules, thresholds, filters, fixes, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.functions import globs, scalars


def suppressed(findings: DataFrame, blocking: DataFrame, root: str = ".") -> DataFrame:
    """``findings`` with suppressed: its workspace, or the root, holds a blocking diagnostic."""
    stop = blocking.select("workspace", F.lit(True).alias("stop")).distinct()
    everywhere = not blocking.where(F.col("workspace") == root).isEmpty()
    return findings.join(stop, "workspace", "left").withColumn("suppressed", F.coalesce("stop", F.lit(False)) | F.lit(everywhere)).drop("stop")


def _matches(pattern: str):
    regex = globs.glob_regex(pattern)
    return lambda path: path.rlike(regex)


def retained(findings: DataFrame, rules: list[dict]) -> DataFrame:
    """``findings`` with retained_by: the reason of the first rule that holds for all its paths.

    A rule has workspace, pattern, reason and issues (none: any).
    """
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        test = (F.col("workspace") == rule["workspace"]) & F.forall("paths", _matches(rule["pattern"]))
        if rule.get("issues"):
            test &= scalars.issue_name(F.col("issue_type")).isin(*rule["issues"])
        out = F.when(test, rule["reason"]).otherwise(out)
    return findings.withColumn("retained_by", out)


def stale_rules(rules: DataFrame, files: DataFrame) -> DataFrame:
    """Rules (rule, regex) whose pattern no file matches."""
    hits = files.select("path").distinct().join(rules, F.expr("path rlike regex"), "inner").select("rule").distinct()
    return rules.join(hits, "rule", "left_anti")


def above(findings: DataFrame, thresholds: DataFrame, usual: str = "medium") -> DataFrame:
    """Findings whose confidence reaches their workspace's threshold."""
    rows = findings.join(thresholds.select("workspace", "threshold"), "workspace", "left")
    return rows.where(scalars.confidence_rank(F.col("confidence")) >= scalars.confidence_rank(F.coalesce("threshold", F.lit(usual)))).drop("threshold")


def of_issues(findings: DataFrame, issues: list[str]) -> DataFrame:
    return findings.where(scalars.issue_name(F.col("issue_type")).isin(*issues)) if issues else findings


def without_tests(findings: DataFrame) -> DataFrame:
    """A finding goes if any of its paths is a test path."""
    return findings.where(~F.exists("paths", scalars.test_path))


def fix_eligibility(findings: DataFrame, status: DataFrame, profiles: list[str], open_world: list[str]) -> DataFrame:
    """eligible: closed world, found in every profile, every path unreachable in the merged graph."""
    rows = findings.withColumn("_id", F.xxhash64("workspace", F.array_join("paths", ","), "target_profiles"))
    bad = rows.select("_id", F.explode("paths").alias("path")).join(status.where("status = 'unreachable'").select("path"), "path", "left_anti").select("_id").distinct().withColumn("bad", F.lit(True))
    every = F.col("target_profiles") == ",".join(sorted(profiles))
    closed = ~F.col("workspace").isin(*open_world) if open_world else F.lit(True)
    ok = every & closed & (F.col("confidence") == "high") & F.col("bad").isNull()
    return rows.join(bad, "_id", "left").withColumn("fix_eligibility", F.when(ok, "eligible").otherwise("preview_only")).drop("_id", "bad")


def rescan_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(change, *key): findings that appear or vanish between two scans."""
    new = after.select(*key).distinct().join(before.select(*key), key, "left_anti")
    gone = before.select(*key).distinct().join(after.select(*key), key, "left_anti")
    return new.select(F.lit("new").alias("change"), *key).union(gone.select(F.lit("gone").alias("change"), *key))


def exit_code(findings: DataFrame, thresholds: DataFrame, blocking: DataFrame, usual: str = "high") -> int:
    """2 for incomplete coverage, 1 for a finding at its workspace's failure threshold, else 0."""
    if not blocking.isEmpty():
        return 2
    return int(not above(findings, thresholds, usual).isEmpty())
