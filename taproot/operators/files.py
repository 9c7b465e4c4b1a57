"""File rules: status, unreachable files, summaries and the merge of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taproot.operators import graph

#: Statuses from least to most live; the merge of profiles takes the last.
STATUSES = ("unreachable", "incomplete", "reachable")


def file_status(files: DataFrame, entries: DataFrame, edges: DataFrame, blockers: DataFrame, profiles: DataFrame, limit: int | None = None) -> DataFrame:
    """(profile, path, workspace, status) of every file in every profile.

    A fatal file is incomplete.  A blocker on a reachable file makes all that is
    not reachable in its profile incomplete: missing coverage proves nothing.
    """
    live = graph.checkpointed(graph.reachable(edges, entries, limit)).withColumn("live", F.lit(True))
    blocked = blockers.join(live, ["profile", "path"], "left_semi").select("profile").distinct().withColumn("blocked", F.lit(True))
    rows = profiles.join(blocked, "profile", "left").join(files.select("path", "workspace", "fatal"))
    rows = rows.join(live, ["profile", "path"], "left")
    status = F.when(F.col("fatal"), "incomplete").when(F.col("live"), "reachable").when(F.col("blocked"), "incomplete").otherwise("unreachable")
    return rows.select("profile", "path", "workspace", status.alias("status"))


def unreachable_findings(status: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(profile, paths, n, summary): one finding for each strong component of unreachable files.

    A profile that is blocked has no unreachable file left, so no finding.
    """
    dead = status.where("status = 'unreachable'").select("profile", "path")
    groups = graph.strong_components(edges, dead, limit).groupBy("profile", "component").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    n = F.size("paths")
    summary = F.when(n > 1, F.concat(n.cast("string"), F.lit(" files form an unreachable cycle"))).otherwise(F.concat(F.col("paths")[0], F.lit(" is unreachable")))
    return groups.select("profile", "paths", n.cast("long").alias("n"), summary.alias("summary"))


def status_summary(status: DataFrame) -> DataFrame:
    """Counters of a report, by profile."""
    return status.groupBy("profile").agg(F.count("*").alias("files"), *[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in reversed(STATUSES)])


def merged_status(status: DataFrame) -> DataFrame:
    """(path, status, target_statuses): reachable wins over incomplete over unreachable.

    target_statuses is profile=status, in profile order.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    each = F.array_sort(F.collect_list(F.concat_ws("=", "profile", "status")))
    return status.groupBy("path").agg(F.max(rank).cast("int").alias("rank"), each.alias("each")).select("path", F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.col("rank")).alias("status"), F.array_join("each", ",").alias("target_statuses"))


def merged_findings(findings: DataFrame, key: list[str], rest: list[str]) -> DataFrame:
    """Findings alike in ``key`` are one, with the sorted union of their profiles; the first profile's other fields win."""
    first = F.min_by(F.struct(*rest), F.struct("profile", *rest)).alias("x")
    out = findings.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("profile")), ",").alias("target_profiles"), first)
    return out.select(*key, "target_profiles", *[F.col(f"x.{c}").alias(c) for c in rest])


def merged_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics that differ in their ``[target x]`` prefix only are one, with all profiles in front."""
    profile = F.regexp_extract("message", r"^\[target ([^\]]*)\] ", 1)
    plain = F.regexp_replace("message", r"^\[target [^\]]*\] ", "")
    out = diagnostics.select("path", "code", "start", profile.alias("profile"), plain.alias("plain")).groupBy("path", "code", "start", "plain").agg(F.array_join(F.array_sort(F.collect_set("profile")), ", ").alias("profiles"))
    return out.select("path", "code", "start", F.when(F.col("profiles") == "", F.col("plain")).otherwise(F.concat(F.lit("[target "), F.col("profiles"), F.lit("] "), F.col("plain"))).alias("message"))


def capped_diagnostics(diagnostics: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows in report order; what is over becomes one row that says how many.

    Spark plans the cut as a top-k: every task passes on its first rows only.
    """
    order = ["path", F.coalesce("start", F.lit(4294967295)), "code", "message"]
    total = diagnostics.count()
    if total <= most:
        return diagnostics.orderBy(*order)
    kept = diagnostics.orderBy(*order).limit(most - 1)
    over = diagnostics.sparkSession.range(1).select(*[F.lit(v).cast(diagnostics.schema[c].dataType).alias(c) for c, v in {"path": ".", "code": "diagnostic_limit_exceeded", "start": None, "message": f"{total - most + 1} further diagnostics"}.items()])
    return kept.select("path", "code", "start", "message").union(over)


def in_report_order(findings: DataFrame) -> DataFrame:
    """Workspace, first path, start (none last), issue, symbol (none first), dependency (none first)."""
    return findings.orderBy("workspace", F.col("paths")[0], F.coalesce("start", F.lit(4294967295)), "issue_id", F.asc_nulls_first("symbol"), F.asc_nulls_first("dependency"))


def discovery_rank(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first of ``order`` among rows alike in ``by``: first match wins."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
