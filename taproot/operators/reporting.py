"""Reports: merges over profiles, retentions, summaries, orders, diagnostics of projects, explanations, fix plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions import scalars
from taproot.operators import files, graph

#: What makes two findings the same one.
FINDING_KEY = ("issue_id", "issue_type", "workspace", "paths", "start", "symbol", "dependency")
#: What makes two imports of a file the same one.
IMPORT_KEY = ("path", "specifier", "kind", "mode", "activation", "type_only", "status", "target", "start")
EXPORT_KEY = ("path", "name", "kind", "type_only", "start")
#: Scripts that can't be read and therefore block.
BLOCKING_SCRIPTS = ("shell_expansion", "glob_expansion", "unsupported_shell_syntax", "unsupported_shell_wrapper")
#: What each issue is about, for explanations.
ISSUES = {
    "ORP1001": "A source file has no path from any configured entry",
    "ORP1002": "An export has no consumer in the analyzed project",
    "ORP1003": "A declaration, or a group that refers to itself only, has no live reference",
    "ORP1004": "A class member has no reference or contract that keeps it",
    "ORP2001": "A declared dependency has no evidence of use",
    "ORP2002": "A package is used without a declaration in its workspace",
    "ORP3001": "A workspace package has no evidence of use",
}


def merged_findings(findings: DataFrame, order: dict[str, int]) -> DataFrame:
    """Findings alike in all seven fields of their identity are one: sorted profiles, other fields of the earliest profile.

    ``order`` tells the place of each profile.
    """
    rest = [c for c in findings.columns if c not in (*FINDING_KEY, "profile")]
    place = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("profile"))
    first = F.min_by(F.struct(*rest), F.struct(place, *rest)).alias("x")
    out = findings.groupBy(*FINDING_KEY).agg(F.array_sort(F.collect_set("profile")).alias("target_profiles"), first)
    return out.select(*FINDING_KEY, "target_profiles", *[F.col(f"x.{c}").alias(c) for c in rest])


def merged_retentions(retentions: DataFrame) -> DataFrame:
    """(item, item_type, workspace, summary, target_profiles, evidence): sorted unions of profiles and evidence."""
    key = ["item", "item_type", "workspace", "summary"]
    return retentions.groupBy(*key).agg(F.array_sort(F.collect_set("profile")).alias("target_profiles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def merged_imports(imports: DataFrame) -> DataFrame:
    """Imports of all profiles: those alike but for the profile are one, with all of them."""
    return imports.groupBy(*IMPORT_KEY).agg(F.array_sort(F.collect_set("profile")).alias("target_profiles"))


def merged_exports(exports: DataFrame) -> DataFrame:
    return exports.select(*EXPORT_KEY).distinct()


def retentions_of_blocked(findings: DataFrame, blocking: DataFrame, root: str = ".") -> tuple[DataFrame, DataFrame]:
    """(findings that stay, retentions): a finding in a workspace with a blocking diagnostic becomes a retention.

    The evidence is the codes that block it.  A blocker of the root blocks all workspaces.
    """
    codes = blocking.groupBy("workspace").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    everywhere = F.broadcast(blocking.where(F.col("workspace") == root).agg(F.array_sort(F.collect_set("code")).alias("all_codes")))  # one row
    none = F.expr("cast(array() as array<string>)")
    rows = findings.join(codes, "workspace", "left").join(everywhere)
    rows = rows.withColumn("codes", F.array_sort(F.array_union(F.coalesce("codes", none), F.coalesce("all_codes", none)))).drop("all_codes")
    kept = rows.where(F.size("codes") == 0).drop("codes")
    held = rows.where(F.size("codes") > 0)
    return kept, held.select("profile", display_item().alias("item"), scalars.issue_name(F.col("issue_type")).alias("item_type"), "workspace", F.lit("coverage is incomplete").alias("summary"), F.transform("codes", lambda c: F.concat(F.lit("blocked by "), c)).alias("evidence"))


def described(issue_id: Column) -> Column:
    """What an issue is about; null for one that isn't known."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in ISSUES.items() for x in pair]), issue_id)


def display_item() -> Column:
    """What a finding is called: its symbol, its dependency, or its paths."""
    return F.coalesce("symbol", "dependency", F.array_join("paths", ", "))


def mode_name(modes: DataFrame) -> DataFrame:
    """(mode): that of all workspaces, or ``mixed``; without any ``balanced``."""
    one = modes.agg(F.count_distinct("mode").alias("n"), F.min("mode").alias("mode"))
    return one.select(F.when(F.col("n") > 1, "mixed").otherwise(F.coalesce("mode", F.lit("balanced"))).alias("mode"))


def completeness(diagnostics: DataFrame) -> DataFrame:
    """(profile, coverage): incomplete as soon as one diagnostic blocks."""
    return diagnostics.groupBy("profile").agg(F.when(F.bool_or("blocks"), "incomplete").otherwise("complete").alias("coverage"))


def failures(findings: DataFrame, thresholds: DataFrame, usual: str = "high") -> DataFrame:
    """(workspace, findings, failing): how many findings reach their workspace's failure threshold."""
    rows = findings.join(thresholds, "workspace", "left").withColumn("over", scalars.confidence_rank(F.col("confidence")) >= scalars.confidence_rank(F.coalesce("threshold", F.lit(usual))))
    return rows.groupBy("workspace").agg(F.count("*").alias("findings"), F.count_if("over").alias("failing"))


def metrics(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """(files, bytes, lines, cache_hits, cache_misses) of ``sources(path, text)`` and ``cache(path, hit)``."""
    text = F.coalesce("text", F.lit(""))
    size = sources.agg(F.count("*").alias("files"), F.sum(F.octet_length(text)).alias("bytes"), F.sum(scalars.line_count(text)).cast("long").alias("lines"))
    held = cache.agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))
    return size.join(F.broadcast(held))  # one row each


def dependency_evidence(imports: DataFrame, status: DataFrame, owners: DataFrame) -> DataFrame:
    """(workspace, package, kind, scope, source, reachable): what source imports say about packages.

    ``imports(path, specifier, type_only, status, target)``; imports of project
    files, and external ones that have a target in it, are inner edges and say nothing.
    """
    inner = (F.col("status") == "resolved") | ((F.col("status") == "external") & F.col("target").isNotNull())
    rows = imports.where(~inner).withColumn("package", scalars.package_name(F.col("specifier"))).where("package is not null")
    rows = rows.join(status.select("path", (F.col("status") == "reachable").alias("reachable")), "path").join(owners.select("path", "owner"), "path", "left")
    return rows.select(F.coalesce("owner", F.lit(".")).alias("workspace"), "package", F.when(F.col("type_only"), "type_only_import").otherwise("source_import").alias("kind"), F.when(F.col("type_only"), "contract").otherwise("runtime").alias("scope"), F.concat("path", F.lit(" imports "), "specifier").alias("source"), "reachable").distinct()


def dependency_text(kind: Column, package: Column) -> Column:
    """What a dependency finding says."""
    return F.when(kind == "unreferenced_peer", F.concat(F.lit("peer dependency "), package, F.lit(" has no reachable contract evidence"))).when(kind == "unreferenced_optional", F.concat(F.lit("optional dependency "), package, F.lit(" has no reachable conditional evidence"))).otherwise(F.concat(F.lit("dependency "), package, F.lit(" has no reachable evidence")))


def manifest_path(workspace: Column) -> Column:
    return F.when(workspace.isin(".", ""), "package.json").otherwise(F.concat(workspace, F.lit("/package.json")))


def dependency_findings(outcomes: DataFrame, manager_known: bool = True) -> DataFrame:
    """Rows of a report for dependency outcomes that are findings, with whether a fix may remove them."""
    rows = outcomes.where(~F.col("kind").isin("retained", "undetermined"))
    listed = F.col("kind").isin("unlisted", "misplaced")
    sure = (F.col("confidence") == "high") & ~listed
    fix = F.when(sure & F.lit(manager_known), "eligible").when(F.col("confidence") == "high", "preview_only").otherwise("blocked")
    summary = F.when(listed, F.concat("package", F.lit(" is used without a declaration in its workspace"))).otherwise(dependency_text(F.col("kind"), F.col("package")))
    return rows.select(F.when(listed, "ORP2002").otherwise("ORP2001").alias("issue_id"), F.when(listed, "unlistedDependency").otherwise("unusedDependency").alias("issue_type"), "workspace", manifest_path(F.col("workspace")).alias("path"), F.col("package").alias("dependency"), "confidence", summary.alias("summary"), fix.alias("fix_eligibility"))


def script_diagnostics(unmodeled: DataFrame, missing: DataFrame) -> DataFrame:
    """(path, code, message, blocks) of ``unmodeled(workspace, script, kind, start, end)`` and ``missing(workspace, caller, callee)``."""
    text = F.concat(F.lit("scripts."), "script", F.lit(" contains an unmodeled "), "kind", F.lit(" span at bytes "), F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string"))
    one = unmodeled.select(manifest_path(F.col("workspace")).alias("path"), F.lit("unmodeled_package_script").alias("code"), text.alias("message"), F.col("kind").isin(*BLOCKING_SCRIPTS).alias("blocks"))
    two = missing.select(manifest_path(F.col("workspace")).alias("path"), F.lit("missing_package_script").alias("code"), F.concat(F.lit("scripts."), "caller", F.lit(" invokes missing script "), "callee").alias("message"), F.lit(False).alias("blocks"))
    return one.union(two).distinct()


def stale_diagnostics(retain: DataFrame, ignore: DataFrame) -> DataFrame:
    """(path, code, message, blocks) of rules (workspace, rule) that match nothing."""
    text = lambda kind: F.concat(F.lit(f"{kind} rule `"), "rule", F.lit("` matches no file"))
    return retain.select(manifest_path(F.col("workspace")).alias("path"), F.lit("stale_retain_rule").alias("code"), text("retain").alias("message"), F.lit(False).alias("blocks")).union(
        ignore.select(manifest_path(F.col("workspace")), F.lit("stale_ignore_rule"), text("ignore"), F.lit(False))
    )


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Workspace, first path, start (none last), issue, symbol and dependency (none first)."""
    return files.in_report_order(findings)


def ordered_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """Path, start (none last), code, message; alike rows once."""
    return diagnostics.distinct().orderBy("path", F.coalesce("start", F.lit(4294967295)), "code", "message")


def ordered_imports(imports: DataFrame) -> DataFrame:
    return imports.orderBy("path", "start", "specifier", F.asc_nulls_first("target"))


def ordered_dependencies(outcomes: DataFrame) -> DataFrame:
    return outcomes.orderBy("workspace", "package", "kind")


def ordered_members(members: DataFrame) -> DataFrame:
    return members.orderBy("class", "name", "is_static")


def ordered_retentions(retentions: DataFrame) -> DataFrame:
    return retentions.orderBy("workspace", "item_type", "item", "summary")


def ranks(rows: DataFrame, order: DataFrame, key: list[str]) -> DataFrame:
    """``key`` with the place of each row in ``order``, counted in the order's range partitions.

    Partitions are ranges of the order, so a row's place is its place in its
    partition after the sizes of those before: no task holds all rows.
    """
    cut = graph.checkpointed(order.select(*key).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = cut.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before)  # one row a partition
    return cut.join(F.broadcast(sizes), "part").select(*key, (F.col("at") - F.col("low") + F.col("before")).alias("place"))


def explained(queries: DataFrame, retentions: DataFrame, findings: DataFrame, status: DataFrame, imports: DataFrame) -> DataFrame:
    """(query, status, summary): of each question the first answer by precedence.

    A retention, a finding (by symbol, dependency, workspace or path), a file, a
    package that a reachable file imports, or nothing.  All questions are answered in one plan.
    """
    kept = retentions.select(F.col("item").alias("query"), F.lit(1).alias("rank"), F.struct(F.col("workspace"), F.col("summary")).cast("struct<a:string,b:string>").alias("by"), F.lit("retained").alias("status"), F.col("summary"))
    names = F.array_distinct(F.concat(F.array("symbol", "dependency", "workspace"), F.col("paths")))
    told = findings.select(F.explode(names).alias("query"), F.lit(2).alias("rank"), F.struct(F.col("workspace"), F.array_join("paths", ",")).cast("struct<a:string,b:string>").alias("by"), F.lit("reported").alias("status"), "summary").where("query is not null")
    said = F.when(F.col("status") == "reachable", F.concat("path", F.lit(" is reachable from a configured entry"))).when(F.col("status") == "incomplete", F.concat(F.lit("Analysis cannot decide whether "), "path", F.lit(" is reachable"))).otherwise(F.concat("path", F.lit(" has no path from a configured entry")))
    state = F.when(F.col("status") == "reachable", "retained").when(F.col("status") == "incomplete", "incomplete").otherwise("reported")
    file = status.select(F.col("path").alias("query"), F.lit(3).alias("rank"), F.struct(F.lit(""), F.lit("")).cast("struct<a:string,b:string>").alias("by"), state.alias("status"), said.alias("summary"))
    live = status.where("status = 'reachable'").select("path")
    used = imports.where("status = 'external'").join(live, "path", "left_semi").withColumn("query", scalars.package_name(F.col("specifier"))).where("query is not null")
    package = used.select("query", F.lit(4).alias("rank"), F.struct("path", "specifier").cast("struct<a:string,b:string>").alias("by"), F.lit("retained").alias("status"), F.concat("query", F.lit(" is retained by a reachable external import")).alias("summary"))
    answers = kept.unionByName(told).unionByName(file).unionByName(package).join(queries.select("query").distinct(), "query", "left_semi")
    first = answers.groupBy("query").agg(F.min_by(F.struct("status", "summary"), F.struct("rank", "by", "summary")).alias("x"))
    none = F.concat(F.lit("No analyzed file, finding, or retained package matches `"), F.col("query"), F.lit("`"))
    return queries.select("query").distinct().join(first, "query", "left").select("query", F.coalesce("x.status", F.lit("not_found")).alias("status"), F.coalesce("x.summary", none).alias("summary"))


def fix_plan(findings: DataFrame, requests: DataFrame, digests: DataFrame, manager: str | None, complete: bool) -> DataFrame:
    """(request, action, workspace, target, digest, refused): what a fix of each request would do.

    ``requests(request)`` are paths, dependency names or workspace:name.  A
    dependency goes if a manager is known; a name that several workspaces have is
    ambiguous; a file goes with the digest that was analysed.  Nothing is planned
    while coverage is incomplete.
    """
    deps = findings.where("issue_type = 'unusedDependency' and fix_eligibility in ('eligible', 'preview_only')").select("workspace", F.col("dependency").alias("target"), F.lit("remove_dependency").alias("action"))
    named = deps.select(F.col("target").alias("request"), "*").union(deps.select(F.concat_ws(":", "workspace", "target"), "*")).distinct()
    paths = findings.where("issue_type in ('unusedFile', 'unusedFiles') and fix_eligibility = 'eligible'").select(F.explode("paths").alias("request"), "workspace").distinct()
    paths = paths.select("request", "workspace", F.col("request").alias("target"), F.lit("delete_file").alias("action"))
    rows = named.union(paths)
    many = rows.groupBy("request").agg(F.count("*").alias("n"))
    rows = requests.select("request").distinct().join(many, "request", "left").join(rows, "request", "left").join(digests.select(F.col("path").alias("target"), "digest"), "target", "left")
    why = F.when(F.lit(not complete), "incomplete_coverage").when(F.col("n").isNull(), "not_eligible").when(F.col("n") > 1, "ambiguous").when((F.col("action") == "remove_dependency") & F.lit(manager is None), "unknown_manager").when((F.col("action") == "delete_file") & F.col("digest").isNull(), "not_analyzed")
    return rows.select("request", "action", "workspace", "target", "digest", why.alias("refused"))


def deep_liveness(evidence: DataFrame, status: DataFrame, open_owners: DataFrame) -> DataFrame:
    """(path, position, deep, receiver_may_reference, live_override_contract) from answers of a type checker.

    ``evidence(path, position, status, references array<path>, overrides
    array<struct<owner, exported, references>>)``.  A reference counts if its file
    is reachable; an override is live if its base has no declaration, a reachable
    reference, or an exported owner in an open package.
    """
    live = status.where("status = 'reachable'").select(F.col("path").alias("ref"))
    key = ["path", "position"]
    seen = evidence.select(*key, F.explode("references").alias("ref")).join(live, "ref", "left_semi").select(*key).distinct().withColumn("receiver_may_reference", F.lit(True))
    over = evidence.select(*key, F.explode("overrides").alias("o")).select(*key, "o.*")
    by_ref = over.select(*key, F.explode("references").alias("ref")).join(live, "ref", "left_semi").select(*key)
    no_base = over.where(F.size("references") == 0).select(*key)
    exported = over.where("exported").join(open_owners.select("owner"), "owner", "left_semi").select(*key)
    kept = by_ref.union(no_base).union(exported).distinct().withColumn("live_override_contract", F.lit(True))
    rows = evidence.select(*key, F.col("status").alias("deep")).join(seen, key, "left").join(kept, key, "left")
    ok = F.col("deep") == "resolved"
    return rows.select(*key, "deep", (ok & F.coalesce("receiver_may_reference", F.lit(False))).alias("receiver_may_reference"), (ok & F.coalesce("live_override_contract", F.lit(False))).alias("live_override_contract"))


def deep_candidates(decided: DataFrame, modes: DataFrame) -> DataFrame:
    """Deferred members of files that are analysed in deep mode: what a type checker is asked about."""
    return decided.where("outcome = 'deferred'").join(modes.where("mode = 'deep'").select("path"), "path", "left_semi")
