"""Queries about reports: merges, orders, retentions, explanations, plans; each with the same in SQL.

Every lineitem row is a finding, so merges and filters run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from taproot import sinks
from taproot.functions import scalars
from taproot.operators import dependencies, files, policy, reporting
from taproot.registry import query
from taproot.registry import table as _t

#: A finding a line: who, where, what; the same in any engine.
_ROWS = """select l_returnflag as profile, case l_linenumber % 4 when 0 then 'ORP1001' when 1 then 'ORP1002' when 2 then 'ORP2001' else 'ORP3001' end as issue_id,
 case l_linenumber % 4 when 0 then 'unusedFiles' when 1 then 'unusedExport' when 2 then 'unusedDependency' else 'unusedWorkspace' end as issue_type, concat('w', cast(l_suppkey % 9 as string)) as workspace, concat('src/p', cast(l_partkey as string), '.ts') as path,
 case when l_linenumber % 4 = 1 then l_suppkey end as start, case when l_linenumber % 4 = 1 then concat('s', cast(l_suppkey % 5 as string)) end as symbol, case when l_linenumber % 4 = 2 then concat('pkg', cast(l_suppkey as string)) end as dependency,
 case when l_tax < 0.02 then 'low' when l_tax < 0.05 then 'medium' else 'high' end as confidence, concat('p', cast(l_partkey as string), ' is unused') as summary from {lineitem}"""
_IN_SQL = "f as (" + _ROWS.format(lineitem="lineitem") + ")"
_FIELDS = "issue_id, issue_type, workspace, path, start, symbol, dependency"


def _findings(spark, d):
    return spark.sql(_ROWS, lineitem=_t(spark, d, "lineitem")).withColumn("paths", F.array("path"))


@query(
    f"""with {_IN_SQL} select {_FIELDS}, string_agg(distinct profile, ',' order by profile) as target_profiles, substr(min(concat(case profile when 'R' then '1' when 'A' then '2' else '3' end, confidence)), 2) as confidence from f group by {_FIELDS}"""
)
def finding_identity_merge(spark, d):
    """Alike in all seven fields: one finding, other fields from the earliest profile in order R, A, N."""
    merged = reporting.merged_findings(_findings(spark, d).drop("path"), {"R": 1, "A": 2, "N": 3})
    return merged.withColumn("path", F.col("paths")[0]).select(*_FIELDS.split(", "), F.array_join("target_profiles", ",").alias("target_profiles"), "confidence")


@query(f"with {_IN_SQL} select coalesce(symbol, dependency, path) as item, workspace, string_agg(distinct profile, ',' order by profile) as target_profiles, string_agg(distinct concat('by ', confidence), ',' order by concat('by ', confidence)) as evidence from f group by 1, 2")
def retention_merge(spark, d):
    rows = _findings(spark, d).select("profile", reporting.display_item().alias("item"), F.lit("x").alias("item_type"), "workspace", F.lit("s").alias("summary"), F.array(F.concat(F.lit("by "), "confidence")).alias("evidence"))
    out = reporting.merged_retentions(rows)
    return out.select("item", "workspace", F.array_join("target_profiles", ",").alias("target_profiles"), F.array_join("evidence", ",").alias("evidence"))


_BLOCKING = "select concat('w', cast(p_size as string)) as workspace, case when p_retailprice < 950 then 'unresolved_import' else 'parse_failure' end as code from {part} where p_size in (3, 5) and p_type = 'SMALL'"


@query(
    f"""with {_IN_SQL}, b as ({_BLOCKING.format(part='part')}), c as (select workspace, string_agg(distinct concat('blocked by ', code), ',' order by concat('blocked by ', code)) as evidence from b group by workspace)
 select f.workspace, c.evidence, count(*) as n from f left join c on c.workspace = f.workspace group by 1, 2"""
)
def blocked_retentions(spark, d):
    kept, held = reporting.retentions_of_blocked(_findings(spark, d), spark.sql(_BLOCKING, part=_t(spark, d, "part")))
    rows = kept.select("workspace", F.lit(None).cast("string").alias("evidence")).union(held.select("workspace", F.array_join("evidence", ",")))
    return rows.groupBy("workspace", "evidence").agg(F.count("*").alias("n"))


@query(f"with {_IN_SQL} select workspace, 'blocked by root_gap' as evidence, count(*) as n from f group by 1")
def root_blocked_retentions(spark, d):
    """A blocking diagnostic of the root workspace blocks every finding."""
    root = spark.createDataFrame([(".", "root_gap")], "workspace string, code string")
    kept, held = reporting.retentions_of_blocked(_findings(spark, d), root)
    rows = kept.select("workspace", F.lit("kept").alias("evidence")).union(held.select("workspace", F.array_join("evidence", ",")))
    return rows.groupBy("workspace", "evidence").agg(F.count("*").alias("n"))


@query(f"with {_IN_SQL}, g as (select distinct {_FIELDS} from f) select {_FIELDS}, row_number() over (order by workspace, path, coalesce(start, 4294967295), issue_id, symbol nulls first, dependency nulls first) - 1 as place from g")
def finding_order(spark, d):
    key = _FIELDS.split(", ")
    rows = _findings(spark, d).select(*key, "paths").distinct()
    return reporting.ranks(rows, reporting.ordered_findings(rows), key)


@query("with g as (select distinct concat('src/p', cast(l_partkey as string), '.ts') as path, case when l_linenumber > 3 then l_suppkey end as start, l_returnflag as code, l_linestatus as message from lineitem) select path, start, code, message, row_number() over (order by path, coalesce(start, 4294967295), code, message) - 1 as place from g")
def diagnostic_order(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("concat('src/p', cast(l_partkey as string), '.ts') as path", "case when l_linenumber > 3 then l_suppkey end as start", "l_returnflag as code", "l_linestatus as message")
    return reporting.ranks(rows, reporting.ordered_diagnostics(rows), ["path", "start", "code", "message"])


@query(f"with {_IN_SQL} select case when count(distinct confidence) > 1 then 'mixed' else coalesce(min(confidence), 'balanced') end as mode from f")
def project_mode(spark, d):
    return reporting.mode_name(_findings(spark, d).select(F.col("confidence").alias("mode")))


@query(f"with {_IN_SQL} select profile, case when bool_or(confidence = 'high' and profile = 'N') then 'incomplete' else 'complete' end as coverage from f group by profile")
def profile_completeness(spark, d):
    return reporting.completeness(_findings(spark, d).select("profile", ((F.col("confidence") == "high") & (F.col("profile") == "N")).alias("blocks")))


@query(f"with {_IN_SQL} select workspace, count(*) as findings, count(*) filter (where case confidence when 'high' then 3 when 'medium' then 2 else 1 end >= case workspace when 'w1' then 1 when 'w2' then 2 else 3 end) as failing from f group by workspace")
def failure_thresholds(spark, d):
    thresholds = spark.createDataFrame([("w1", "low"), ("w2", "medium")], "workspace string, threshold string")
    return reporting.failures(_findings(spark, d), thresholds)


@query(f"with {_IN_SQL} select case when issue_id = 'ORP1001' then 'incomplete' when issue_id = 'ORP3001' then 'low' else 'high' end as kind, case when issue_id = 'ORP1001' then 2 when issue_id = 'ORP3001' then 0 else 1 end as code from f group by 1, 2")
def exit_codes(spark, d):
    """Incomplete coverage 2, a finding at its threshold 1, else 0."""
    rows = _findings(spark, d)
    none = rows.limit(0).select("workspace")
    cases = {"incomplete": (rows.where("issue_id = 'ORP1001'"), rows.select("workspace")), "low": (rows.where("issue_id = 'ORP3001'").withColumn("confidence", F.lit("low")), none), "high": (rows.where("issue_id in ('ORP1002', 'ORP2001')").withColumn("confidence", F.lit("high")), none)}
    blank = spark.createDataFrame([], "workspace string, threshold string")
    return spark.createDataFrame([(k, policy.exit_code(f, blank, b)) for k, (f, b) in cases.items()], "kind string, code int")


@query("select count(*) as files, sum(strlen(coalesce(text, ''))) as bytes, sum(case when coalesce(text, '') = '' then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end) as lines, (select count(*) from labels where toxic = 1) as cache_hits, (select count(*) from labels where toxic = 0) as cache_misses from documents")
def scan_metrics(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    out = reporting.metrics(docs, _t(spark, d, "labels").select(F.col("doc_id").alias("path"), (F.col("toxic") == 1).alias("hit")))
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


_IMPORTS = "select l_returnflag as profile, concat('src/p', cast(l_partkey as string), '.ts') as path, concat('./s', cast(l_suppkey as string)) as specifier, 'static' as kind, 'esm' as mode, 'module' as activation, l_linestatus = 'O' as type_only, 'resolved' as status, cast(null as string) as target, l_linenumber as start from {lineitem}"


@query(f"with i as ({_IMPORTS.format(lineitem='lineitem')}) select path, specifier, type_only, start, string_agg(distinct profile, ',' order by profile) as target_profiles from i group by path, specifier, type_only, start")
def import_merge(spark, d):
    merged = reporting.merged_imports(spark.sql(_IMPORTS, lineitem=_t(spark, d, "lineitem")))
    return merged.select("path", "specifier", "type_only", "start", F.array_join("target_profiles", ",").alias("target_profiles"))


_OUTCOMES = "o as (select distinct concat('w', cast(l_suppkey % 9 as string)) as workspace, concat('pkg', cast(l_partkey as string)) as package, case l_linenumber when 1 then 'unused' when 2 then 'unreferenced_peer' when 3 then 'unreferenced_optional' when 4 then 'unlisted' when 5 then 'misplaced' when 6 then 'retained' else 'undetermined' end as kind, case when l_linenumber in (2, 3) then 'medium' when l_linenumber in (1, 4, 5) then 'high' else 'not_applicable' end as confidence from {})"


@query(
    f"""with {_OUTCOMES.format('lineitem')} select case when kind in ('unlisted', 'misplaced') then 'ORP2002' else 'ORP2001' end as issue_id, workspace, concat(workspace, '/package.json') as path, package as dependency, confidence,
 case kind when 'unused' then concat('dependency ', package, ' has no reachable evidence') when 'unreferenced_peer' then concat('peer dependency ', package, ' has no reachable contract evidence') when 'unreferenced_optional' then concat('optional dependency ', package, ' has no reachable conditional evidence') else concat(package, ' is used without a declaration in its workspace') end as summary,
 case when kind = 'unused' then 'eligible' when confidence = 'high' then 'preview_only' else 'blocked' end as fix_eligibility from o where kind not in ('retained', 'undetermined')"""
)
def dependency_findings(spark, d):
    rows = spark.sql("with " + _OUTCOMES.format("{lineitem}") + " select * from o", lineitem=_t(spark, d, "lineitem"))
    return reporting.dependency_findings(rows).drop("issue_type")


@query(f"with {_OUTCOMES.format('lineitem')} select workspace, package, kind, row_number() over (order by workspace, package, kind) - 1 as place from o")
def dependency_order(spark, d):
    rows = spark.sql("with " + _OUTCOMES.format("{lineitem}") + " select * from o", lineitem=_t(spark, d, "lineitem"))
    return reporting.ranks(rows, reporting.ordered_dependencies(rows), ["workspace", "package", "kind"])


@query(
    """with x as (select distinct concat('w', cast(l_suppkey as string)) as w, l_returnflag as r, l_linenumber as n from lineitem)
 select concat(w, '/package.json') as path, 'unmodeled_package_script' as code, concat('scripts.', r, ' contains an unmodeled ', case when n < 3 then 'glob_expansion' else 'unknown_command' end, ' span at bytes ', cast(n as string), '..', cast(n + 4 as string)) as message, n < 3 as blocks from x
 union select concat(w, '/package.json'), 'missing_package_script', concat('scripts.', r, ' invokes missing script s', cast(n as string)), false from x where n > 5"""
)
def script_diagnostics(spark, d):
    x = _t(spark, d, "lineitem").selectExpr("concat('w', l_suppkey) as workspace", "l_returnflag as script", "l_linenumber as start", "case when l_linenumber < 3 then 'glob_expansion' else 'unknown_command' end as kind").distinct()
    missing = x.where("start > 5").selectExpr("workspace", "script as caller", "concat('s', start) as callee")
    return reporting.script_diagnostics(x.withColumn("end", F.col("start") + 4), missing)


@query("select distinct concat('w', cast(p_size as string), '/package.json') as path, 'stale_retain_rule' as code, concat('retain rule `', p_brand, '` matches no file') as message, false as blocks from part where p_size < 10 union select distinct concat('w', cast(p_size as string), '/package.json'), 'stale_ignore_rule', concat('ignore rule `', p_brand, '` matches no file'), false from part where p_size > 40")
def stale_rule_diagnostics(spark, d):
    rules = _t(spark, d, "part").selectExpr("concat('w', p_size) as workspace", "p_brand as rule", "p_size").distinct()
    return reporting.stale_diagnostics(rules.where("p_size < 10"), rules.where("p_size > 40"))


_ASKED = "select concat('src/p', cast(p_partkey as string), '.ts') as q from {0} union select concat('pkg', cast(p_partkey as string)) from {0} union select concat('s', cast(p_size as string)) from {0}"


@query(
    f"""with {_IN_SQL}, asked as ({_ASKED.format('part')}),
 a as (select concat('src/p', cast(p_partkey as string), '.ts') as q, 1 as k, '' as x, '' as y, 'retained' as status, 'kept by rule' as summary from part where p_partkey % 10 = 0
 union all select n, 2, workspace, path, 'reported', summary from f, lateral (select unnest([path, symbol, dependency, workspace]) as n) u where n is not null and l7
 union all select concat('src/p', cast(p_partkey as string), '.ts'), 3, '', '', case p_partkey % 3 when 0 then 'retained' when 1 then 'incomplete' else 'reported' end, case p_partkey % 3 when 0 then concat('src/p', cast(p_partkey as string), '.ts is reachable from a configured entry') when 1 then concat('Analysis cannot decide whether src/p', cast(p_partkey as string), '.ts is reachable') else concat('src/p', cast(p_partkey as string), '.ts has no path from a configured entry') end from part
 union all select concat('pkg', cast(p_partkey as string)), 4, '', '', 'retained', concat('pkg', cast(p_partkey as string), ' is retained by a reachable external import') from part where p_partkey % 6 = 0),
 best as (select q, status, summary, row_number() over (partition by q order by k, x, y, summary) as r from a)
 select asked.q as query, coalesce(status, 'not_found') as status, coalesce(summary, concat('No analyzed file, finding, or retained package matches `', asked.q, '`')) as summary from asked left join (select * from best where r = 1) b on b.q = asked.q""".replace(" and l7", " and issue_id <> 'ORP3001'")
)
def explanations(spark, d):
    """Retention, finding, file, package or nothing: the first that answers each question."""
    part = _t(spark, d, "part")
    path = "concat('src/p', cast(p_partkey as string), '.ts')"
    kept = part.where("p_partkey % 10 = 0").selectExpr(f"{path} as item", "'' as workspace", "'kept by rule' as summary")
    status = part.selectExpr(f"{path} as path", "case p_partkey % 3 when 0 then 'reachable' when 1 then 'incomplete' else 'unreachable' end as status")
    imports = part.where("p_partkey % 2 = 0").selectExpr(f"{path} as path", "concat('pkg', p_partkey, '/x') as specifier", "'external' as status")
    asked = spark.sql(_ASKED.format("{part}"), part=part).withColumnRenamed("q", "query")
    return reporting.explained(asked, kept, _findings(spark, d).where("issue_id <> 'ORP3001'"), status, imports)


_PLANNED = "select distinct workspace, issue_type, path, dependency, case when confidence = 'high' then 'eligible' when confidence = 'medium' then 'preview_only' else 'blocked' end as fix_eligibility from f where issue_type in ('unusedDependency', 'unusedFiles')"
_REQUESTS = "select concat('src/p', cast(p_partkey as string), '.ts') as request from {0} union select concat('pkg', cast(p_size as string)) from {0} union select concat('w', cast(p_size % 9 as string), ':pkg', cast(p_size as string)) from {0}"


@query(
    f"""with {_IN_SQL}, g as ({_PLANNED}), deps as (select distinct workspace, dependency as target from g where issue_type = 'unusedDependency' and fix_eligibility <> 'blocked'),
 rows as (select target as request, 'remove_dependency' as action, workspace, target from deps union select concat(workspace, ':', target), 'remove_dependency', workspace, target from deps union select distinct path, 'delete_file', workspace, path from g where issue_type = 'unusedFiles' and fix_eligibility = 'eligible'),
 many as (select request, count(*) as n from rows group by request), dig as (select concat('src/p', cast(p_partkey as string), '.ts') as path, concat('d', cast(p_partkey as string)) as digest from part where p_partkey % 3 > 0)
 select q.request, r.action, r.workspace, r.target, dig.digest, case when n is null then 'not_eligible' when n > 1 then 'ambiguous' when r.action = 'delete_file' and dig.digest is null then 'not_analyzed' end as refused
 from ({_REQUESTS.format('part')}) q left join many on many.request = q.request left join rows r on r.request = q.request left join dig on dig.path = r.target"""
)
def fix_plan(spark, d):
    part = _t(spark, d, "part")
    found = spark.sql("with f as (" + _ROWS + ") " + _PLANNED, lineitem=_t(spark, d, "lineitem")).withColumn("paths", F.array("path"))
    digests = part.where("p_partkey % 3 > 0").selectExpr("concat('src/p', cast(p_partkey as string), '.ts') as path", "concat('d', cast(p_partkey as string)) as digest")
    return reporting.fix_plan(found, spark.sql(_REQUESTS.format("{part}"), part=part), digests, "npm", True)


@query(
    """with e as (select distinct l_orderkey as o, l_partkey as p, l_suppkey as s from lineitem), k as (select o, p, s, case when s % 5 = 0 then 'unavailable' else 'resolved' end as deep, p % 2 = 0 as ref, (s % 3 = 0 or (s % 3 = 1 and s % 2 = 0) or (s % 3 = 2 and s % 7 < 3)) as ov from e)
 select concat('src/p', cast(p as string), '.ts') as path, o * 1000 + s as position, deep, deep = 'resolved' and ref as receiver_may_reference, deep = 'resolved' and ov as live_override_contract from k"""
)
def deep_evidence(spark, d):
    """Answers of a type checker, kept where the files that they name are reachable."""
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey as o", "l_partkey as p", "l_suppkey as s").distinct()
    bases = "array(named_struct('owner', concat('w', s % 7), 'exported', s % 3 = 2, 'references', case when s % 3 = 0 then cast(array() as array<string>) when s % 3 = 1 then array(concat('f', s % 2)) else array('f1') end))"
    evidence = rows.selectExpr("concat('src/p', cast(p as string), '.ts') as path", "o * 1000 + s as position", "case when s % 5 = 0 then 'unavailable' else 'resolved' end as status", "array(concat('f', p % 2), 'f9') as references", f"{bases} as overrides")
    status = spark.createDataFrame([("f0", "reachable"), ("f1", "unreachable")], "path string, status string")
    return reporting.deep_liveness(evidence, status, spark.createDataFrame([("w0",), ("w1",), ("w2",)], "owner string"))


@query("select distinct concat('C', cast(l_partkey as string)) as class, concat('m', cast(l_linenumber as string)) as name from lineitem where l_partkey % 3 = 0")
def deep_candidates(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("concat('C', cast(l_partkey as string)) as class", "concat('m', cast(l_linenumber as string)) as name", "concat('src/p', cast(l_partkey as string), '.ts') as path", "'deferred' as outcome").distinct()
    modes = _t(spark, d, "part").selectExpr("concat('src/p', cast(p_partkey as string), '.ts') as path", "case when p_partkey % 3 = 0 then 'deep' else 'balanced' end as mode")
    return reporting.deep_candidates(rows, modes).select("class", "name")


@query(
    f"""with {_IN_SQL}, g as (select distinct issue_id, summary, start, path from f where issue_id = 'ORP1002'), n as (select distinct l_returnflag as code, concat('a b/', cast(l_suppkey as string)) as path, l_linestatus as message from lineitem),
 r as (select issue_id as rule, 'warning' as level, path as uri, start, summary as message from g union select code, 'error', replace(path, ' ', '%20'), null, message from n)
 select concat('{{"ruleId":"', rule, '","level":"', level, '","message":{{"text":"', message, '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"', uri, '"}}', case when start is null then '' else concat(',"region":{{"byteOffset":', cast(start as string), '}}') end, '}}}}]}}') as json from r"""
)
def sarif_report(spark, d):
    found = _findings(spark, d).where("issue_id = 'ORP1002'").select("issue_id", "summary", "start", "paths").distinct()
    notes = _t(spark, d, "lineitem").selectExpr("l_returnflag as code", "true as blocks", "concat('a b/', cast(l_suppkey as string)) as path", "cast(null as bigint) as start", "l_linestatus as message").distinct()
    return sinks.sarif_document(found, notes)


@query("with x as (select doc_id, text, length(text) as n from documents where text is not null and text <> '' and regexp_matches(text, '^[\\x00-\\x7F]*$')) select concat('d', cast(doc_id as string), ':', cast(length(substr(text, 1, cast(n // 2 as int))) - length(replace(substr(text, 1, cast(n // 2 as int)), chr(10), '')) + 1 as string), ':', cast(length(regexp_extract(substr(text, 1, cast(n // 2 as int)), '[^\\n]*$')) + 1 as string), ' - ORP1002 ''x'' is unused') as line from x")
def placed_lines(spark, d):
    docs = _t(spark, d, "documents").where("text is not null and text <> ''").where(F.col("text").rlike("^[\\x00-\\x7F]*$")).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    found = docs.select(F.lit("ORP1002").alias("issue_id"), F.lit("x").alias("name"), F.floor(F.length("text") / 2).alias("start"), F.array("path").alias("paths"))
    return sinks.placed_lines(found, docs)


@query(f"with {_IN_SQL} select distinct concat('* ', issue_id, '  ', summary, ' (', path, ')') as line from f")
def human_lines(spark, d):
    return sinks.human_lines(_findings(spark, d), ascii_only=True).distinct()


@query("select p_partkey, case when p_partkey % 3 = 0 then concat('@s/real', cast(p_size as string)) when p_partkey % 3 = 1 then concat('real', cast(p_size as string)) end as target from part")
def alias_targets(spark, d):
    text = "case p_partkey % 3 when 0 then concat('npm:@s/real', p_size, '@^2') when 1 then concat('npm:real', p_size) else '^1.0' end"
    return _t(spark, d, "part").selectExpr("p_partkey", f"{text} as r").select("p_partkey", scalars.npm_alias_target(F.col("r")).alias("target"))


@query("select p_partkey, case when p_partkey % 2 = 0 then concat('d', cast(p_size as string), '/') end as scope from part")
def escape_scopes(spark, d):
    text = "case p_partkey % 2 when 0 then concat('./d', p_size, '/x') else concat('./x', p_size) end"
    return _t(spark, d, "part").selectExpr("p_partkey", f"{text} as p").select("p_partkey", scalars.escape_scope(F.col("p")).alias("scope"))


@query("select p_partkey, concat('src/', case when p_partkey % 4 = 0 then 'a/' else '' end, cast(p_partkey as string)) as held from part where p_partkey % 3 <> 2")
def wildcard_captures(spark, d):
    text = "concat(case p_partkey % 3 when 2 then 'lib/' else 'pkg/' end, 'src/', case when p_partkey % 4 = 0 then 'a/' else '' end, p_partkey, '.js')"
    return _t(spark, d, "part").selectExpr("p_partkey", f"{text} as v").select("p_partkey", scalars.wildcard_capture("pkg/*.js", F.col("v")).alias("held")).where("held is not null")


@query("with d as (select doc_id, l.n from documents, lateral (select unnest(['x' || chr(7) || 'y', 'a' || chr(8238) || 'b', 'plain']) as n) l) select doc_id, replace(replace(n, chr(7), chr(65533)), chr(8238), chr(65533)) as clean from d")
def sanitized_text(spark, d):
    raw = F.explode(F.array(F.concat(F.lit("x"), F.char(F.lit(7)), F.lit("y")), F.lit("a‮b"), F.lit("plain")))
    return _t(spark, d, "documents").select("doc_id", raw.alias("n")).select("doc_id", scalars.sanitized(F.col("n")).alias("clean"))


@query("with x as (select distinct l_partkey as p, l_suppkey as s, l_linenumber as n from lineitem) select p, min(n) as n, (array_agg(s order by n, s))[1] as s from x group by p")
def first_of_each(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_partkey as p", "l_suppkey as s", "l_linenumber as n").distinct()
    return files.discovery_rank(rows, ["p"], ["n", "s"])


_BINS = "u as (select distinct p_type as workspace, concat('bin', cast(p_size as string)) as \"binary\" from part), o as (select concat('bin', cast(p_size as string)) as \"binary\", min(p_brand) as owner from part where p_size < 40 group by p_size)"


@query(f"with {_BINS} select u.workspace, u.\"binary\", o.owner, o.owner is null as blocks from u left join o on o.\"binary\" = u.\"binary\"")
def binary_evidence(spark, d):
    """Binaries that scripts use: the package that owns each, or a blocker for those that none does."""
    part = _t(spark, d, "part")
    used = part.selectExpr("p_type as workspace", "concat('bin', cast(p_size as string)) as binary", "'script' as kind", "cast(null as string) as package").distinct()
    owners = part.where("p_size < 40").groupBy(F.expr("concat('bin', cast(p_size as string))").alias("binary")).agg(F.min("p_brand").alias("owner"))
    _, lost = dependencies.with_binaries(used, owners)
    held = used.join(owners, "binary").select("workspace", "binary", "owner", F.lit(False).alias("blocks"))
    return held.union(lost.select("workspace", "binary", F.lit(None).cast("string"), F.lit(True)))


@query("with m as (select distinct concat('C', cast(l_partkey as string)) as class, concat('m', cast(l_linenumber as string)) as name, l_linestatus = 'O' as is_static from lineitem) select class, name, is_static, row_number() over (order by class, name, is_static) - 1 as place from m")
def member_order(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("concat('C', cast(l_partkey as string)) as class", "concat('m', cast(l_linenumber as string)) as name", "l_linestatus = 'O' as is_static").distinct()
    return reporting.ranks(rows, reporting.ordered_members(rows), ["class", "name", "is_static"])


@query("with i as (select distinct case l_linenumber when 1 then 'ORP1001' when 2 then 'ORP2001' when 3 then 'ORP3001' else 'ORP9999' end as issue_id from lineitem) select issue_id, case issue_id when 'ORP1001' then 'A source file has no path from any configured entry' when 'ORP2001' then 'A declared dependency has no evidence of use' when 'ORP3001' then 'A workspace package has no evidence of use' end as about from i")
def issue_descriptions(spark, d):
    ids = _t(spark, d, "lineitem").selectExpr("case l_linenumber when 1 then 'ORP1001' when 2 then 'ORP2001' when 3 then 'ORP3001' else 'ORP9999' end as issue_id").distinct()
    return ids.select("issue_id", reporting.described(F.col("issue_id")).alias("about"))
