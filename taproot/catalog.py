"""Named queries over the given tables, and the same in SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from taproot import sinks
from taproot.functions import globs, scalars
from taproot.operators import dependencies, files, graph, members, policy, symbols, workspaces
from taproot.registry import query
from taproot.registry import table as _t
from taproot.sources.stars import facts, in_sql

_REACH = f"""{in_sql("files", "profiles", "entries", "edges", "blockers")},
 reach as (select profile, path from entries union select e.profile, e.dst from reach r join edges e on e.profile = r.profile and e.src = r.path)"""
_STATUS = f"""{_REACH}, stopped as (select distinct b.profile from blockers b join reach r on r.profile = b.profile and r.path = b.path),
 status as (select p.profile, f.path, f.workspace, case when f.fatal then 'incomplete' when r.path is not null then 'reachable' when s.profile is not null then 'incomplete' else 'unreachable' end as status
 from profiles p cross join files f left join reach r on r.profile = p.profile and r.path = f.path left join stopped s on s.profile = p.profile)"""


def _status(spark, d):
    return files.file_status(*(facts(spark, d, n) for n in ("files", "entries", "edges", "blockers", "profiles")))


@query(f"with recursive {_STATUS} select profile, path, status from status")
def file_reachability(spark, d):
    return _status(spark, d).select("profile", "path", "status")


@query(
    f"""with recursive {_STATUS}, dead as (select profile, path from status where status = 'unreachable'),
 inner_edges as (select e.profile, e.src, e.dst from edges e join dead a on a.profile = e.profile and a.path = e.src join dead b on b.profile = e.profile and b.path = e.dst),
 ways as (select profile, src, dst from inner_edges union select w.profile, w.src, e.dst from ways w join inner_edges e on e.profile = w.profile and e.src = w.dst),
 mates as (select a.profile, a.src as path, a.dst as mate from ways a join ways b on a.profile = b.profile and a.src = b.dst and a.dst = b.src union select profile, path, path from dead),
 grouped as (select profile, path, min(mate) as component from mates group by profile, path)
 select profile, string_agg(path, ',' order by path) as paths, count(*) as n, case when count(*) > 1 then concat(cast(count(*) as string), ' files form an unreachable cycle') else concat(min(path), ' is unreachable') end as summary from grouped group by profile, component"""
)
def unused_files_scc(spark, d):
    found = files.unreachable_findings(_status(spark, d), facts(spark, d, "edges"))
    return found.select("profile", F.array_join("paths", ",").alias("paths"), "n", "summary")


@query(
    f"""with recursive {in_sql("files", "profiles", "edges")}, f as (select p.profile, files.path from profiles p cross join files),
 ways as (select profile, src, dst from edges union select w.profile, w.src, e.dst from ways w join edges e on e.profile = w.profile and e.src = w.dst),
 mates as (select a.profile, a.src as path, a.dst as mate from ways a join ways b on a.profile = b.profile and a.src = b.dst and a.dst = b.src union select profile, path, path from f),
 grouped as (select profile, path, min(mate) as component from mates group by profile, path),
 loops as (select profile, src as path from edges where src = dst)
 select g.profile, g.path, g.component, count(*) over (partition by g.profile, g.component) > 1 or l.path is not null as cyclic from grouped g left join loops l on l.profile = g.profile and l.path = g.path"""
)
def strong_components(spark, d):
    nodes = facts(spark, d, "profiles").join(facts(spark, d, "files").select("path"))
    return graph.strong_components(facts(spark, d, "edges"), nodes)


@query(f"with recursive {_STATUS} select profile, count(*) as files, count(*) filter (where status = 'reachable') as reachable_files, count(*) filter (where status = 'incomplete') as incomplete_files, count(*) filter (where status = 'unreachable') as unreachable_files from status group by profile")
def status_summary(spark, d):
    return files.status_summary(_status(spark, d))


@query(
    f"""with recursive {_STATUS} select path, case max(case status when 'reachable' then 3 when 'incomplete' then 2 else 1 end) when 3 then 'reachable' when 2 then 'incomplete' else 'unreachable' end as status,
 string_agg(concat(profile, '=', status), ',' order by profile) as target_statuses from status group by path"""
)
def profile_status_merge(spark, d):
    return files.merged_status(_status(spark, d))


_KEY = ("issue_id", "issue_type", "workspace", "path")


@query(f"with {in_sql('findings')} select issue_id, issue_type, workspace, path, string_agg(distinct profile, ',' order by profile) as target_profiles, substr(min(concat(profile, confidence)), 2) as confidence from findings group by issue_id, issue_type, workspace, path")
def finding_profile_union(spark, d):
    return files.merged_findings(facts(spark, d, "findings"), list(_KEY), ["confidence"])



_LIVE = f"""{in_sql("symbols", "links", "symbol_roots")}, known as (select path, symbol from symbols),
 live as (select path, symbol from symbol_roots union select l.dst_path, l.dst_symbol from live v join links l on l.src_path = v.path and l.src_symbol = v.symbol),
 given as (select l.dst_path as path, l.dst_symbol as symbol, l.usage from links l join live v on l.src_path = v.path and l.src_symbol = v.symbol union select path, symbol, usage from symbol_roots),
 lanes as (select path, symbol, bool_or(usage = 'runtime') as runtime, bool_or(usage = 'type') as type from given group by path, symbol),
 liveness as (select s.path, s.symbol, s.name, s.kind, s.exported, coalesce(l.runtime, false) as runtime, coalesce(l.type, false) as type from symbols s left join lanes l on l.path = s.path and l.symbol = s.symbol)"""


def _liveness(spark, d):
    return symbols.liveness(facts(spark, d, "symbols"), facts(spark, d, "links"), facts(spark, d, "symbol_roots"))


@query(f"with recursive {_LIVE} select path, symbol, runtime, type from liveness")
def symbol_liveness_lanes(spark, d):
    return _liveness(spark, d).select("path", "symbol", "runtime", "type")


@query(
    f"""with recursive {_LIVE}, dead as (select * from liveness where not runtime and not type),
 e as (select distinct l.src_path, l.src_symbol, l.dst_path, l.dst_symbol from links l join dead a on a.path = l.src_path and a.symbol = l.src_symbol join dead b on b.path = l.dst_path and b.symbol = l.dst_symbol),
 ways as (select src_path, src_symbol, dst_path, dst_symbol from e union select w.src_path, w.src_symbol, e.dst_path, e.dst_symbol from ways w join e on e.src_path = w.dst_path and e.src_symbol = w.dst_symbol),
 mates as (select a.src_path as path, a.src_symbol as symbol, concat(a.dst_path, '#', cast(a.dst_symbol as string)) as mate from ways a join ways b on a.src_path = b.dst_path and a.src_symbol = b.dst_symbol and a.dst_path = b.src_path and a.dst_symbol = b.src_symbol
  union select path, symbol, concat(path, '#', cast(symbol as string)) from dead),
 grouped as (select path, symbol, min(mate) as component, count(*) as n from mates group by path, symbol),
 self as (select src_path as path, src_symbol as symbol from e where src_path = dst_path and src_symbol = dst_symbol),
 named as (select g.component, d.path, d.symbol, d.name, g.n > 1 or s.path is not null as cyclic from grouped g join dead d on d.path = g.path and d.symbol = g.symbol left join self s on s.path = g.path and s.symbol = g.symbol where d.kind <> 'import'),
 p as (select component, string_agg(path, ',' order by path) as paths from (select distinct component, path from named) group by component)
 select string_agg(name, ', ' order by path, symbol) as symbols, count(*) as n, bool_or(cyclic) as cyclic, any_value(p.paths) as paths from named join p on p.component = named.component group by named.component"""
)
def dead_symbol_groups(spark, d):
    return symbols.dead_groups(_liveness(spark, d), facts(spark, d, "links"))


_EXPORTS = "exports as (select path, symbol as local, name as exported, case when kind = 'import' then 'type' else 'runtime' end as usage from symbols where exported)"
_STARS = "stars as (select distinct src, dst from edges where profile = 'R')"


def _exports(spark, d):
    return facts(spark, d, "symbols").where("exported").select("path", F.col("symbol").alias("local"), F.col("name").alias("exported"), F.when(F.col("kind") == "import", "type").otherwise("runtime").alias("usage"))


def _stars(spark, d):
    return facts(spark, d, "edges").where("profile = 'R'").select("src", "dst").distinct()


@query(f"with recursive {in_sql('symbols', 'edges')}, {_EXPORTS}, {_STARS}, ways as (select src, dst from stars union select w.src, s.dst from ways w join stars s on s.src = w.dst) select path, exported from exports union select w.src, e.exported from ways w join exports e on e.path = w.dst")
def exported_names_closure(spark, d):
    return symbols.exported_names(_exports(spark, d), _stars(spark, d))


@query(
    f"""with recursive {in_sql('symbols', 'edges', 'entries')}, {_EXPORTS}, {_STARS}, ways as (select src, dst from stars union select w.src, s.dst from ways w join stars s on s.src = w.dst),
 wanted as (select distinct n.path, e.path as place, e.exported, e.local, e.usage from (select distinct path from entries) n join (select src, dst from ways union select path, path from entries) w on w.src = n.path join exports e on e.path = w.dst)
 select path, exported, place as local_path, local, usage from wanted"""
)
def resolve_export_targets(spark, d):
    names = symbols.exported_names(_exports(spark, d), _stars(spark, d)).join(facts(spark, d, "entries").select("path").distinct(), "path")
    none = spark.createDataFrame([], "path string, exported string, dst string, imported string")
    return symbols.export_targets(names, _exports(spark, d), none, _stars(spark, d))


@query(
    f"""with recursive {_STATUS}, {in_sql('symbols', 'links')}, {_EXPORTS}, live as (select distinct path from status where status = 'reachable'), world as (select distinct path from entries where profile = 'A')
 select e.path, e.exported, e.usage from exports e join live on live.path = e.path where e.path not in (select path from world) and not exists (select 1 from links l where l.dst_path = e.path and l.dst_symbol = e.local and l.usage = e.usage)"""
)
def unused_exports(spark, d):
    live = _status(spark, d).where("status = 'reachable'").select("path").distinct()
    world = facts(spark, d, "entries").where("profile = 'A'").select("path").distinct()
    return symbols.unused_exports(_exports(spark, d), facts(spark, d, "links"), live, world).select("path", "exported", "usage")


def _member_sql(mode: str) -> str:
    hazard = "case when unknown_bracket_access then 'unknown_bracket_access' when reflected_or_enumerated then 'reflection_or_enumeration' when serialized then 'serialization' when object_spread then 'object_spread' when proxied then 'proxy' when passed_to_unknown_code then 'unknown_external_call' end"
    shared = "case when directly_referenced then 'direct_reference' when framework_root then 'framework_contract' when implements_external_contract then 'external_interface_contract' when overrides_live_base_member then 'live_base_contract' when has_live_override then 'live_override' when decorated then 'decorator_contract' when emitted_decorator_metadata then 'emitted_decorator_metadata' end"
    deep = "when o.ro and o.deep = 'resolved' and o.receiver_may_reference then 'deep_receiver_reference' when o.oo and o.deep = 'resolved' and o.live_override_contract then 'deep_live_override_contract'" if mode == "deep" else ""
    late = {"fast": "'mode_does_not_analyze_visibility'", "balanced": "case when ro then 'receiver_targets_ambiguous' when oo then 'override_relationships_incomplete' end", "deep": "case when (ro or oo) and deep = 'not_requested' then 'deep_evidence_missing' when (ro or oo) and deep = 'unavailable' then 'deep_worker_unavailable' end"}[mode]
    ts = late if mode == "fast" else "cast(null as string)"
    visible = "cast(null as string)" if mode == "fast" else f"coalesce(case when o.open_world and o.class_exported then 'open_world_public_surface' when o.class_escaped then 'escaped_public_surface' end, {hazard}{', case ' + deep + ' end' if deep else ''})"
    private = "cast(null as string)" if mode == "fast" else f"coalesce(case when (o.open_world and o.class_exported) or o.class_escaped then 'escaped_typescript_private_surface' end, {hazard})"
    return f"""with {in_sql('members')}, o as (select *, not is_static and not receiver_targets_complete as ro, participates_in_inheritance and not relationships_complete as oo from members),
 k as (select o.*, coalesce({shared}, case when visibility = 'javascript_private' then null when visibility = 'typescript_private' then {private} else {visible} end) as kept, case when visibility = 'javascript_private' then null when visibility = 'typescript_private' then {ts} else {late} end as late from o)
 select class, name, position, visibility, case when kept is not null then 'retained' when late is not null then 'deferred' else 'finding' end as outcome, coalesce(kept, late) as reason from k"""


def _members(mode):
    def run(spark, d):
        return members.decided(facts(spark, d, "members"), mode).select("class", "name", "position", "visibility", "outcome", "reason")

    run.__name__ = f"member_decisions_{mode}"
    return query(_member_sql(mode))(run)


for _mode in ("fast", "balanced", "deep"):
    _members(_mode)


@query(
    f"""with {in_sql('members')}, o as (select *, not is_static and not receiver_targets_complete as ro, participates_in_inheritance and not relationships_complete as oo from members)
 select visibility, is_static, count(*) as n from o where not (directly_referenced or framework_root or implements_external_contract or overrides_live_base_member or has_live_override or decorated or emitted_decorator_metadata)
 and (visibility = 'javascript_private' or (not ((open_world and class_exported) or class_escaped) and not (unknown_bracket_access or reflected_or_enumerated or serialized or object_spread or proxied or passed_to_unknown_code) and (visibility = 'typescript_private' or not (ro or oo)))) group by visibility, is_static"""
)
def member_findings(spark, d):
    return members.decided(facts(spark, d, "members")).where("outcome = 'finding'").groupBy("visibility", "is_static").agg(F.count("*").alias("n"))


@query(
    f"""with {in_sql('declarations', 'evidence', 'dependency_blockers')}, d as (select workspace, package, string_agg(distinct category, ',' order by category) as categories from declarations group by workspace, package),
 v as (select workspace, package, string_agg(distinct kind, ',' order by kind) as kinds from evidence group by workspace, package),
 r as (select package, categories from d where workspace = 'PROMO'),
 j as (select coalesce(d.workspace, v.workspace) as workspace, coalesce(d.package, v.package) as package, d.package is not null as declared, d.categories, v.kinds, r.categories as root_categories from d full outer join v on v.workspace = d.workspace and v.package = d.package left join r on r.package = coalesce(d.package, v.package)),
 k as (select *, case when not declared then case when root_categories is not null and workspace <> 'PROMO' then 'misplaced' else 'unlisted' end when kinds is not null then 'retained'
  when exists (select 1 from dependency_blockers b where b.workspace = j.workspace and (b.package is null or b.package = j.package)) then 'undetermined'
  when categories like '%peer%' then 'unreferenced_peer' when categories like '%optional%' then 'unreferenced_optional' else 'unused' end as kind from j)
 select workspace, package, case when declared then workspace when kind = 'misplaced' then 'PROMO' end as declared_workspace, coalesce(case when declared then categories when kind = 'misplaced' then root_categories end, '') as categories, kind,
 case when kind in ('retained', 'undetermined') then 'not_applicable' when kind like 'unreferenced%' then 'medium' else 'high' end as confidence, coalesce(kinds, '') as evidence from k"""
)
def dependency_outcomes(spark, d):
    return dependencies.outcomes(facts(spark, d, "declarations"), facts(spark, d, "evidence"), facts(spark, d, "dependency_blockers"), "PROMO")


_BINARIES = "binaries as (select distinct p_type as workspace, concat('bin', cast(p_size as string)) as binary from part where p_retailprice > 1000), owners as (select distinct concat('bin', cast(p_size as string)) as binary, min(p_brand) as owner from part where p_size < 40 group by p_size)"


@query(f"with {_BINARIES} select b.workspace, o.owner as package, count(*) as binaries from binaries b join owners o on o.binary = b.binary group by b.workspace, o.owner")
def binary_owners(spark, d):
    part = _t(spark, d, "part")
    binary = F.concat(F.lit("bin"), F.col("p_size").cast("string")).alias("binary")
    used = part.where("p_retailprice > 1000").select(F.col("p_type").alias("workspace"), binary, F.lit("script").alias("kind"), F.lit(None).cast("string").alias("package")).distinct()
    owners = part.where("p_size < 40").groupBy(binary).agg(F.min("p_brand").alias("owner"))
    return used.join(owners, "binary").groupBy("workspace", F.col("owner").alias("package")).agg(F.count("*").alias("binaries"))


@query(f'with {_BINARIES} select b.workspace, b."binary" from binaries b where b."binary" not in (select "binary" from owners)')
def unmapped_binaries(spark, d):
    part = _t(spark, d, "part")
    binary = F.concat(F.lit("bin"), F.col("p_size").cast("string")).alias("binary")
    used = part.where("p_retailprice > 1000").select(F.col("p_type").alias("workspace"), binary, F.lit("script").alias("kind"), F.lit(None).cast("string").alias("package")).distinct()
    owners = part.where("p_size < 40").groupBy(binary).agg(F.min("p_brand").alias("owner"))
    return dependencies.with_binaries(used, owners)[1]


_SPECIFIERS = "spec as (select unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as s from pages union all select url from pages)"
_BUILTINS = ", ".join(f"'{b}'" for b in scalars.NODE_BUILTINS)


def _specifiers(spark, d):
    pages = _t(spark, d, "pages")
    hrefs = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("s"))
    urls = pages.select(F.col("url").alias("s"))
    events = _t(spark, d, "events").select(F.concat(F.lit("npm:@scope/"), "event_type", F.lit("@"), F.col("event_id").cast("string")).alias("s"))
    words = _t(spark, d, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("s"))
    return hrefs.union(urls).union(events).union(words)


@query(
    f"""with s as (select unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as s from pages union all select url from pages union all select concat('npm:@scope/', event_type, '@', cast(event_id as string)) from events union all select unnest(regexp_split_to_array(text, '[ \n]+')) from documents),
 t as (select trim(s, ' ') as s from s), b as (select case when s like 'npm:%' then regexp_extract(regexp_replace(s, '^(?:npm: *)+', ''), '(?s)^(@[^/]*/[^@]*|[^@]*)', 1) else s end as s from t),
 n as (select case when s = '' or regexp_matches(s, '^[./#]') or s like 'node:%' or contains(s, '\\') or contains(s, '://') then '' else regexp_extract(s, '(?s)^(@[^/@:?#]+/[^/@:?#]+|[^/@:?#]+)(?:/.*)?$', 1) end as name from b)
 select case when name = '' or name in ({_BUILTINS}) then null else name end as package, count(*) as n from n group by 1"""
)
def package_names(spark, d):
    return _specifiers(spark, d).groupBy(scalars.package_name(F.col("s")).alias("package")).agg(F.count("*").alias("n"))


@query("select url, regexp_replace(regexp_extract(url, '(?s)([^/\\\\]*)$', 1), '\\.(?:cmd|exe)$', '') as name from pages")
def binary_names(spark, d):
    return _t(spark, d, "pages").select("url", scalars.binary_name(F.col("url")).alias("name"))


@query("select p_partkey, concat('src/q/p', cast(p_partkey as string)) as a, concat('lib/', replace(p_name, ' ', '/'), '/y/x.js') as b, concat('src/p', cast(p_partkey as string)) as c, concat('../lib/', replace(p_name, ' ', '/'), '/x.js') as d from part")
def path_normalise(spark, d):
    raw = F.concat(F.lit("./src//q/../p"), F.col("p_partkey").cast("string"), F.lit("/."))
    other = F.concat(F.lit("../lib/./"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/y/../x.js"))
    return _t(spark, d, "part").select("p_partkey", scalars.normal_path(raw).alias("a"), scalars.normal_path(other).alias("b"), scalars.popped_path(raw).alias("c"), scalars.popped_path(other).alias("d"))


@query("select p_partkey, v.variant from part, (select unnest(['', '.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx', '.mts', '.cts', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs', '/index.ts', '/index.tsx', '/index.mts', '/index.cts']) as e) x, lateral (select concat('src/p', cast(p_partkey as string), x.e) as variant) v")
def source_variants(spark, d):
    path = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"))
    return _t(spark, d, "part").select("p_partkey", F.explode(scalars.source_variants(path)).alias("variant"))


_KINDS = "k as (select p_partkey, concat('src/p', cast(p_partkey as string), '.', case p_type when 'STANDARD' then 'ts' when 'ECONOMY' then 'mts' when 'MEDIUM' then 'cjs' when 'LARGE' then 'tsx' when 'PROMO' then 'jsx' else 'js' end) as path from part)"


@query(f"with {_KINDS} select path, case when path like '%.ts' or path like '%.mts' then 'typescript' when path like '%.tsx' then 'tsx' when path like '%.jsx' then 'jsx' else 'javascript' end as source_kind, case when path like '%.cjs' then 'common_js' else 'module' end as module_kind, regexp_replace(path, '[a-z]+$', case when path like '%.mts' then 'mjs' when path like '%.cjs' then 'cjs' else 'js' end) as output from k")
def source_kinds(spark, d):
    ext = F.expr("case p_type when 'STANDARD' then 'ts' when 'ECONOMY' then 'mts' when 'MEDIUM' then 'cjs' when 'LARGE' then 'tsx' when 'PROMO' then 'jsx' else 'js' end")
    path = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit("."), ext)
    return _t(spark, d, "part").select(path.alias("path")).select("path", scalars.source_kind(F.col("path")).alias("source_kind"), scalars.module_kind(F.col("path")).alias("module_kind"), scalars.runtime_output(F.col("path")).alias("output"))


@query("select doc_id, cast(length(text) - length(replace(text, chr(10), '')) + 1 as bigint) as lines, cast(strlen(text) as bigint) as bytes, sha256(text) as digest from documents where text <> '' union all select doc_id, 0, 0, sha256('') from documents where text = ''")
def content_digest(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", scalars.line_count(t).cast("long").alias("lines"), scalars.byte_length(t).cast("long").alias("bytes"), scalars.content_digest(t).alias("digest"))


@query("select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_$]+'), lambda x: x = 'the')) as bigint) as n from documents")
def token_occurrences(spark, d):
    return _t(spark, d, "documents").select("doc_id", scalars.token_occurrences(F.col("text"), "the").cast("long").alias("n"))


_ROOTS = "roots as (select distinct regexp_extract(url, '^([a-z]+://[^/]*/[^/?#]*)/', 1) as root from pages where regexp_matches(url, '^[a-z]+://[^/]*/[^/?#]*/'))"


@query(f"with {_ROOTS}, paths as (select distinct url as path from pages), hits as (select path, root, length(root) as n from paths join roots on starts_with(path, concat(root, '/')) or path = root) select p.path, h.root as owner from paths p left join (select path, root from (select *, row_number() over (partition by path order by n desc) as r from hits) where r = 1) h on h.path = p.path")
def nearest_package(spark, d):
    pages = _t(spark, d, "pages")
    roots = pages.where(F.col("url").rlike("^[a-z]+://[^/]*/[^/?#]*/")).select(F.regexp_extract("url", "^([a-z]+://[^/]*/[^/?#]*)/", 1).alias("root")).distinct()
    return workspaces.nearest(pages.select(F.col("url").alias("path")).distinct(), roots)


@query(
    f"""with {in_sql('edges', 'files')}, imports as (select distinct src as path, case when dst < src then concat('./', substr(dst, 5, length(dst) - 7)) else substr(dst, 5) end as specifier, profile = 'N' as deferred from edges),
 i as (select path, specifier, bool_or(deferred) as deferred from imports group by path, specifier), c as (select path, specifier, deferred, concat('src/', substr(specifier, 3), '.ts') as candidate from i)
 select c.path, c.specifier, case when c.deferred then 'deferred' when specifier like './%' and f.path is not null then 'resolved' when specifier like './%' then 'unresolved' else 'external' end as status, case when not c.deferred and specifier like './%' then f.path end as target from c left join files f on f.path = c.candidate"""
)
def import_resolution(spark, d):
    edges = facts(spark, d, "edges")
    imports = edges.select(F.col("src").alias("path"), F.expr("case when dst < src then concat('./', substr(dst, 5, length(dst) - 7)) else substr(dst, 5) end").alias("specifier"), (F.col("profile") == "N").alias("deferred")).groupBy("path", "specifier").agg(F.bool_or("deferred").alias("deferred"))
    relative = imports.where(scalars.relative_specifier(F.col("specifier")))
    places = relative.select("path", "specifier", F.posexplode(scalars.source_variants(scalars.popped_path(F.concat(F.lit("src/"), "specifier")))).alias("rank", "candidate"))
    return workspaces.resolved(imports, places, facts(spark, d, "files"))


_PATTERNS = ["src/p1*", "*9.ts", "!src/p19*", "src/p2?.ts", "docs/", "/src/p77.ts"]
_RULES = "rules(rule, regex) as (values " + ", ".join(f"('{p}', '{globs.glob_regex(p.removeprefix('!'))}')" for p in _PATTERNS) + ")"


@query(f"with {in_sql('files')} select path, case when regexp_matches(path, '{globs.glob_regex(_PATTERNS[5])}') then true when regexp_matches(path, '{globs.glob_regex(_PATTERNS[4])}') then true when regexp_matches(path, '{globs.glob_regex(_PATTERNS[3])}') then true when regexp_matches(path, '{globs.glob_regex('src/p19*')}') then false when regexp_matches(path, '{globs.glob_regex(_PATTERNS[1])}') then true when regexp_matches(path, '{globs.glob_regex(_PATTERNS[0])}') then true else false end as ignored from files")
def ignored_files(spark, d):
    return facts(spark, d, "files").select("path", globs.ignored(F.col("path"), _PATTERNS).alias("ignored"))


@query(f"with {in_sql('files')}, {_RULES} select rule from rules where not exists (select 1 from files where regexp_matches(path, regex))")
def stale_rules(spark, d):
    rules = spark.createDataFrame([(p, globs.glob_regex(p.removeprefix("!"))) for p in _PATTERNS], "rule string, regex string")
    return policy.stale_rules(rules, facts(spark, d, "files")).select("rule")


@query(
    """with packages as (select distinct p_brand as root, case when p_brand like '%1' then null else lower(p_brand) end as name, p_brand not like '%7' as private from part),
 live as (select distinct p_brand as root from part where p_size = 50 and p_type = 'PROMO'),
 imported as (select distinct pb.p_brand as root from part pa join part pb on pa.p_size = pb.p_size and pa.p_brand <> pb.p_brand where pa.p_size = 49 and pa.p_type = 'SMALL'),
 scripted as (select distinct p_brand as value from part where p_retailprice < 905), blocked as (select distinct p_brand as root from part where p_size = 48 and p_type = 'LARGE')
 select p.root, coalesce(p.name, p.root) as name, e.evidence, case when e.evidence = '' then 'unused' else 'retained' end as outcome from packages p, lateral (select case when not private then 'public_contract' when p.root in (select root from live) then 'reachable_file'
 when p.name is not null and p.root in (select root from imported) then 'imported_by_workspace' when p.root in (select value from scripted) then 'referenced_by_script' when p.root in (select root from blocked) then 'incomplete_coverage' else '' end as evidence) e"""
)
def unused_workspaces(spark, d):
    part = _t(spark, d, "part")
    packages = part.select(F.col("p_brand").alias("root"), F.expr("case when p_brand like '%1' then null else lower(p_brand) end").alias("name"), F.expr("p_brand not like '%7'").alias("private")).distinct()
    live = part.select(F.col("p_brand").alias("owner"), F.when(F.expr("p_size = 50 and p_type = 'PROMO'"), "reachable").otherwise("unreachable").alias("status"))
    named = part.select("p_size", F.lower("p_brand").alias("package")).distinct()
    imports = part.where("p_size = 49 and p_type = 'SMALL'").select(F.col("p_brand").alias("owner"), "p_size").join(named, "p_size").select("owner", "package")
    return workspaces.unused(packages, live, imports, part.where("p_retailprice < 905").select(F.col("p_brand").alias("value")), part.where("p_size = 48 and p_type = 'LARGE'").select(F.col("p_brand").alias("owner")))


def _findings(spark, d):
    return facts(spark, d, "findings").withColumn("paths", F.array("path"))


_FIND = f"{in_sql('findings')}"
_OUT = "profile, issue_type, workspace, path, confidence"


@query(f"with {_FIND}, blocking as (select distinct p_type as workspace from part where p_size = 1 and p_retailprice < 920) select {_OUT}, workspace in (select workspace from blocking) as suppressed from findings")
def suppressed_findings(spark, d):
    blocking = _t(spark, d, "part").where("p_size = 1 and p_retailprice < 920").select(F.col("p_type").alias("workspace"))
    return policy.suppressed(_findings(spark, d), blocking).select(*_OUT.split(", "), "suppressed")


_RETAIN = [{"workspace": "PROMO", "pattern": "src/p1*", "reason": "contract", "issues": ["files"]}, {"workspace": "PROMO", "pattern": "src/*5.ts", "reason": "template", "issues": []}, {"workspace": "SMALL", "pattern": "src/", "reason": "generated", "issues": ["exports"]}]


@query(
    f"""with {_FIND} select {_OUT}, case when workspace = 'PROMO' and issue_type = 'unusedFiles' and regexp_matches(path, '{globs.glob_regex("src/p1*")}') then 'contract' when workspace = 'PROMO' and regexp_matches(path, '{globs.glob_regex("src/*5.ts")}') then 'template'
 when workspace = 'SMALL' and issue_type = 'unusedExport' and regexp_matches(path, '{globs.glob_regex("src/")}') then 'generated' end as retained_by from findings"""
)
def retained_findings(spark, d):
    return policy.retained(_findings(spark, d), _RETAIN).select(*_OUT.split(", "), "retained_by")


@query(f"with {_FIND}, r as (select *, case confidence when 'high' then 3 when 'medium' then 2 else 1 end as c, case workspace when 'PROMO' then 3 when 'SMALL' then 1 else 2 end as t from findings) select {_OUT} from r where c >= t")
def confidence_threshold(spark, d):
    thresholds = spark.createDataFrame([("PROMO", "high"), ("SMALL", "low")], "workspace string, threshold string")
    return policy.above(_findings(spark, d), thresholds).select(*_OUT.split(", "))


@query(f"with {_FIND} select {_OUT} from findings where issue_type = 'unusedFiles'")
def issue_filter(spark, d):
    return policy.of_issues(_findings(spark, d), ["files", "dependencies"]).select(*_OUT.split(", "))


_TESTY = "t as (select *, case when path like '%7.ts' then replace(path, 'src/', 'src/tests/') when path like '%3.ts' then replace(path, '.ts', '.spec.ts') when path like '%1.ts' then replace(path, 'src/', 'src/testing/') else path end as p from findings)"


@query(f"with {_FIND}, {_TESTY} select profile, p as path from t where not regexp_matches(p, '(?:^|/)(?:__tests__|__mocks__|test|tests|e2e)(?:/|$)|(?:^|/)(?:test|spec)(?:\\.(?:js|jsx|mjs|cjs|ts|tsx|mts|cts))?$|(?:\\.test|\\.spec|\\.e2e-spec|\\.stories|_test)(?:\\.(?:js|jsx|mjs|cjs|ts|tsx|mts|cts))?$')")
def test_path_filter(spark, d):
    p = F.expr("case when path like '%7.ts' then replace(path, 'src/', 'src/tests/') when path like '%3.ts' then replace(path, '.ts', '.spec.ts') when path like '%1.ts' then replace(path, 'src/', 'src/testing/') else path end")
    return policy.without_tests(_findings(spark, d).withColumn("paths", F.array(p))).select("profile", F.col("paths")[0].alias("path"))


_DIAG = "d as (select concat('src/p', cast(l_partkey as string), '.ts') as path, case when l_tax = 0 then 'parse_failure' else 'unresolved_import' end as code, l_linenumber as start, concat('[target ', l_returnflag, '] at ', l_linestatus) as message from lineitem where l_discount = 0.05)"


def _diagnostics(spark, d):
    rows = _t(spark, d, "lineitem").where("l_discount = 0.05")
    return rows.select(F.expr("concat('src/p', cast(l_partkey as string), '.ts')").alias("path"), F.expr("case when l_tax = 0 then 'parse_failure' else 'unresolved_import' end").alias("code"), F.col("l_linenumber").alias("start"), F.expr("concat('[target ', l_returnflag, '] at ', l_linestatus)").alias("message"))


@query(f"with {_DIAG}, p as (select distinct path, code, start, substr(message, 9, 1) as profile, substr(message, 12) as plain from d) select path, code, start, concat('[target ', string_agg(profile, ', ' order by profile), '] ', plain) as message from p group by path, code, start, plain")
def diagnostic_merge(spark, d):
    return files.merged_diagnostics(_diagnostics(spark, d))


@query(f"with {_DIAG}, n as (select *, row_number() over (order by path, start, code, message) as r, count(*) over () as total from d) select path, code, cast(start as bigint) as start, message from n where r < 100 union all select '.', 'diagnostic_limit_exceeded', null, concat(cast(max(total) - 99 as string), ' further diagnostics') from n having max(total) > 100")
def diagnostic_cap(spark, d):
    return files.capped_diagnostics(_diagnostics(spark, d), 100).withColumn("start", F.col("start").cast("long"))


@query(
    f"""with recursive {in_sql("entries", "edges")}, walk(profile, path, depth) using key (profile, path) as (select profile, path, 0 from entries union
 select w.profile, e.dst, min(w.depth) + 1 from walk w join edges e on e.profile = w.profile and e.src = w.path where not exists (select 1 from recurring.walk v where v.profile = w.profile and v.path = e.dst) group by w.profile, e.dst)
 select profile, path, cast(depth as integer) as depth from walk"""
)
def why_shortest_path(spark, d):
    entries = facts(spark, d, "entries").withColumn("position", F.col("path"))
    return graph.discovery(facts(spark, d, "edges"), entries).select("profile", "path", "depth")


@query(
    f"""with recursive {_STATUS}, merged as (select path, max(case status when 'reachable' then 3 when 'incomplete' then 2 else 1 end) as s from status group by path),
 {in_sql('findings')}, u as (select issue_id, issue_type, workspace, path, string_agg(distinct profile, ',' order by profile) as target_profiles, substr(min(concat(profile, confidence)), 2) as confidence from findings group by issue_id, issue_type, workspace, path)
 select issue_type, u.workspace, u.path, target_profiles, case when u.workspace <> 'LARGE' and target_profiles = 'A,N,R' and confidence = 'high' and m.s = 1 then 'eligible' else 'preview_only' end as fix_eligibility from u left join merged m on m.path = u.path"""
)
def fix_eligibility(spark, d):
    found = files.merged_findings(facts(spark, d, "findings"), list(_KEY), ["confidence"]).withColumn("paths", F.array("path"))
    return policy.fix_eligibility(found, files.merged_status(_status(spark, d)), ["A", "N", "R"], ["LARGE"]).select("issue_type", "workspace", "path", "target_profiles", "fix_eligibility")


@query(f"with {_FIND}, a as (select distinct issue_type, workspace, path from findings where profile = 'A'), r as (select distinct issue_type, workspace, path from findings where profile = 'R') select 'new' as change, * from (select * from r except select * from a) union all select 'gone', * from (select * from a except select * from r)")
def rescan_diff(spark, d):
    rows = facts(spark, d, "findings")
    return policy.rescan_diff(rows.where("profile = 'A'"), rows.where("profile = 'R'"), ["issue_type", "workspace", "path"])


def _report(spark, d):
    rows = facts(spark, d, "findings").select("issue_id", F.col("profile").alias("name"), F.array(F.col("path"), F.concat(F.lit("x y/"), F.col("workspace"))).alias("paths"), F.lit(7).cast("long").alias("start"), F.concat(F.col("path"), F.lit(" is unreachable")).alias("summary"))
    return rows.distinct()


_REP = f"{_FIND}, r as (select distinct issue_id, profile as name, path, concat('x y/', workspace) as other, concat(path, ' is unreachable') as summary from findings)"


@query(f"with {_REP} select issue_id as rule_id, path as uri, cast(7 as bigint) as start, summary as message from r union all select issue_id, replace(other, ' ', '%20'), null, summary from r")
def sarif_rows(spark, d):
    return sinks.sarif_results(_report(spark, d))


@query(f"with {_REP} select concat(path, ' - ', issue_id, ' ''', name, ''' is unused') as line from r union all select concat(other, ' - ', issue_id, ' ''', name, ''' is unused') from r")
def compact_lines(spark, d):
    return sinks.compact_lines(_report(spark, d))


@query(f"with {_REP} select concat('{{\"schemaVersion\":\"0.2\",\"issueId\":\"', issue_id, '\",\"summary\":\"', summary, '\"}}') as json from r")
def json_findings(spark, d):
    return sinks.json_rows(_report(spark, d).select(F.col("issue_id").alias("issueId"), "summary", F.lit(None).cast("string").alias("symbol")), ["issueId", "summary", "symbol"])


@query("select event_type, cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2")
def json_walk(spark, d):
    return _t(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))
