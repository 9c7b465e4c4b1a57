"""Queries about imports: the ladder of statuses, aliases, symbol links, evidence; each with the same in SQL.

Facts come from the star schema: part p is src/p{p}.ts, each line is an import of
one of 13 kinds, whose outcome the SQL knows from the kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taproot.operators import modules, reporting, workspaces
from taproot.registry import query, table

_TABLES = ("lineitem", "part")

#: Fact tables that Spark and other engines read alike.
FACTS = {
    "raw": "select distinct l_partkey as p, (l_orderkey + l_linenumber) % 13 as kind, 1 + (l_partkey * 7) % 2500 as n from {lineitem}",
    "imports": """select concat('src/p', cast(p as string), '.ts') as path, p, kind, n, case when n % 3 = 0 then 'common_js' else 'esm' end as mode, kind < 2 and n % 11 = 0 as deferred, n % 6 = 1 as type_only,
 case kind when 0 then concat('./p', cast(n as string)) when 1 then concat('./p', cast(n as string), '.js') when 2 then concat('pkg', cast(n % 50 as string)) when 3 then 'node:fs' when 4 then concat('@/p', cast(n as string)) when 5 then concat('./style', cast(n as string), '.css')
 when 6 then concat('./widget', cast(n as string), '.vue') when 7 then concat('@ws/lib', cast(n % 40 as string)) when 8 then concat('./missing', cast(n as string)) when 9 then concat('../lib/g', cast(n as string), '.js') when 10 then concat('#inner', cast(n as string))
 when 11 then concat('../node_modules/x', cast(n as string), '/i.js') else 'fs/promises' end as specifier from ({raw}) r""",
    "files": "select concat('src/p', cast(p_partkey as string), '.ts') as path from {part}",
    "others": """select concat('src/style', cast(p_partkey as string), '.css') as path from {part} where p_partkey % 2 = 0 union all select concat('src/widget', cast(p_partkey as string), '.vue') from {part} where p_partkey % 3 = 0
 union all select concat('lib/g', cast(p_partkey as string), '.js') from {part} where p_partkey % 5 <> 0 union all select concat('node_modules/x', cast(p_partkey as string), '/i.js') from {part}""",
    "declared": "select distinct concat('pkg', cast(p_partkey % 50 as string)) as package from {part} where p_partkey % 2 = 0",
    "workspace_targets": """select concat('@ws/lib', cast(k as string)) as package, concat('@ws/lib', cast(k as string)) as specifier, case when k < 10 then array(concat('src/p', cast(k + 1 as string), '.ts'), concat('src/p', cast(k + 2 as string), '.ts')) when k < 20 then array(concat('src/p', cast(k + 1 as string), '.ts')) else array('src/none.ts') end as esm,
 case when k between 10 and 19 then array(concat('src/p', cast(k + 5 as string), '.ts')) else array() end as common_js from (select distinct p_partkey % 40 as k from {part}) t where k < 30""",
    "exports": """select concat('src/p', cast(p_partkey as string), '.ts') as path, p_partkey as p, e.exported, e.source, e.imported, e.local, e.kind, e.type_only from {part} lateral view explode(filter(array(
 named_struct('exported', 'a', 'source', cast(null as string), 'imported', cast(null as string), 'local', 1, 'kind', 'local', 'type_only', false, 'on', true),
 named_struct('exported', 'T', 'source', cast(null as string), 'imported', cast(null as string), 'local', 2, 'kind', 'type_alias', 'type_only', true, 'on', p_partkey % 3 = 0),
 named_struct('exported', 'r', 'source', concat('./p', cast(p_partkey + 1 as string)), 'imported', 'a', 'local', cast(null as int), 'kind', 're_export', 'type_only', false, 'on', p_partkey % 4 = 0),
 named_struct('exported', '*', 'source', concat('./p', cast(p_partkey + 2 as string)), 'imported', cast(null as string), 'local', cast(null as int), 'kind', 'star', 'type_only', false, 'on', p_partkey % 5 in (0, 2))), x -> x.on)) t as e""",
    "bindings": """select concat('src/p', cast(p_partkey as string), '.ts') as path, p_partkey as p, concat('./p', cast(p_partkey + 5 as string)) as source, case p_partkey % 4 when 0 then 'a' when 3 then 'r' end as imported, 10 as local,
 case p_partkey % 4 when 1 then 'default' when 2 then 'namespace' else 'named' end as kind, p_partkey % 7 = 0 as type_only from {part}""",
    "resolved": """select concat('src/p', cast(p_partkey as string), '.ts') as path, concat('./p', cast(p_partkey + d as string)) as specifier, d as start, d as end, 'resolved' as status, concat('src/p', cast(p_partkey + d as string), '.ts') as target
 from {part} cross join (select explode(array(1, 2, 5)) as d) x where p_partkey + d <= (select max(p_partkey) from {part})""",
}


def facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FACTS[name].replace("{raw}", FACTS["raw"])
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in sql})


def in_sql(*names: str) -> str:
    return ", ".join(f"{n} as ({FACTS[n].replace('{raw}', FACTS['raw']).replace('{lineitem}', 'lineitem').replace('{part}', 'part')})" for n in names)


_OUTCOME = """top as (select max(p_partkey) as m from part),
 o as (select i.*, n <= m as there, n % 40 as k,
 case when deferred then 'deferred' when kind in (0, 1) then case when n <= m then 'resolved' else 'unresolved' end when kind = 2 then case when n % 2 = 0 then 'external' else 'unsupported' end when kind in (3, 12) then 'external'
 when kind = 4 then case when n <= m then 'resolved' else 'unsupported' end when kind = 5 then case when n <= m and n % 2 = 0 then 'external' else 'unresolved' end when kind = 6 then case when n <= m and n % 3 = 0 then 'unsupported' else 'unresolved' end
 when kind = 7 then case when n % 40 < 20 then 'resolved' when n % 40 < 30 then 'unresolved' else 'unsupported' end when kind = 10 then 'unsupported' when kind = 11 then case when n <= m then 'external' else 'unresolved' end else 'unresolved' end as status from imports i, top),
 f as (select *, case when status = 'resolved' and kind in (0, 1) then n when status = 'resolved' and kind = 4 then case when n = 7 then 8 else n end when status = 'resolved' and kind = 7 then case when k >= 10 and mode = 'common_js' then k + 5 else k + 1 end end as hit,
 case when status = 'unresolved' then case when kind = 9 and there and n % 5 <> 0 then 'outside_file_universe' else 'unresolved_import' end when status = 'unsupported' then case when kind = 6 then 'unsupported_imported_source' else 'unsupported_specifier' end end as code from o)"""


def _ladder(spark, d):
    imports = facts(spark, d, "imports").select("path", "specifier", "mode", "deferred").distinct()
    configs = spark.createDataFrame([("tsconfig.json", "", "typescript"), ("jsconfig.json", "", "javascript")], "path string, root string, kind string")
    aliases = spark.createDataFrame([("tsconfig.json", "@/*", 0, "src/*"), ("tsconfig.json", "@/p7", 0, "src/p8"), ("jsconfig.json", "@/*", 0, "wrong/*")], "config string, pattern string, position int, target string")
    places = modules.candidates(imports, configs, aliases)
    return modules.ladder(imports, places, *(facts(spark, d, n) for n in ("files", "others", "declared", "workspace_targets")))


@query(f"with {in_sql('imports')}, {_OUTCOME} select distinct path, specifier, mode, status, case when hit is not null then concat('src/p', cast(hit as string), '.ts') end as target, code, status in ('unresolved', 'unsupported') as blocks from f")
def import_status_ladder(spark, d):
    return _ladder(spark, d).select("path", "specifier", "mode", "status", "target", "code", "blocks")


@query(f"with {in_sql('imports')}, {_OUTCOME} select distinct path as src, concat('src/p', cast(hit as string), '.ts') as dst from f where hit is not null union select path, concat('src/p', cast(k + 2 as string), '.ts') from f where kind = 7 and k < 10")
def import_edges(spark, d):
    return modules.edges(_ladder(spark, d))


@query(
    f"""with {in_sql('imports')}, {_OUTCOME} select distinct path, code, case code when 'unresolved_import' then concat('Could not resolve `', specifier, '`') when 'outside_file_universe' then concat('`', specifier, '` resolved to source outside the explicit universe')
 when 'unsupported_imported_source' then concat('`', specifier, '` resolved to a source format whose embedded module graph is not modeled') else concat('`', specifier, '` needs a resolver feature that is not modeled') end as message, true as blocks from f where code is not null"""
)
def import_diagnostics(spark, d):
    return modules.diagnostics(_ladder(spark, d))


@query(
    f"""with {in_sql('imports')}, {_OUTCOME}, e as (select distinct path, p, specifier, type_only, status, case when kind = 2 then specifier when kind = 7 then specifier end as package from f where status <> 'resolved')
 select distinct concat('w', cast(p % 3 as string)) as workspace, package, case when type_only then 'type_only_import' else 'source_import' end as kind, case when type_only then 'contract' else 'runtime' end as scope, concat(path, ' imports ', specifier) as source, p % 2 = 0 as reachable from e where package is not null"""
)
def source_dependency_evidence(spark, d):
    more = facts(spark, d, "imports").select("path", "specifier", "mode", "type_only").distinct()
    rows = _ladder(spark, d).join(more, ["path", "specifier", "mode"])
    parts = table(spark, d, "part").selectExpr("concat('src/p', cast(p_partkey as string), '.ts') as path", "case when p_partkey % 2 = 0 then 'reachable' else 'unreachable' end as status", "concat('w', cast(p_partkey % 3 as string)) as owner")
    return reporting.dependency_evidence(rows, parts.select("path", "status"), parts.select("path", "owner"))


_TOP = "top as (select max(p_partkey) as m from part)"
_STATES = """ex as (select p_partkey as p, 'a' as name, 1 as local, 'runtime' as usage from part union all select p_partkey, 'T', 2, 'type' from part where p_partkey % 3 = 0),
 names as (select p, name from ex union all select p_partkey, 'r' from part where p_partkey % 4 = 0),
 spread as (select p, p as at from (select p_partkey as p from part) q union select s.p, s.at + 2 from spread s, top where s.at % 5 in (0, 2) and s.at + 2 <= m),
 every as (select distinct s.p, n.name from spread s join names n on n.p = s.at),
 walk as (select p, name, p as at, name as nm from asked union
  select w.p, w.name, case when x.step = 1 then w.at + 1 else w.at + 2 end, case when x.step = 1 then 'a' else w.nm end from walk w, (select unnest([1, 2]) as step) x, top
  where (x.step = 1 and w.nm = 'r' and w.at % 4 = 0 and w.at + 1 <= m) or (x.step = 2 and w.at % 5 in (0, 2) and w.at + 2 <= m)),
 meant as (select distinct w.p, w.name, ex.p as place, ex.local, ex.usage from walk w join ex on ex.p = w.at and ex.name = w.nm)"""
_ASKED = """asked as (select distinct p, name from (select p_partkey + 5 as p, case p_partkey % 4 when 0 then 'a' when 3 then 'r' when 1 then 'default' end as name from part, top where p_partkey % 4 <> 2 and p_partkey + 5 <= m union all select e.p, e.name from every e where (e.p - 5) % 4 = 2 and e.p > 5) z)"""
_BOUND = """b as (select p_partkey as p, p_partkey + 5 as q, case p_partkey % 4 when 0 then 'a' when 3 then 'r' when 1 then 'default' end as name, case when p_partkey % 7 = 0 then 'type' else 'runtime' end as usage from part, top where p_partkey + 5 <= m)"""
_SPLIT = _STATES.split(",\n walk as")


@query(
    f"""with recursive {_TOP}, {_SPLIT[0]}, {_ASKED}, walk as{_SPLIT[1]}, {_BOUND}
 select distinct concat('src/p', cast(b.p as string), '.ts') as src_path, 10 as src_symbol, b.usage as src_usage, concat('src/p', cast(t.place as string), '.ts') as dst_path, t.local as dst_symbol, t.usage as usage from b join meant t on t.p = b.q and (b.name = t.name or b.name is null)"""
)
def symbol_links(spark, d):
    return modules.symbol_links(facts(spark, d, "bindings"), facts(spark, d, "exports"), facts(spark, d, "resolved"))


@query(
    f"""with recursive {_TOP}, {_SPLIT[0]}, asked as (select distinct p, name from (select p_partkey as p, 'r' as name from part where p_partkey % 20 = 0 union all select e.p - 2, e.name from every e where (e.p - 2) % 10 = 0 and e.p >= 2) z), walk as{_SPLIT[1]}
 select distinct concat('src/p', cast(place as string), '.ts') as path, local as symbol, usage from meant"""
)
def open_world_reexports(spark, d):
    world = table(spark, d, "part").where("p_partkey % 10 = 0").selectExpr("concat('src/p', cast(p_partkey as string), '.ts') as path")
    return modules.open_world_roots(facts(spark, d, "exports"), facts(spark, d, "resolved"), world)


@query("with x as (select l_partkey as a, l_suppkey * 30 as b, l_returnflag as r from lineitem) select distinct concat('src/p', cast(a as string), '.ts') as path, concat('plugin: ', r) as specifier, concat('src/p', cast(b as string), '.ts') as target from x where b in (select p_partkey from part)")
def additional_edges(spark, d):
    extra = table(spark, d, "lineitem").selectExpr("concat('src/p', cast(l_partkey as string), '.ts') as src", "concat('src/p', cast(l_suppkey * 30 as string), '.ts') as dst", "l_returnflag as reason")
    return modules.additional_edges(extra, facts(spark, d, "files"))


@query("with p as (select p_partkey as p, concat('w', cast(p_partkey % 7 as string), case when p_partkey % 2 = 0 then '/sub' else '' end, '/f', cast(p_partkey as string), '.ts') as path from part) select path, case when p % 7 = 6 then null when p % 7 < 3 and p % 2 = 0 then concat('w', cast(p % 7 as string), '/sub/tsconfig.json') when p % 7 < 5 then concat('w', cast(p % 7 as string), '/tsconfig.json') else concat('w', cast(p % 7 as string), '/jsconfig.json') end as config from p")
def nearest_configuration(spark, d):
    """The deepest configuration that holds a file; a tsconfig before a jsconfig of one folder."""
    rows = [(f"w{i}/{'ts' if i < 5 else 'js'}config.json", f"w{i}", "typescript" if i < 5 else "javascript") for i in range(6)] + [(f"w{i}/jsconfig.json", f"w{i}", "javascript") for i in range(2)] + [(f"w{i}/sub/tsconfig.json", f"w{i}/sub", "typescript") for i in range(3)]
    configs = spark.createDataFrame(rows, "path string, root string, kind string")
    paths = table(spark, d, "part").selectExpr("concat('w', cast(p_partkey % 7 as string), case when p_partkey % 2 = 0 then '/sub' else '' end, '/f', cast(p_partkey as string), '.ts') as path")
    own = modules.own_configuration(paths, configs)
    return paths.join(own, "path", "left").select("path", "config")


@query("with p as (select distinct p_partkey as p from part) select concat('w', cast(p % 9 as string), '/src/f', cast(p as string), '.ts') as path, case when p % 9 < 6 then concat('w', cast(p % 9 as string)) end as owner from p where p % 9 < 6 union all select concat('w', cast(p % 9 as string), '/src/f', cast(p as string), '.ts'), null from p where p % 9 >= 6")
def package_file_owners(spark, d):
    paths = table(spark, d, "part").selectExpr("concat('w', cast(p_partkey % 9 as string), '/src/f', cast(p_partkey as string), '.ts') as path").distinct()
    return workspaces.nearest(paths, spark.createDataFrame([(f"w{i}",) for i in range(6)], "root string"))
