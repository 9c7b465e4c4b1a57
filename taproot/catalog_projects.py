"""Queries about projects: manifests, configurations, profiles, layers, scripts, plugins; each with the same in SQL.

Part p is a package or a configuration of one of a few shapes, so the SQL knows
what its text means without reading it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from taproot.operators import graph, plugins
from taproot.registry import query
from taproot.registry import table as _t
from taproot.sources import manifests, projects

_SHAPES = """case p_partkey % 6 when 0 then concat('{"name":"@m/p', p_partkey, '","private":true,"main":"./lib/i', p_partkey, '.js","dependencies":{"a', p_partkey % 3, '":"^1"},"scripts":{"build":"tsc"}}')
 when 1 then concat('{"name":"m', p_partkey, '","exports":{".":{"browser":"./b.js","import":"./m.js","default":"./d.js"},"./x":"./x.js","./k/*":"./lib/*.js"}}')
 when 2 then concat('{"name":"n', p_partkey, '","module":"m.js","main":"x.js","browser":"b.js","bin":{"t":"./cli.js","u', p_partkey % 2, '":"u.js"}}')
 when 3 then concat('{"name":"o', p_partkey, '","main":"../bad.js","devDependencies":{"a1":"npm:real', p_partkey % 2, '@^2"},"peerDependencies":{"a1":"*"},"bundledDependencies":["a1"]}')
 when 4 then '{"name":' else '{"exports":["./one.js","./two.js"],"optionalDependencies":{"q":"1"},"bin":"run.js"}' end"""


def _manifests(spark, d):
    return manifests.manifests(_t(spark, d, "part").selectExpr("concat('w', p_partkey, '/package.json') as path", f"{_SHAPES} as text"))


_P = "p as (select p_partkey as p, p_partkey % 6 as s, concat('w', cast(p_partkey as string)) as root from part)"


@query(
    f"""with {_P} select root, kind, field, target, safe from p, lateral (select * from (values (0, 'node_import', 'main', concat('lib/i', cast(p as string), '.js'), true), (0, 'node_require', 'main', concat('lib/i', cast(p as string), '.js'), true), (0, 'bundler', 'main', concat('lib/i', cast(p as string), '.js'), true), (0, 'browser', 'main', concat('lib/i', cast(p as string), '.js'), true),
 (1, 'node_import', 'exports', 'm.js', true), (1, 'node_require', 'exports', 'd.js', true), (1, 'bundler', 'exports', 'm.js', true), (1, 'browser', 'exports', 'b.js', true), (1, 'types', 'exports', 'd.js', true),
 (2, 'node_import', 'main', 'x.js', true), (2, 'node_require', 'main', 'x.js', true), (2, 'bundler', 'module', 'm.js', true), (2, 'browser', 'browser', 'b.js', true), (2, 'command_line', 'bin', 'cli.js', true), (2, 'command_line', 'bin', 'u.js', true),
 (3, 'node_import', 'main', '../bad.js', false), (3, 'node_require', 'main', '../bad.js', false), (3, 'bundler', 'main', '../bad.js', false), (3, 'browser', 'main', '../bad.js', false), (5, 'command_line', 'bin', 'run.js', true)) as v(shape, kind, field, target, safe) where shape = s) l
 union all select root, kind, 'exports', target, true from p, (select unnest(['node_import', 'node_require', 'bundler', 'browser', 'types']) as kind) k, (select unnest(['one.js', 'two.js']) as target) t where s = 5"""
)
def manifest_entries(spark, d):
    return _manifests(spark, d).select("root", F.explode("entries").alias("e")).select("root", "e.*")


@query(f"with {_P} select root, concat('a', cast(p % 3 as string)) as package, 'runtime' as categories, '' as alias_targets, false as bundled from p where s = 0 union all select root, 'a1', 'development,peer', concat('real', cast(p % 2 as string)), true from p where s = 3 union all select root, 'q', 'optional', '', false from p where s = 5")
def declared_dependencies(spark, d):
    return manifests.grouped_declarations(manifests.declarations(_manifests(spark, d)))


@query(f"with {_P} select root, concat('real', cast(p % 2 as string)) as target, 'a1' as package from p where s = 3")
def alias_owners(spark, d):
    return manifests.alias_owners(manifests.declarations(_manifests(spark, d)))


@query(f"with {_P} select distinct concat('a', cast(p % 3 as string)) as package from p where s = 0 union select 'a1' from p where s = 3 union select 'q' from p where s = 5 union select case s when 0 then concat('@m/p', cast(p as string)) when 1 then concat('m', cast(p as string)) when 2 then concat('n', cast(p as string)) else concat('o', cast(p as string)) end from p where s < 4")
def declared_names(spark, d):
    return manifests.declared_names(_manifests(spark, d))


@query(f"with {_P} select root, s = 4 as broken from p where root like 'w1%' and root not like 'w13%'")
def workspace_members(spark, d):
    packages = manifests.workspace_packages(_manifests(spark, d), ["w1*", "!w13*"])
    return packages.select("root", F.col("error").isNotNull().alias("broken"))


def _joined(*paths: str) -> str:
    return "concat(" + ", ',', ".join(f"root, '/{x}'" for x in paths) + ")"


@query(
    f"""with {_P}, n as (select *, case s when 0 then concat('@m/p', cast(p as string)) when 1 then concat('m', cast(p as string)) when 2 then concat('n', cast(p as string)) when 3 then concat('o', cast(p as string)) end as name from p where s < 4)
 select name as package, name as specifier, case when s = 1 then {_joined('m.ts', 'd.ts')} else '' end as esm, case when s = 1 then {_joined('d.ts')} else '' end as common_js from n
 union all select name, concat(name, '/x'), {_joined('x.ts')}, {_joined('x.ts')} from n where s = 1 union all select name, concat(name, '/k/', f), concat(root, '/lib/', f, '.ts'), concat(root, '/lib/', f, '.ts') from n, (select unnest(['a', 'b']) as f) u where s = 1"""
)
def workspace_module_targets(spark, d):
    files = _t(spark, d, "part").where("p_partkey % 6 = 1").selectExpr("explode(transform(array('m', 'd', 'x', 'lib/a', 'lib/b'), x -> concat('w', p_partkey, '/', x, '.ts'))) as path")
    packages = graph.checkpointed(_manifests(spark, d).select("name", "root", "entries", "subpaths"))
    found = manifests.module_targets(packages, files)
    return found.select("package", "specifier", F.array_join("esm", ",").alias("esm"), F.array_join("common_js", ",").alias("common_js"))


@query("select '' as root, concat('n', cast(p_partkey as string)) as package, concat('t', cast(p_partkey as string)) as binary from part where p_partkey % 12 = 2 union all select '', concat('n', cast(p_partkey as string)), concat('n', cast(p_partkey as string)) from part where p_partkey % 12 = 4")
def installed_binaries(spark, d):
    """Binaries of the packages that the root manifest declares, from their installed manifests."""
    part = _t(spark, d, "part")
    text = """case p_partkey % 4 when 2 then concat('{"name":"n', p_partkey, '","bin":{"t', p_partkey, '":"./cli.js"}}') else concat('{"name":"@s/n', p_partkey, '","bin":"./cli.js"}') end"""
    installed = manifests.manifests(part.where("p_partkey % 2 = 0").selectExpr("concat('node_modules/n', p_partkey, '/package.json') as path", f"{text} as text"))
    own = part.where("p_partkey % 12 in (2, 4)").selectExpr("'' as root", "concat('n', p_partkey) as package", "'1' as requirement", "'runtime' as category", "false as bundled")
    return manifests.installed_binaries(own, installed)


@query(
    """with p as (select p_partkey as p from part), r as (select p, case p % 4 when 1 then p - 1 when 2 then p - 2 else p end as b from p)
 select concat('c', cast(p as string), '/tsconfig.json') as path, case when p % 4 < 3 then concat('c', cast(b as string), '/src') end as root_dir, case when p % 4 < 3 then concat('c', cast(b as string), '/dist') end as out_dir,
 case when p % 4 = 3 then 'extends:@tsconfig/base' else concat_ws(',', case when p % 4 = 2 then 'jsx_import_source:preact' end, 'types:node') end as evidence from r"""
)
def configuration_inheritance(spark, d):
    text = """case p_partkey % 4 when 0 then '{ // base\\n "compilerOptions": {"rootDir": "src", "outDir": "./dist", "types": ["node"]}, }' when 1 then concat('{"extends": "../c', p_partkey - 1, '/tsconfig"}')
 when 2 then concat('{"extends": "../c', p_partkey - 1, '/tsconfig.json", "compilerOptions": {"jsxImportSource": "preact"}}') else '{"extends": "@tsconfig/base"}' end"""
    read = manifests.configurations(_t(spark, d, "part").selectExpr("concat('c', p_partkey, '/tsconfig.json') as path", f"{text} as text"))
    return read.select("path", "root_dir", "out_dir", F.array_join(F.array_sort(F.transform("evidence", lambda e: F.concat_ws(":", e["kind"], e["specifier"]))), ",").alias("evidence"))


@query(
    """with recursive w as (select p_partkey as p, p_partkey as up from part union all select p, up - 1 from w where up % 5 <> 0 and up > 1)
 select concat('t', cast(p as string)) as name, string_agg(distinct concat('c', cast(up % 3 as string)), ',' order by concat('c', cast(up % 3 as string))) as conditions, case when bool_or(up % 10 = 0) then 'open' else 'closed' end as world from w group by p"""
)
def target_profiles(spark, d):
    rows = _t(spark, d, "part").selectExpr("concat('t', p_partkey) as name", "case when p_partkey % 5 <> 0 and p_partkey > 1 then concat('t', p_partkey - 1) end as parent", "array(concat('c', p_partkey % 3)) as conditions", "case when p_partkey % 10 = 0 then 'open' end as world")
    return manifests.resolved_profiles(rows).select("name", F.array_join("conditions", ",").alias("conditions"), "world")


_LAYER = "case l_linenumber when 1 then 'inferred' when 2 then 'root' when 3 then 'workspace' else 'cli' end"
_LAYERS = f"select concat('w', cast(l_suppkey as string)) as workspace, {_LAYER} as layer, max(case when l_quantity > 45 then l_returnflag end) as mode, min(case when l_discount = 0 then l_linestatus end) as world from {{lineitem}} group by l_suppkey, {_LAYER}"


@query(
    f"""with l as ({_LAYERS.format(lineitem='lineitem')}), x as (select workspace, max(case layer when 'inferred' then mode end) as m1, max(case layer when 'root' then mode end) as m2, max(case layer when 'workspace' then mode end) as m3, max(case layer when 'cli' then mode end) as m4,
 max(case layer when 'inferred' then world end) as w1, max(case layer when 'root' then world end) as w2, max(case layer when 'workspace' then world end) as w3, max(case layer when 'cli' then world end) as w4 from l group by workspace)
 select workspace, coalesce(m4, m3, case when m2 > 'P' then m2 end, 'P') as mode, coalesce(w4, w3, w2, w1) as world from x"""
)
def configuration_layers(spark, d):
    """Of two values of one layer, one's own and the shared one, the greater counts."""
    own = spark.sql(_LAYERS, lineitem=_t(spark, d, "lineitem"))
    return manifests.layered(own.unionByName(spark.createDataFrame([(None, "root", "P", None)], own.schema)), ["mode", "world"])


_BODIES = """case p_partkey % 5 when 0 then 'NODE_ENV=x cross-env node ./tools/a.js && npm run lint' when 1 then "npx tsc -p . | sh -c 'jest --ci'" when 2 then 'run-p a b' when 3 then '$CMD x; rm -rf dist' else 'eslint.cmd "src/**"' end"""


@query(
    """with p as (select p_partkey as p from part) select concat('w', cast(p as string)) as root, 'main' as name, v.kind, v.value from p, lateral (select * from (values (0, 'file', 'tools/a.js'), (0, 'script', 'lint'), (1, 'binary', 'tsc'), (1, 'binary', 'jest'), (2, 'script', 'a'), (2, 'script', 'b'), (3, 'unmodeled', '$CMD'), (4, 'binary', 'eslint')) as v(s, kind, value) where s = p % 5) v"""
)
def script_references(spark, d):
    return projects.script_table(_t(spark, d, "part").selectExpr("concat('w', p_partkey) as root", "'main' as name", f"{_BODIES} as body"))


@query("with p as (select p_partkey as p from part) select concat('w', cast(p as string)) as root, n as name from p, (select unnest(['build', 'prebuild', 'a', 'b', 'unused']) as n) x where p % 2 = 1 or n <> 'unused'")
def reachable_scripts(spark, d):
    part = _t(spark, d, "part")
    bodies = part.selectExpr("concat('w', p_partkey) as root", "explode(map('build', 'npm run a && run-p b c', 'prebuild', 'x', 'a', 'tsc', 'b', 'y', 'unused', 'z')) as (name, body)")
    return projects.running_scripts(bodies, part.where("p_partkey % 2 = 0").selectExpr("concat('w', p_partkey) as root", "'build' as name"))


_USES = "array('next', 'jest', '@storybook/react', '@nestjs/common', 'react')[p_size % 5]"
_CONFIGS = "array('tsconfig.build.json', 'next.config.mjs', '.eslintrc', 'jsconfig.json', 'readme.md')[p_size % 5]"


def _detected(spark, d):
    part = _t(spark, d, "part")
    rules = plugins.builtin_rules(spark)
    packages = part.selectExpr("concat(p_brand, '/', p_type) as workspace", f"{_USES} as package").where("length(workspace) % 2 = 0").distinct()
    configs = part.where("p_type <> 'PROMO'").selectExpr("concat(p_brand, '/', p_type) as workspace", f"{_CONFIGS} as path").distinct()
    return plugins.detected(packages, configs, rules), rules


_FOUND = """w as (select distinct concat(p_brand, '/', p_type) as workspace, p_type, p_size % 5 as s from part),
 found as (select workspace, plugin, kind, value from w, lateral (select * from (values (0, 'next', 'package', 'next'), (1, 'jest', 'package', 'jest'), (2, 'storybook', 'package', '@storybook/react'), (3, 'nest', 'package', '@nestjs/common')) as v(k, plugin, kind, value) where k = s) v where length(workspace) % 2 = 0
 union select workspace, plugin, kind, value from w, lateral (select * from (values (0, 'typescript-config', 'config_file', 'tsconfig.build.json'), (1, 'next', 'config_file', 'next.config.mjs'), (2, 'eslint', 'config_file', '.eslintrc'), (3, 'typescript-config', 'config_file', 'jsconfig.json')) as v(k, plugin, kind, value) where k = s) v where p_type <> 'PROMO')"""


@query(f"with {_FOUND} select workspace, plugin, kind, value from found")
def plugin_detection(spark, d):
    return _detected(spark, d)[0]


_RELATIVE = "case p_partkey % 6 when 0 then concat('app/x', cast(p_partkey as string), '/page.tsx') when 1 then concat('src/u', cast(p_partkey as string), '.test.ts') when 2 then 'src/main.ts' when 3 then concat('src/c', cast(p_partkey as string), '.stories.ts') when 4 then concat('tests/deep/t', cast(p_partkey as string), '.ts') else concat('src/z', cast(p_partkey as string), '.ts') end"


@query(f"with {_FOUND}, f as (select distinct concat(p_brand, '/', p_type) as workspace, p_partkey % 6 as s, {_RELATIVE} as relative from part) select distinct f.workspace, concat(f.workspace, '/', relative) as path, x.plugin from f join (select distinct workspace, plugin from found) x on x.workspace = f.workspace where (s = 0 and plugin = 'next') or (s in (1, 4) and plugin = 'jest') or (s = 2 and plugin = 'nest') or (s = 3 and plugin = 'storybook')")
def plugin_entries(spark, d):
    found, rules = _detected(spark, d)
    files = _t(spark, d, "part").selectExpr("concat(p_brand, '/', p_type) as workspace", f"{_RELATIVE} as relative").distinct().selectExpr("workspace", "concat(workspace, '/', relative) as path", "relative")
    return plugins.entries(files, found, rules)


def _custom(spark, d):
    spec = [("gen", "Generator", "file_edge", "src/a*.ts", "out/*.ts", "generated"), ("gen", "Generator", "dynamic_import", "src/b*.ts", "out/x1.ts", "loader"), ("gen", "Generator", "file_transform", "src/*.proto.ts", "js,.d.ts", "compiled")]
    files = _t(spark, d, "nation").selectExpr("concat('r', n_regionkey) as workspace", "explode(array(concat('src/a', n_nationkey, '.ts'), concat('src/b', n_nationkey, '.ts'), concat('out/x', n_nationkey % 4, '.ts'), concat('src/m', n_nationkey, '.proto.ts'))) as relative")
    made = _t(spark, d, "nation").where("n_nationkey % 2 = 0").selectExpr("concat('r', n_regionkey) as workspace", "concat('src/m', n_nationkey, '.proto.js') as relative")
    files = files.union(made).distinct().selectExpr("workspace", "concat(workspace, '/', relative) as path", "relative")
    found = spark.createDataFrame([(f"r{i}", "gen", "package", "gen") for i in range(4)], "workspace string, plugin string, kind string, value string")
    return files, found, spark.createDataFrame(spec, plugins.RULES)


@query("with n as (select concat('r', cast(n_regionkey as string)) as w, n_nationkey as k from nation where n_regionkey < 4) select distinct concat(a.w, '/src/a', cast(a.k as string), '.ts') as src, concat(b.w, '/out/x', cast(b.k % 4 as string), '.ts') as dst, 'Generator: generated' as reason from n a join n b on a.w = b.w union select concat(a.w, '/src/b', cast(a.k as string), '.ts'), concat(b.w, '/out/x1.ts'), 'Generator dynamic import: loader' from n a join n b on a.w = b.w where b.k % 4 = 1")
def plugin_edges(spark, d):
    return plugins.edges(*_custom(spark, d))[0]


@query("with n as (select concat('r', cast(n_regionkey as string)) as w, n_nationkey as k from nation where n_regionkey < 4) select concat(w, '/src/m', cast(k as string), '.proto.ts') as src, concat(w, '/src/m', cast(k as string), '.proto.js') as dst, 'edge' as kind from n where k % 2 = 0 union all select concat(w, '/src/m', cast(k as string), '.proto.ts'), null, 'plugin_transform_output_missing' from n where k % 2 = 1")
def plugin_transforms(spark, d):
    made, lost = plugins.transforms(*_custom(spark, d))
    return made.select("src", "dst", F.lit("edge").alias("kind")).union(lost.select("path", F.lit(None).cast("string"), "code"))


@query("with p as (select p_partkey as p from part) select concat('w', cast(p as string), '/.babelrc.json') as path, v.property, v.package from p, lateral (select * from (values ('plugins', concat('eslint-plugin-a', cast(p % 5 as string))), ('plugins', 'x'), ('plugins', '@s/b'), ('presets', concat('pre', cast(p % 4 as string)))) as v(property, package)) v")
def configuration_references(spark, d):
    text = """concat('{"plugins":["eslint-plugin-a', p_partkey % 5, '",{"x":"@s/b"}],"env":{"presets":{"pre', p_partkey % 4, '":true}},"other":"no","path":"./x"}')"""
    return plugins.config_references(_t(spark, d, "part").selectExpr("concat('w', p_partkey, '/.babelrc.json') as path", f"{text} as text"), ["plugins", "presets"])


@query(f"with f as (select distinct {_RELATIVE} as path, p_partkey % 6 as s from part), k as (select unnest(['test', 'browser', 'node']) as profile) select profile, path, case profile when 'test' then s in (1, 4) when 'browser' then s = 3 else false end as entry from f, k")
def conventional_entries(spark, d):
    rows = _t(spark, d, "part").selectExpr(f"{_RELATIVE} as path").distinct().withColumn("profile", F.explode(F.array(*map(F.lit, ("test", "browser", "node")))))
    return rows.select("profile", "path", plugins.conventional(F.col("profile"), F.col("path")).alias("entry"))


@query("with p as (select p_partkey as p, concat('w', cast(p_partkey as string), '/') as w from part) select p, concat(w, case p % 4 when 0 then 'src/a.ts' when 1 then 'lib/b.tsx' when 2 then 'c/index.mts' end) as path from p where p % 4 < 3")
def mapped_entries(spark, d):
    """Entry paths of manifests as sources: another extension, or the root folder of an output folder."""
    part = _t(spark, d, "part")
    wanted = part.selectExpr("p_partkey as p", "concat('w', p_partkey, '/', element_at(array('./dist/a.js', 'lib/b.js', 'c/index.mjs', 'none.js'), cast(p_partkey % 4 + 1 as int))) as place")
    files = part.selectExpr("explode(transform(array('src/a.ts', 'lib/b.tsx', 'c/index.mts'), x -> concat('w', p_partkey, '/', x))) as path")
    configs = part.selectExpr("concat('w', p_partkey, '/tsconfig.json') as path", "concat('w', p_partkey, '/src') as root_dir", "concat('w', p_partkey, '/dist') as out_dir")
    return manifests.mapped_entries(wanted, files, configs).select("p", "path")


@query("with p as (select p_partkey as p from part) select p, case when p % 3 = 0 then 'pnpm' when p % 3 = 1 then 'yarn' else null end as selected, case when p % 3 = 0 then 'npm,pnpm' when p % 3 = 1 then 'yarn' else 'bun,npm' end as candidates from p")
def package_managers(spark, d):
    """The manager of each package: declared, or the one that all its lock files agree on."""
    part = _t(spark, d, "part")
    marks = part.selectExpr("p_partkey as p", "explode(element_at(array(array('package-lock.json', 'pnpm-lock.yaml'), array('yarn.lock', '.pnp.cjs'), array('bun.lock', 'npm-shrinkwrap.json', 'x.lock')), cast(p_partkey % 3 + 1 as int))) as name")
    declared = part.where("p_partkey % 3 = 0").selectExpr("p_partkey as p", "'pnpm@9.1.0' as declared")
    return manifests.managers(marks, declared, "p")
