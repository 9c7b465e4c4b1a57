import json

import pytest
from pyspark.sql import functions as F

from taproot import catalog_projects
from taproot.operators import plugins, workspaces
from taproot.sources import jsfacts, manifests, projects
from tests.conftest import SMALL


def read(text):
    return jsfacts.read_facts(text)


def test_imports():
    f = read(
        """import a, { b as c, type D } from "one"; import * as ns from './two';
import "side"; import type T from "types"; import { type U, type V } from "only-types";
export * from "star"; export * as all from "ns"; export { x as y } from "re"; export type { Z } from "z";
// import "comment"
const s = "import 'string'"; /* import "block" */ const r = /import "regex"/;
import("dyn"); require("cjs"); require.resolve("res"); const q = require(`tpl`);
new URL("./u.js", import.meta.url); new Worker("./w.js");"""
    )
    assert [(s, k, a, t) for s, k, a, t, _, _ in f.imports] == [
        ("one", "static", "module", False),
        ("./two", "static", "module", False),
        ("side", "side_effect", "module", False),
        ("types", "static", "module", True),
        ("only-types", "static", "module", True),
        ("star", "re_export", "module", False),
        ("ns", "re_export", "module", False),
        ("re", "re_export", "module", False),
        ("z", "re_export", "module", True),
        ("dyn", "dynamic", "module", False),
        ("cjs", "common_js_require", "module", False),
        ("res", "common_js_resolve", "module", False),
        ("tpl", "common_js_require", "module", False),
        ("./u.js", "dynamic", "module", False),
        ("./w.js", "dynamic", "module", False),
    ]
    assert f.bindings[:4] == [("one", "default", "a", "default", False), ("one", "b", "c", "named", False), ("one", "D", "D", "named", True), ("./two", None, "ns", "namespace", False)]
    assert not f.diagnostics


def test_constants_and_unknown_loads():
    f = read('const base = "./x"; const full = base + "/y" + ".js"; import(full); import(unknown); require(a, b);')
    assert [i[0] for i in f.imports] == ["./x/y.js"]
    assert [d[0] for d in f.diagnostics] == ["unsupported_dynamic_import", "unsupported_dynamic_require"]
    assert all(d[5] for d in f.diagnostics)


@pytest.mark.parametrize("text", ["function f() { import('x') }", "const f = () => import('x');", "class A { m() { require('x') } }", "x.map(y => { return require('x') })"])
def test_deferred_loads_block(text):
    f = read(text)
    assert [(i[0], i[2]) for i in f.imports] == [("x", "deferred")]
    assert [(d[0], d[5]) for d in f.diagnostics] == [("deferred_execution_region", True)]


@pytest.mark.parametrize("text", ["if (a) { import('x') }", "for (const y of z) { require('x') }", "{ require('x') }", "const f = () => 1, g = require('x');"])
def test_eager_blocks_do_not(text):
    f = read(text)
    assert [(i[0], i[2]) for i in f.imports] == [("x", "module")] and not f.diagnostics


def test_exports():
    f = read("export const a = 1, b = 2; export function* c() {} export default class D {} export { e as f }; export interface I {} export type T = 1; export enum E {} export abstract class K {}")
    assert [(e[0], e[3], e[4], e[5]) for e in f.exports] == [("a", "a", "variable", False), ("b", "b", "variable", False), ("c", "c", "function", False), ("default", "D", "default", False), ("f", "e", "local", False), ("I", "I", "interface", True), ("T", "T", "type_alias", True), ("E", "E", "enum", False), ("K", "K", "class", False)]
    assert [e[0] for e in read("module.exports.x = 1; exports.y = 2;").exports] == ["x", "y"]


def test_unreadable_sources_block():
    assert [d[0] for d in read("import { from").diagnostics] == ["parse_failure"]
    assert [d[0] for d in read("function ( {").diagnostics] == ["parse_failure"]
    assert read("").imports == []


def test_extraction_in_spark(spark):
    df = spark.createDataFrame([("a.js", 'import "./b.js";'), ("b.js", None), ("c.js", "(")], "path string, text string")
    facts = jsfacts.extracted(df)
    assert [tuple(r) for r in jsfacts.table(facts, "imports").select("path", "specifier", "kind").collect()] == [("a.js", "./b.js", "side_effect")]
    assert [r.path for r in jsfacts.table(facts, "diagnostics").where("blocks").collect()] == ["c.js"]


def test_json_with_comments():
    text = '\ufeff{ // note\n "a": "http://x", /* b */ "c": [1, 2,], }'
    assert json.loads(projects.without_comments(text)) == {"a": "http://x", "c": [1, 2]}


def test_conditions():
    value = {"types": "./t.d.ts", "browser": "./b.js", "import": "./i.js", "default": "./d.js"}
    assert projects.conditional(value, {"import", "browser"}) == ["./b.js"]  # the first key in order
    assert projects.by_priority(value, ["node", "import"]) == ["./i.js"]  # the first in the profile's order
    assert projects.conditional({"node": {"require": "./r.js"}, "default": "./d.js"}, {"node"}) == []  # a key that is active decides, whatever is in it
    assert manifests.entry_targets(json.loads('{"main": "./lib/x.js", "bin": {"t": "cli.js"}, "browser": "../bad.js"}'), "browser") == [("browser", "../bad.js")]
    assert not manifests.safe_entry("../bad.js") and manifests.safe_entry("./lib/x.js")
    assert manifests.subpath_targets({"exports": {".": "a", "./x": [{"import": "./x.mjs"}, "./x.js"]}}, "node_import") == [("./x", "./x.mjs"), ("./x", "./x.js")]


def test_workspace_patterns(spark):
    text = """# all of it
name: x
packages:
  - 'packages/*'  # two
  - "apps/**"
  - tools/one

catalog:
  - no
"""
    assert manifests.yaml_patterns(text) == ["packages/*", "apps/**", "tools/one"]
    assert manifests.yaml_patterns("packages: [ 'a/*', b, \"c,d\" ]") == ["a/*", "b", "c,d"]
    for bad in ("packages:\n  x: y", "packages: {a: b}", "packages:\n  - &x y"):
        with pytest.raises(ValueError):
            manifests.yaml_patterns(bad)
    rows = [("package.json", '{"name": "a"}'), ("p/one/package.json", '{"name": "b"}'), ("p/two/package.json", '{"name": "b"}'), ("q/package.json", "[]")]
    read = manifests.manifests(spark.createDataFrame(rows, "path string, text string"))
    assert sorted(r.root for r in manifests.workspace_packages(read, ["p/one", "q"]).collect()) == ["", "p/one", "q"]
    with pytest.raises(ValueError):
        manifests.workspace_packages(read, ["p/*"])


def test_module_targets_never_pass_the_driver(spark):
    rows = [
        ("package.json", '{"name": "root", "main": "lib/a.js"}'),
        ("p/package.json", '{"name": "p", "exports": {".": {"require": "./c.cjs", "import": "./m.js"}, "./x": "./x.js", "./k/*": "./lib/*.js"}}'),
        ("p/q/package.json", '{"name": "@s/q", "exports": {"./*": "./*.mjs"}}'),
        ("p/none/package.json", '{"name": "none", "main": "gone.js"}'),
        ("r/package.json", '{"main": "lib/b.js"}'),  # its files are its own, though it has no name
    ]
    paths = ["lib/a.ts", "p/c.cts", "p/m.ts", "p/x.js", "p/x.ts", "p/lib/a.tsx", "p/lib/deep/b.js", "p/lib/b.css", "p/q/one.mts", "p/q/two.js", "r/lib/b.js"]
    packages = manifests.manifests(spark.createDataFrame(rows, "path string, text string"))
    files = spark.createDataFrame([(x,) for x in paths], "path string")
    found = manifests.module_targets(packages, files)
    got = {(r.package, r.specifier): (r.esm, r.common_js) for r in found.collect()}
    assert got == {
        ("root", "root"): (["lib/a.ts"], ["lib/a.ts"]),
        ("p", "p"): (["p/m.ts"], ["p/c.cts"]),
        ("p", "p/x"): (["p/x.js"], ["p/x.js"]),
        ("p", "p/k/a"): (["p/lib/a.tsx"], ["p/lib/a.tsx"]),
        ("p", "p/k/deep/b"): (["p/lib/deep/b.js"], ["p/lib/deep/b.js"]),
        ("@s/q", "@s/q"): ([], []),
        ("@s/q", "@s/q/one"): (["p/q/one.mts"], ["p/q/one.mts"]),
        ("none", "none"): ([], []),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nearest_roots_meet_no_distinct(spark):
    paths = spark.createDataFrame([("a.js",), ("p/x/a.js",), ("p/a.js",), (None,)], "path string")
    roots = spark.createDataFrame([("p",), ("p",), ("p/x",), ("q",), (None,)], "root string")
    found = workspaces.nearest(paths, roots)
    assert sorted(map(tuple, found.collect()), key=str) == [("a.js", None), ("p/a.js", "p"), ("p/x/a.js", "p/x"), (None, None)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_manifests_are_read_once_for_module_targets(spark):
    found = catalog_projects.workspace_module_targets(spark, SMALL)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_profiles_and_configurations_that_can_not_be(spark):
    schema = "name string, parent string, conditions array<string>, world string"
    for rows in ([("a", "b", ["x"], None)], [("a", "b", [], None), ("b", "a", [], None)]):
        with pytest.raises(ValueError):
            manifests.resolved_profiles(spark.createDataFrame(rows, schema)).collect()
    files = [("a/tsconfig.json", '{"extends": "../b/tsconfig.json"}'), ("b/tsconfig.json", '{"extends": "../a/tsconfig.json"}')]
    with pytest.raises(ValueError):
        manifests.configurations(spark.createDataFrame(files, "path string, text string"))


def test_plugin_contracts(spark):
    good = {"id": "my-kit", "version": "1.2.3", "displayName": "Kit", "packages": ["kit"], "configs": {"kit.config": "js ts"}, "entries": ["src/*.kit.ts"]}
    assert [r[2:4] for r in plugins.validated(good)] == [("config", "kit.config.js"), ("config", "kit.config.ts"), ("entry", "src/*.kit.ts"), ("package", "kit")]
    for wrong in ({"id": "My"}, {"version": "1"}, {"capabilities": ["fly"]}, {"entries": ["../x"]}, {"entries": ["/x"]}, {"rules": [{"rule": "file_edge", "value": "a", "other": "!b"}]}):
        with pytest.raises(ValueError):
            plugins.validated({**good, **wrong})
    files = spark.createDataFrame([("w", f"w/src/{i}.ts", f"src/{i}.ts") for i in range(20)], "workspace string, path string, relative string")
    found = spark.createDataFrame([("w", "k")], "workspace string, plugin string")
    rules = spark.createDataFrame([("k", "K", "file_edge", "src/*.ts", "src/*.ts", "all")], plugins.RULES)
    made, over = plugins.edges(files, found, rules)
    assert made.count() == 0 and [(r.code, r.blocks) for r in over.collect()] == [("plugin_pattern_limit_exceeded", True)]
    assert plugins.edges(files, found, rules, most=400)[0].count() == 400


def test_scripts():
    assert projects.shell_words("a 'b c' \"d $E\" && f\\ g # note") == [[("a", False), ("b c", False), ("d $E", True)], [("f g", False)]]
    assert projects.script_references("NODE_ENV=x cross-env node ./tools/a.js && npm run lint; npx tsc -p . | sh -c 'jest --ci'") == [("file", "tools/a.js"), ("script", "lint"), ("binary", "tsc"), ("binary", "jest")]
    scripts = {"build": "npm run a && run-p b c", "prebuild": "x", "a": "tsc", "b": "y", "unused": "z"}
    assert projects.reachable_scripts(scripts, ["build"]) == ["a", "b", "build", "prebuild"]
    assert projects.reachable_scripts(scripts) == sorted(scripts)


def test_universe(spark, tmp_path):
    at = tmp_path / "files.json"
    at.write_text('{"entry": "a.js", "files": ["a.js", "b.js"]}')
    entries, files = projects.universe(spark, str(at))
    assert [r.path for r in entries.collect()] == ["a.js"] and files.count() == 2
    at.write_text('{"entry": "z.js", "files": ["a.js"]}')
    with pytest.raises(ValueError):
        projects.universe(spark, str(at))


def test_source_files(spark, tmp_path):
    for p in ("src/a.ts", "src/gen/b.js", "node_modules/x/c.js", "d.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    found = projects.source_files(spark, str(tmp_path), ["src/gen/"])
    assert [r.path for r in found.collect()] == ["src/a.ts"]
    with pytest.raises(ValueError):
        projects.source_files(spark, str(tmp_path), limit=1)
