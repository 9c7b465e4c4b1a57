"""End to end on small universes, warm against cold, and as a stream."""

from taproot.plans.scan import scan
from taproot.sources.cache import FactCache
from taproot.streaming.incremental import watch

FILES = {
    "src/index.ts": 'import { used } from "./lib.js"; import "pkg"; import "./data/";',
    "src/lib.ts": "export const used = 1, unused = 2;",
    "src/data/index.js": "",
    "src/dead-a.js": 'import "./dead-b";',
    "src/dead-b.js": 'import "./dead-a";',
    "src/alone.js": "import './lib';",
    "package.json": '{"private": true, "dependencies": {"pkg": "1"}}',
}


def frames(spark, files, entry="src/index.ts"):
    return spark.createDataFrame(list(files.items()), "path string, text string"), spark.createDataFrame([("default", entry)], "profile string, path string")


def result(report):
    return {r.path: r.status for r in report.files.collect()}, sorted(list(r.paths) for r in report.findings.collect())


def test_scan(spark):
    report = scan(*frames(spark, FILES))
    status, found = result(report)
    assert {p for p, s in status.items() if s == "reachable"} == {"src/index.ts", "src/lib.ts", "src/data/index.js"}
    assert found == [["src/alone.js"], ["src/dead-a.js", "src/dead-b.js"]]
    imports = {(r.path, r.specifier): (r.status, r.target) for r in report.imports.collect()}
    assert imports[("src/index.ts", "./lib.js")] == ("resolved", "src/lib.ts")
    assert imports[("src/index.ts", "pkg")] == ("external", None)
    assert report.why("src/lib.ts") == ["src/index.ts", "src/lib.ts"] and report.why("src/alone.js") == []


def test_missing_coverage_is_no_evidence(spark):
    for text in ("import('./' + name)", "function f() { import('./lib') }", "import './nowhere'", "import {"):
        status, found = result(scan(*frames(spark, {**FILES, "src/lib.ts": text})))
        assert found == [] and "unreachable" not in status.values()
    # a blocker on a file that nothing reaches proves nothing either way
    assert result(scan(*frames(spark, {**FILES, "src/alone.js": "import(x)"})))[1] == [["src/alone.js"], ["src/dead-a.js", "src/dead-b.js"]]


def test_imports_beside_the_universe(spark):
    """Aliases, assets, formats that are not read, runtime modules and packages that nobody declares."""
    base = {"src/a.ts": "", "src/b.ts": "", "src/look.css": "", "src/part.vue": "", "src/bin.node": "", "tsconfig.json": '{ // note\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}} }'}

    def of(text, **more):
        report = scan(*frames(spark, {**base, **more, "src/a.ts": text}, "src/a.ts"))
        status, found = result(report)
        return [(r.status, r.target) for r in report.imports.collect()], status["src/b.ts"], found, {r.code for r in report.diagnostics.collect()}

    # one scan of many imports, each from a file of its own
    lines = {"alias": 'import "@/b";', "asset": 'import "./look.css";', "vue": 'import "./part.vue";', "node": 'import "./bin.node";', "query": 'import "./b.js?worker";', "builtin": 'import "node:fs";', "bare": 'import "right-pad";', "declared": 'import "left-pad/x";', "kit": 'import "@k/one";', "deep": 'import "@k/one/x";', "none": 'import "@k/one/none";', "out": 'import "../../x";'}
    kit = {"package.json": '{"dependencies": {"left-pad": "^1"}, "workspaces": ["kits/*"]}', "kits/one/package.json": '{"name": "@k/one", "main": "lib/i.js", "exports": {".": {"node": "./lib/i.js"}, "./*": "./lib/*.js"}}', "kits/one/lib/i.ts": "", "kits/one/lib/x.ts": ""}
    report = scan(*frames(spark, {**base, **kit, **{f"src/{k}.ts": v for k, v in lines.items()}}, "src/a.ts"))
    got = {r.path[4:-3]: (r.status, r.target, r.code) for r in report.imports.collect()}
    assert got == {
        "alias": ("resolved", "src/b.ts", None), "asset": ("external", None, None), "vue": ("unsupported", None, "unsupported_imported_source"), "node": ("unsupported", None, "unsupported_imported_source"),
        "query": ("resolved", "src/b.ts", None), "builtin": ("external", None, None), "bare": ("unsupported", None, "unsupported_specifier"), "declared": ("external", None, None),
        "kit": ("resolved", "kits/one/lib/i.ts", None), "deep": ("resolved", "kits/one/lib/x.ts", None), "none": ("unresolved", None, "unresolved_import"), "out": ("unresolved", None, "unresolved_import"),
    }
    assert of('import "@/b";') == ([("resolved", "src/b.ts")], "reachable", [], set())
    assert of('import "./look.css";')[:3] == ([("external", None)], "unreachable", [["src/b.ts"]])
    assert of('import "./part.vue";')[1:] == ("incomplete", [], {"unsupported_imported_source"})


def test_exports_and_declarations(spark):
    """Recursion without a live root is dead; what an entry, a star or a namespace uses is not."""
    base = {
        "src/index.ts": 'import { run } from "./graph.js"; import * as all from "./kit"; console.log(run(), all.one);',
        "src/graph.ts": "export function run() { return leaf(); } function leaf() { return 1; } export function deadA() { return deadB(); } export function deadB() { return deadA(); } const lone = () => { return 2; };",
        "src/kit.ts": 'export * from "./parts"; export { made as other } from "./more";',
        "src/parts.ts": "export const one = 1; export interface Shape { a: Size } type Size = 1; export function quiet() { eval('x'); }",
        "src/more.ts": "export const made = 1; export const spare = 2;",
    }

    def of(files, **options):
        report = scan(*frames(spark, files, "src/index.ts"), **options)
        exports, declarations = report.symbol_findings()
        return sorted((r.path, r.exported) for r in exports.collect()), sorted((r.symbols, r.cyclic) for r in declarations.collect())

    assert of(base) == ([("src/graph.ts", "deadA"), ("src/graph.ts", "deadB"), ("src/more.ts", "spare")], [("deadA, deadB", True), ("lone", False), ("spare", False)])
    # missing coverage is no evidence here either
    assert of({**base, "src/more.ts": base["src/more.ts"] + " import(x);"}) == ([], [])
    contract = {**base, "src/index.ts": base["src/index.ts"] + ' export { spare } from "./more"; export const own = 1;'}
    assert ("src/index.ts", "own") in of(contract)[0] and ("src/index.ts", "own") not in of(contract, open_world=True)[0]
    assert ("spare", False) not in of(contract, open_world=True)[1]


def test_cache(spark, tmp_path):
    cache = FactCache(f"file://{tmp_path}/cache", keep=2)
    sources, entries = frames(spark, FILES)
    cold = result(scan(sources, entries, cache))
    assert result(scan(sources, entries, cache)) == cold and len(cache.snapshots(spark)) == 1
    for i in range(3):
        changed = {**FILES, "src/alone.js": "//" + "x" * i, "src/new.js": ""}
        warm = result(scan(*frames(spark, changed), cache))
        assert warm == result(scan(*frames(spark, changed)))
    assert len(cache.snapshots(spark)) == 2
    # a change that leaves a file's imports alike has the report of before
    same = {**FILES, "src/alone.js": "import './lib'; // more"}
    assert result(scan(*frames(spark, same), cache)) == cold
    assert result(scan(*frames(spark, {**same, "src/alone.js": ""}), cache))[1] == [["src/alone.js"], ["src/dead-a.js", "src/dead-b.js"]]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([(p, t, 1) for p, t in FILES.items()], "path string, text string, version long")
    rows.write.parquet(f"{tmp_path}/in/one")
    seen = []

    def run():
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        watch(stream, f"{tmp_path}/table", frames(spark, FILES)[1], FactCache(f"file://{tmp_path}/cache"), f"{tmp_path}/state", lambda r, n: seen.append(result(r)[1])).awaitTermination()

    run()
    spark.createDataFrame([("src/alone.js", None, 2), ("src/dead-a.js", "", 2)], rows.schema).write.parquet(f"{tmp_path}/in/two")
    run()
    assert seen == [[["src/alone.js"], ["src/dead-a.js", "src/dead-b.js"]], [["src/dead-a.js"], ["src/dead-b.js"]]]
