"""One scan, from source text to report: facts, resolution, graph, status, findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot.operators import files, graph, modules, symbols
from taproot.sources import jsfacts, manifests
from taproot.sources.cache import FactCache, digest_of


@dataclass
class Report:
    files: DataFrame  # profile, path, status
    imports: DataFrame  # path, specifier, mode, deferred, status, target, targets, code, blocks
    findings: DataFrame  # profile, paths, n, summary
    diagnostics: DataFrame  # path, code, message, blocks
    edges: DataFrame  # profile, src, dst
    entries: DataFrame
    facts: DataFrame | None = None  # nested facts of the sources
    open_world: bool = False

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("files", "imports", "findings", "diagnostics", "edges", "entries")}

    @property
    def summary(self) -> DataFrame:
        return files.status_summary(self.files)

    def symbol_findings(self) -> tuple[DataFrame, DataFrame]:
        """(path, exported, usage) of unused exports, and (symbols, n, cyclic, paths) of dead declarations; computed when asked for."""
        return _symbol_findings(self)

    def why(self, path: str) -> list[str]:
        """A shortest chain of files from an entry to a reachable file, else nothing."""
        found = graph.discovery(self.edges, self.entries.withColumn("position", F.col("path")))
        rows = {r.path: r for r in found.where("profile is not null").select("path", "parent", "rank").collect()} if found is not None else {}
        chain = []
        while path in rows:
            chain.append(path)
            path = rows[path].parent
        return chain[::-1]


def scan(sources: DataFrame, entries: DataFrame, cache: FactCache | None = None, discovered: bool = False, open_world: bool = False) -> Report:
    """``sources(path, text)`` are all files that exist; ``entries(profile, path)`` its roots.

    Files with a source extension are the universe.  Others are what imports may
    lead to beside it: assets, manifests (the root one declares external packages,
    those of workspaces map their names to files) and configurations (path aliases).
    Loads that run later, or can't be read, make no edge and block their profile
    once their file is reachable; so does an import without a target, unless it is
    a declared package or a runtime module.  With ``open_world`` the exports of
    entries are a public contract.
    """
    code = sources.where(modules.analyzable(F.col("path")))
    rest = sources.where(~modules.analyzable(F.col("path")))
    if cache is None:
        return _scanned(graph.checkpointed(jsfacts.extracted(code)), rest, entries, discovered, open_world)
    spark = sources.sparkSession
    facts = cache.facts(code)
    said = facts.select("path", F.to_json(F.struct(*[_parts(n, fields).alias(n) for n, fields in _SAID.items()])).alias("said"))
    around = rest.select("path", F.when(F.col("path").rlike(_READ), F.col("text")).alias("said"))
    roots = entries.select("path", F.concat(F.lit("entry of "), "profile").alias("said"))
    key = digest_of(said.union(around).union(roots).union(spark.range(1).select(F.lit(""), F.lit(f"{discovered} {open_world}"))))
    held = cache.report(spark, key) or cache.keep_report(spark, key, _scanned(facts, rest, entries, discovered, open_world).tables())
    return Report(**held, facts=facts, open_world=open_world)


#: What a report follows from, of each nested column of facts.
_SAID = {
    "imports": ("specifier", "kind", "activation"),
    "exports": ("exported", "source", "imported", "local", "kind", "type_only"),
    "bindings": ("source", "imported", "local", "kind", "type_only"),
    "diagnostics": ("code", "message", "blocks"),
    "symbols": ("name", "kind"),
    "refs": ("owner", "name", "usage"),
    "guards": ("kind",),
}
_READ = "(?:^|/)(?:package|[jt]sconfig[^/]*)\\.json$"


def _parts(name: str, fields: tuple[str, ...]) -> Column:
    return F.transform(name, lambda x: F.struct(*[x[c] for c in fields]))


def _scanned(facts: DataFrame, rest: DataFrame, entries: DataFrame, discovered: bool, open_world: bool) -> Report:
    spark = facts.sparkSession
    paths = facts.select("path")
    found = jsfacts.table(facts, "imports")
    mode = F.when(F.startswith("kind", F.lit("common_js")), "common_js").otherwise("esm")
    imports = found.groupBy("path", "specifier", mode.alias("mode")).agg(F.bool_and(F.col("activation") == "deferred").alias("deferred"))
    imports = graph.checkpointed(imports)

    texts = graph.checkpointed(rest.where(F.col("path").rlike(_READ)))
    aliases = configs = None
    declared = spark.createDataFrame([], "package string")
    targets = spark.createDataFrame([], "package string, specifier string, esm array<string>, common_js array<string>")
    if not texts.isEmpty():
        read = graph.checkpointed(manifests.manifests(texts))
        configs = manifests.configurations(texts)
        aliases = manifests.aliases(configs)
        declared = manifests.declarations(read.where("root = ''")).select("package").distinct()
        patterns = [r[0] for r in read.where("root = ''").select(F.explode("workspaces")).distinct().collect()]  # patterns of one manifest
        targets = graph.checkpointed(manifests.module_targets(manifests.workspace_packages(read, patterns), paths, configs))
    places = modules.candidates(imports, configs, aliases)
    resolved = graph.checkpointed(modules.ladder(imports, places, paths, rest.select("path"), declared, targets, discovered))

    profiles = entries.select("profile").distinct()
    edges = profiles.join(modules.edges(resolved))
    diagnostics = jsfacts.table(facts, "diagnostics").select("path", "code", "message", "blocks").union(modules.diagnostics(resolved))
    fatal = diagnostics.where(F.col("code").isin("parse_failure", "source_too_large")).select("path", F.lit(True).alias("fatal")).distinct()
    universe = paths.join(fatal, "path", "left").select("path", F.lit(".").alias("workspace"), F.coalesce("fatal", F.lit(False)).alias("fatal"))
    blockers = profiles.join(diagnostics.where("blocks").select("path").distinct())
    status = graph.checkpointed(files.file_status(universe, entries, edges, blockers, profiles))
    return Report(status, resolved, files.unreachable_findings(status, edges), diagnostics, edges, entries, facts, open_world)


def _symbol_findings(report: Report) -> tuple[DataFrame, DataFrame]:
    """Unused exports and dead declarations of files that some profile reaches; none if a reachable file blocks."""
    facts, resolved, entries, open_world = report.facts, report.imports, report.entries, report.open_world
    live = graph.checkpointed(report.files.where("status = 'reachable'").select("path").distinct())
    certain = report.diagnostics.where("blocks").join(live, "path", "left_semi").isEmpty()
    guards = jsfacts.table(facts, "guards")
    exports = jsfacts.table(facts, "exports").drop("start", "end")
    where = jsfacts.table(facts, "imports").select("path", "specifier", "start", "end").join(resolved.select("path", "specifier", "status", "target"), ["path", "specifier"])
    bindings = jsfacts.table(facts, "bindings")
    tied = graph.checkpointed(modules.symbol_links(bindings, exports, where))
    refs = jsfacts.table(facts, "refs")
    inner = refs.where("owner is not null").select(F.col("path").alias("src_path"), F.col("owner").alias("src_symbol"), F.col("path").alias("dst_path"), F.col("name").alias("dst_symbol"), "usage")
    links = inner.unionByName(tied.drop("src_usage"))
    # What a guard hides may use every symbol of its file.
    known = jsfacts.table(facts, "symbols").select("path", F.col("name").alias("symbol"), "name", "kind")
    hidden = known.join(guards.where("kind <> 'opaque_common_js_exports'").select("path").distinct(), "path", "left_semi")
    roots = refs.where("owner is null").select("path", F.col("name").alias("symbol"), "usage").union(hidden.select("path", "symbol", F.lit("runtime"))).join(live, "path", "left_semi")
    world = entries.select("path").distinct() if open_world else entries.select("path").limit(0)
    if open_world:
        own = exports.where("local is not null").join(world, "path", "left_semi").select("path", F.col("local").alias("symbol"), F.when(F.col("type_only"), "type").otherwise("runtime").alias("usage"))
        roots = roots.union(own).union(modules.open_world_roots(exports, where, world))
    lanes = graph.checkpointed(symbols.liveness(known, links, roots))
    groups = symbols.dead_groups(lanes.join(live, "path", "left_semi"), links)
    opaque = guards.where("kind = 'opaque_common_js_exports'").select("path").distinct()
    used = exports.select("path", "exported", "local", F.when(F.col("type_only"), "type").otherwise("runtime").alias("usage")).join(opaque, "path", "left_anti")
    unused = symbols.unused_exports(used, tied, live, world).select("path", "exported", "usage").distinct()
    return unused.where(F.lit(certain)), groups.where(F.lit(certain))
