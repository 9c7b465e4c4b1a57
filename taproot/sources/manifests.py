"""Manifests and project configurations as tables: one row a file, nested, and flat tables from it.

Every function takes a table of files (path, text); texts are parsed in Arrow
batches on the executors, so a monorepo's manifests never meet on the driver.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions import globs, scalars
from taproot.operators import graph
from taproot.operators.workspaces import ancestors, nearest
from taproot.sources.projects import by_priority, conditional, without_comments

#: The conditions of each kind of entry, and the fields that it falls back to, in order.
ENTRY_KINDS = {
    "node_import": (("node", "import"), ("main",)),
    "node_require": (("node", "require"), ("main",)),
    "bundler": (("import", "module"), ("module", "main")),
    "browser": (("browser", "import"), ("browser", "module", "main")),
    "types": (("types",), ("types", "typings")),
}

#: A manifest's dependency maps and their categories.
DEPENDENCY_MAPS = {"dependencies": "runtime", "devDependencies": "development", "peerDependencies": "peer", "optionalDependencies": "optional"}

#: Lock files and install markers, and the managers that leave them.
LOCKFILES = {
    "package-lock.json": "npm", "npm-shrinkwrap.json": "npm", "pnpm-lock.yaml": "pnpm", "pnpm-workspace.yaml": "pnpm",
    "yarn.lock": "yarn", ".pnp.cjs": "yarn", ".pnp.loader.mjs": "yarn", "bun.lock": "bun", "bun.lockb": "bun",
}

_PAIR = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_MANIFEST = pa.schema(
    [
        ("path", pa.string()),
        ("root", pa.string()),
        ("error", pa.string()),
        ("name", pa.string()),
        ("private", pa.bool_()),
        ("manager", pa.string()),
        ("workspaces", pa.list_(pa.string())),
        ("dependencies", pa.list_(pa.struct([("package", pa.string()), ("requirement", pa.string()), ("category", pa.string())]))),
        ("bundled", pa.list_(pa.string())),
        ("binaries", _PAIR),
        ("scripts", _PAIR),
        ("entries", pa.list_(pa.struct([("kind", pa.string()), ("field", pa.string()), ("target", pa.string()), ("safe", pa.bool_())]))),
        ("subpaths", pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string()), ("target", pa.string())]))),
    ]
)
_SPARK = (
    "path string, root string, error string, name string, private boolean, manager string, workspaces array<string>, dependencies array<struct<package:string,requirement:string,category:string>>, bundled array<string>, "
    "binaries array<struct<key:string,value:string>>, scripts array<struct<key:string,value:string>>, entries array<struct<kind:string,field:string,target:string,safe:boolean>>, subpaths array<struct<kind:string,key:string,target:string>>"
)


def folder(path: str) -> str:
    return path.rpartition("/")[0]


def _texts(value) -> dict[str, str]:
    return {k: v for k, v in value.items() if isinstance(v, str)} if isinstance(value, dict) else {}


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def safe_entry(target: str) -> bool:
    """Whether a target stays inside its package."""
    plain = target.removeprefix("./")
    return bool(plain) and not plain.startswith("/") and ".." not in plain.split("/")


def entry_targets(manifest: dict, kind: str) -> list[tuple[str, str]]:
    """(field, target) of a manifest's roots for one kind of entry, each once, in order.

    Exports win; their conditions are tried by the kind's priority.  Only without
    a target there does the first field that is set count.
    """
    if kind == "command_line":
        binary = manifest.get("bin")
        return list(dict.fromkeys(("bin", t) for t in ([binary] if isinstance(binary, str) else [v for _, v in sorted(_texts(binary).items())])))
    conditions, fields = ENTRY_KINDS[kind]
    exports = manifest.get("exports")
    if isinstance(exports, dict) and any(k.startswith(".") for k in exports):
        exports = exports.get(".")
    if found := by_priority(exports, conditions):
        return [("exports", t) for t in dict.fromkeys(found)]
    return next(([(f, manifest[f])] for f in fields if isinstance(manifest.get(f), str)), [])


def subpath_targets(manifest: dict, kind: str, conditions: set[str] = frozenset()) -> list[tuple[str, str]]:
    """(key, target) of ``./x`` exports: of each value's keys the first in their own order that is active."""
    exports = manifest.get("exports")
    if not isinstance(exports, dict):
        return []
    active = set(conditions) | set(ENTRY_KINDS.get(kind, ((), ()))[0])
    return [(k, t) for k, v in exports.items() if k.startswith("./") for t in conditional(v, active)]


def _manifest(path: str, text: str | None, conditions: set[str]) -> dict:
    row = {"path": path, "root": folder(path), "error": None, "name": None, "private": False, "manager": None} | {k: [] for k in ("workspaces", "dependencies", "bundled", "binaries", "scripts", "entries", "subpaths")}
    try:
        data = json.loads((text or "").removeprefix("\ufeff"))
    except ValueError as e:
        return row | {"error": str(e)}
    if not isinstance(data, dict):
        return row | {"error": "not an object"}
    spaces = data.get("workspaces")
    spaces = spaces.get("packages") if isinstance(spaces, dict) else spaces
    bundled = data.get("bundledDependencies", data.get("bundleDependencies"))
    binary = data.get("bin")
    if isinstance(binary, str):
        binary = {(_text(data.get("name")) or folder(path)).rpartition("/")[2]: binary}
    return row | {
        "name": _text(data.get("name")),
        "private": data.get("private") is True,
        "manager": _text(data.get("packageManager")),
        "workspaces": [x for x in spaces if isinstance(x, str)] if isinstance(spaces, list) else [],
        "dependencies": [{"package": k, "requirement": v, "category": c} for m, c in DEPENDENCY_MAPS.items() for k, v in _texts(data.get(m)).items()],
        "bundled": [x for x in bundled if isinstance(x, str)] if isinstance(bundled, list) else [],
        "binaries": [{"key": k, "value": v} for k, v in _texts(binary).items()],
        "scripts": [{"key": k, "value": v} for k, v in _texts(data.get("scripts")).items()],
        "entries": [{"kind": kind, "field": f, "target": t.removeprefix("./"), "safe": safe_entry(t)} for kind in (*ENTRY_KINDS, "command_line") for f, t in entry_targets(data, kind)],
        "subpaths": [{"kind": kind, "key": k, "target": t.removeprefix("./")} for kind in ENTRY_KINDS for k, t in subpath_targets(data, kind, conditions)],
    }


def manifests(files: DataFrame, conditions: set[str] = frozenset()) -> DataFrame:
    """One row a ``package.json`` of ``files(path, text)``; one that isn't JSON has its error and nothing else."""

    def run(batches):
        for batch in batches:
            rows = [_manifest(p, t, conditions) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, _MANIFEST)

    return files.where(F.col("path").rlike("(?:^|/)package\\.json$")).select("path", "text").mapInArrow(run, _SPARK)


def declarations(read: DataFrame) -> DataFrame:
    """(root, package, requirement, category, bundled): a row for each map that names a package."""
    rows = read.select("root", "bundled", F.explode("dependencies").alias("d"))
    return rows.select("root", "d.package", "d.requirement", "d.category", F.array_contains("bundled", F.col("d.package")).alias("bundled"))


def grouped_declarations(declared: DataFrame) -> DataFrame:
    """(root, package, categories, alias_targets, bundled): one row a package of a workspace."""
    rows = declared.withColumn("alias", scalars.npm_alias_target(F.col("requirement")))
    return rows.groupBy("root", "package").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("alias_targets"), F.bool_or("bundled").alias("bundled"))


def alias_owners(declared: DataFrame) -> DataFrame:
    """(root, target, package): packages declared under another name, where just one declaration aliases them."""
    rows = declared.withColumn("target", scalars.npm_alias_target(F.col("requirement"))).where("target is not null")
    return rows.groupBy("root", "target").agg(F.collect_set("package").alias("p")).where(F.size("p") == 1).select("root", "target", F.col("p")[0].alias("package"))


def declared_names(read: DataFrame) -> DataFrame:
    """(package): all that any manifest declares, and the names of the packages themselves."""
    return declarations(read).select("package").union(read.where("name is not null").select("name")).distinct()


def installed_binaries(declared: DataFrame, read: DataFrame) -> DataFrame:
    """(root, binary, package): binaries of installed dependencies, from ``node_modules`` manifests of ``read``."""
    own = declared.where("category <> 'peer'").select("root", "package").distinct()
    at = own.select("root", "package", F.concat(F.when(F.col("root") == "", F.lit("")).otherwise(F.concat("root", F.lit("/"))), F.lit("node_modules/"), "package").alias("place"))
    found = read.select(F.col("root").alias("place"), F.explode("binaries").alias("b"))
    return at.join(found, "place").groupBy("root", F.col("b.key").alias("binary")).agg(F.max("package").alias("package"))


def managers(marks: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, selected, candidates) of ``marks(key, name)``, file names beside a manifest, and ``declared(key, declared)``.

    The declared manager wins; else it is the one that all lock files agree on.
    """
    by = F.create_map(*[F.lit(x) for pair in LOCKFILES.items() for x in pair])
    found = marks.withColumn("m", F.element_at(by, F.col("name"))).groupBy(key).agg(F.array_sort(F.collect_set("m")).alias("all")).join(declared, key, "left")
    plain = F.split("declared", "@").getItem(0)
    return found.select(key, F.coalesce(plain, F.when(F.size("all") == 1, F.col("all")[0])).alias("selected"), F.array_join("all", ",").alias("candidates"))


def yaml_patterns(text: str) -> list[str]:
    """The ``packages`` list of a pnpm workspace file: a block or an inline array of plain or quoted strings."""
    out, inside = [], None
    for line in text.splitlines():
        plain = re.sub(r"""^((?:"[^"]*"|'[^']*'|[^"'#])*?)(?:(?:^|(?<=\s))\#.*)?$""", r"\1", line).rstrip()
        if not plain.strip():
            continue
        indent, body = len(plain) - len(plain.lstrip()), plain.strip()
        if inside is None:
            if body.startswith("packages:"):
                inside, rest = indent, body[len("packages:") :].strip()
                if rest:
                    if not (rest.startswith("[") and rest.endswith("]")):
                        raise ValueError("an inline list of packages stands in brackets")
                    out += [_scalar(m[0].strip()) for m in re.finditer(r"""(?:"[^"]*"|'[^']*'|[^,"'])+""", rest[1:-1]) if m[0].strip()]
            continue
        if indent <= inside:
            break
        if not body.startswith("-"):
            raise ValueError("packages is a list of patterns only")
        out.append(_scalar(body[1:].strip()))
    return out


def _scalar(value: str) -> str:
    if value.startswith('"'):
        return json.loads(value)
    if value.startswith("'") and value.endswith("'") and len(value) > 1:
        return value[1:-1].replace("''", "'")
    if not value or re.search(r"[&{}\[\]]", value):
        raise ValueError(f"not a plain pattern: {value!r}")
    return value


def workspace_packages(read: DataFrame, patterns: list[str]) -> DataFrame:
    """The manifests that belong to the workspace: the root one and those whose folder the patterns take.

    Patterns come from configuration, so they are few.  Two packages of one name are an error.
    """
    member = (F.col("root") == "") | globs.ignored(F.concat("root", F.lit("/")), patterns)
    packages = read.where(member)
    twice = packages.where("name is not null").groupBy("name").count().where("count > 1").select("name").head(1)
    if twice:
        raise ValueError(f"two packages are called {twice[0][0]}")
    return packages


def module_targets(packages: DataFrame, files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """(package, specifier, esm, common_js): what imports of workspace packages mean, as files of the universe.

    Entry roots answer for the name itself, ``./x`` exports for name/x; a ``*`` in
    both key and target stands for what a file's emitted path holds there.  A
    package without any has a row without paths.  ``packages`` is read several
    times.  Spark takes exploded paths and parsed texts for far smaller than they
    are, so joins are sort-merge joins: no package or file passes the driver.
    """
    named = packages.where("name is not null").select("name", "root", "entries", "subpaths")
    base = F.when(F.col("root") == "", F.lit("")).otherwise(F.concat("root", F.lit("/")))
    own = named.select("name", F.col("name").alias("specifier"), base.alias("base"), F.posexplode("entries").alias("n", "e")).select("name", "specifier", "n", F.col("e.kind").alias("kind"), F.concat("base", "e.target").alias("place"))
    sub = named.select("name", "root", base.alias("base"), F.posexplode("subpaths").alias("n", "e")).select("name", "root", (F.col("n") + 100_000).alias("n"), "e.*", "base")
    stars = F.length(F.regexp_replace("key", "[^*]", "")), F.length(F.regexp_replace("target", "[^*]", ""))
    tail = F.regexp_replace("key", r"^(?:\./)+", "")
    plain = sub.where((stars[0] == 0) & (stars[1] == 0)).select("name", F.concat("name", F.lit("/"), tail).alias("specifier"), "n", "kind", F.concat("base", "target").alias("place"))
    direct = mapped_entries(own.unionByName(plain), files, configs)
    # Wildcards: files meet only the patterns of their own package.
    wild = sub.where((stars[0] == 1) & (stars[1] == 1)).withColumn("pattern", F.concat("base", "target"))
    homes = nearest(files.select("path").hint("merge"), packages.select("root").hint("merge"), "root").where("root is not null")
    emitted = homes.select("root", "path", F.explode(F.array_distinct(F.array(F.col("path"), scalars.runtime_output(F.col("path"))))).alias("out"))
    before, after = F.expr("substring(pattern, 1, instr(pattern, '*') - 1)"), F.expr("substring(pattern, instr(pattern, '*') + 1)")
    both = wild.hint("merge").join(emitted, "root").withColumn("before", before).withColumn("after", after)
    both = both.where(F.startswith("out", F.col("before")) & F.endswith("out", F.col("after")) & (F.length("out") >= F.length("before") + F.length("after")))
    held = F.expr("substring(out, length(before) + 1, length(out) - length(before) - length(after))")
    starred = both.select("name", F.concat("name", F.lit("/"), F.replace(tail, F.lit("*"), held)).alias("specifier"), "n", "kind", "path")
    # Each name itself has a row, with or without paths.
    lone = named.select("name", F.col("name").alias("specifier"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("path"))
    rows = direct.select("name", "specifier", "n", "kind", "path").union(starred).union(lone)

    def paths(test: Column) -> Column:
        ordered = F.array_sort(F.collect_set(F.when(test, F.struct("n", "path"))))
        return F.array_distinct(F.transform(ordered, lambda x: x["path"]))

    return rows.groupBy(F.col("name").alias("package"), "specifier").agg(paths(F.col("kind") != "node_require").alias("esm"), paths(F.col("kind") == "node_require").alias("common_js"))


def entry_variants(place: Column) -> Column:
    """Sources that an entry path may come from, in order: itself, or another extension of its stem."""
    e = F.regexp_extract(place, r"[^/]\.([^./]*)$", 1)
    stem = F.when(e == "", place).otherwise(F.regexp_replace(place, r"\.[^./]*$", ""))
    names = F.when(e == "js", F.array(*map(F.lit, ("ts", "tsx", "js", "jsx")))).when(e == "mjs", F.array(F.lit("mts"), F.lit("mjs"))).when(e == "cjs", F.array(F.lit("cts"), F.lit("cjs")))
    names = names.when(e == "", F.array(*map(F.lit, ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_sort(F.array_distinct(F.concat(F.array(place), F.transform(names, lambda x: F.concat(stem, F.lit("."), x)))))


def mapped_entries(entries: DataFrame, files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """``entries(place, ...)`` with path: the first source variant that is a file, or one below the root folder of an output folder."""
    rows = entries.withColumn("_place", scalars.normal_path(F.col("place")))
    places = rows.select("_place").distinct()
    tries = places.select("_place", F.lit(0).alias("config"), F.posexplode(entry_variants(F.col("_place"))).alias("rank", "path"))
    if configs is not None:
        dirs = configs.where("out_dir is not null and root_dir is not null").select("out_dir", "root_dir", F.col("path").alias("by")).distinct()
        moved = places.select("_place", F.explode(ancestors(F.col("_place"))).alias("out_dir")).join(dirs, "out_dir")
        rest = F.expr("substring(_place, length(out_dir) + case when out_dir = '' then 1 else 2 end)")
        source = F.when(F.col("root_dir") == "", rest).otherwise(F.concat("root_dir", F.lit("/"), rest))
        order = F.dense_rank().over(Window.partitionBy("_place").orderBy("by"))
        tries = tries.union(moved.select("_place", order.alias("config"), F.posexplode(entry_variants(source)).alias("rank", "path")))
    hit = tries.join(files.select("path").hint("merge"), "path", "left_semi").groupBy("_place").agg(F.min_by("path", F.struct("config", "rank")).alias("path"))
    return rows.join(hit.hint("merge"), "_place").drop("_place")


_CONFIG = pa.schema(
    [
        ("path", pa.string()),
        ("root", pa.string()),
        ("kind", pa.string()),
        ("error", pa.string()),
        ("parent", pa.string()),
        ("root_dir", pa.string()),
        ("out_dir", pa.string()),
        ("aliases", pa.list_(pa.struct([("pattern", pa.string()), ("position", pa.int32()), ("target", pa.string())]))),
        ("evidence", pa.list_(pa.struct([("kind", pa.string()), ("specifier", pa.string())]))),
        ("references", pa.list_(pa.string())),
    ]
)


def _below(root: str, path: str) -> str:
    """``path`` of a configuration in ``root``, from the project's root."""
    out: list[str] = []
    for x in [*root.split("/"), *path.split("/")]:
        if x == ".." and out:
            out.pop()
        elif x not in ("", "."):
            out.append(x)
    return "/".join(out)


def _config(path: str, text: str | None) -> dict:
    root = folder(path)
    row = {"path": path, "root": root, "kind": "javascript" if path.endswith("jsconfig.json") else "typescript", "error": None, "parent": None, "root_dir": None, "out_dir": None, "aliases": [], "evidence": [], "references": []}
    try:
        data = json.loads(without_comments(text or ""))
    except ValueError as e:
        return row | {"error": str(e)}
    options = data.get("compilerOptions") or {}
    base = _below(root, options.get("baseUrl") or ".")
    above, evidence = data.get("extends"), []
    if isinstance(above, str) and above.startswith((".", "/")):
        row["parent"] = _below(root, above if above.endswith(".json") else above + ".json")
    elif isinstance(above, str):
        evidence.append({"kind": "extends", "specifier": above})
    evidence += [{"kind": "types", "specifier": t} for t in options.get("types") or []]
    if isinstance(options.get("jsxImportSource"), str):
        evidence.append({"kind": "jsx_import_source", "specifier": options["jsxImportSource"]})
    paths = {k: v for k, v in (options.get("paths") or {}).items() if isinstance(v, list)}
    refs = [r["path"] for r in data.get("references") or [] if isinstance(r, dict) and isinstance(r.get("path"), str)]
    return row | {
        "root_dir": _below(root, options["rootDir"]) if isinstance(options.get("rootDir"), str) else None,
        "out_dir": _below(root, options["outDir"]) if isinstance(options.get("outDir"), str) else None,
        "aliases": [{"pattern": k, "position": i, "target": _below(base, t)} for k, v in paths.items() for i, t in enumerate(v)] + ([{"pattern": "*", "position": 50, "target": _below(base, "*")}] if "baseUrl" in options and "*" not in paths else []),
        "evidence": evidence,
        "references": sorted(_below(root, r if r.endswith(".json") else r + "/tsconfig.json") for r in refs),
    }


def configurations(files: DataFrame) -> DataFrame:
    """tsconfig and jsconfig files with what they inherit: root and output folders, aliases and evidence.

    What is followed: base files, and what those extend or refer to, step by step.
    A cycle of ``extends`` is an error.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_config(p, t) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True)], _CONFIG)

    spark = "path string, root string, kind string, error string, parent string, root_dir string, out_dir string, aliases array<struct<pattern:string,position:int,target:string>>, evidence array<struct<kind:string,specifier:string>>, references array<string>"
    every = graph.checkpointed(files.where(F.col("path").rlike("\\.json$") & F.col("text").rlike("compilerOptions|extends|references|files|include")).select("path", "text").mapInArrow(run, spark))
    ways = every.select(F.col("path").alias("src"), F.explode(F.concat("references", F.filter(F.array("parent"), lambda x: x.isNotNull()))).alias("dst")).select(F.lit("all").alias("profile"), "src", "dst")
    bases = every.where(F.col("path").rlike("(?:^|/)(?:ts|js)config\\.json$")).select(F.lit("all").alias("profile"), "path")
    held = every.join(graph.reachable(ways, bases).select("path"), "path", "left_semi")
    return inherited(held)


def inherited(configs: DataFrame) -> DataFrame:
    """``configs`` with nulls of root_dir and out_dir, and no aliases, filled from ``parent``, and evidence added up."""
    rows = graph.checkpointed(configs.withColumn("next", F.col("parent")))
    for _ in range(64):
        if rows.where("next is not null").isEmpty():
            return rows.drop("next")
        up = configs.select(F.col("path").alias("next"), F.col("root_dir").alias("r"), F.col("out_dir").alias("o"), F.col("aliases").alias("a"), F.col("evidence").alias("e"), F.col("parent").alias("further"))
        rows = rows.join(up, "next", "left").withColumn("root_dir", F.coalesce("root_dir", "r")).withColumn("out_dir", F.coalesce("out_dir", "o"))
        rows = rows.withColumn("aliases", F.when(F.size("aliases") == 0, F.coalesce("a", "aliases")).otherwise(F.col("aliases")))
        rows = rows.withColumn("evidence", F.array_sort(F.array_union("evidence", F.coalesce("e", F.slice("evidence", 1, 0)))))
        rows = graph.checkpointed(rows.drop("next", "r", "o", "a", "e").withColumnRenamed("further", "next"))
    raise ValueError("configurations extend each other in a cycle")


def aliases(configs: DataFrame) -> DataFrame:
    """(config, pattern, position, target): path aliases, from the project's root."""
    return configs.select(F.col("path").alias("config"), F.explode("aliases").alias("a")).select("config", "a.*")


def resolved_profiles(definitions: DataFrame, world: str = "closed") -> DataFrame:
    """(name, conditions, world) of ``definitions(name, parent, conditions, world)``: own and inherited conditions, the nearest world.

    A parent that isn't there and a cycle are errors.
    """
    known = definitions.select(F.col("name").alias("parent"))
    if lost := definitions.where("parent is not null").join(known, "parent", "left_anti").head(1):
        raise ValueError(f"unknown parent of {lost[0]['name']}")
    rows = graph.checkpointed(definitions.select("name", F.array_sort(F.array_distinct("conditions")).alias("conditions"), "world", F.col("parent").alias("next")))
    base = graph.checkpointed(definitions.select(F.col("name").alias("next"), F.col("conditions").alias("c"), F.col("world").alias("w"), F.col("parent").alias("further")))
    for _ in range(64):
        if rows.where("next is not null").isEmpty():
            return rows.select("name", "conditions", F.coalesce("world", F.lit(world)).alias("world"))
        rows = rows.join(base, "next", "left").select("name", F.array_sort(F.array_union("conditions", F.coalesce("c", F.slice("conditions", 1, 0)))).alias("conditions"), F.coalesce("world", "w").alias("world"), F.col("further").alias("next"))
        rows = graph.checkpointed(rows)
    raise ValueError("profiles inherit from each other in a cycle")


def layered(layers: DataFrame, fields: list[str]) -> DataFrame:
    """(workspace, *fields) of ``layers(workspace, layer, *fields)``: of each field the highest layer's value.

    Layers from the lowest: inferred, root, workspace, cli.  Rows without a workspace hold for all.
    """
    rank = F.array_position(F.array(*map(F.lit, ("inferred", "root", "workspace", "cli"))), F.col("layer"))
    best = [F.max(F.when(F.col(c).isNotNull(), F.struct(rank.alias("rank"), F.col(c).alias("value")))).alias(c) for c in fields]
    own = layers.where("workspace is not null").groupBy("workspace").agg(*best)
    shared = layers.where("workspace is null").agg(*[b.alias(f"{c}_all") for b, c in zip(best, fields, strict=True)])  # one row
    rows = own.join(F.broadcast(shared))
    return rows.select("workspace", *[F.greatest(c, f"{c}_all")["value"].alias(c) for c in fields])
