"""Imports: candidate places, the ladder of statuses, symbol links, open-world roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions import scalars
from taproot.operators import symbols
from taproot.operators.workspaces import nearest

#: Extensions that a resolver appends, in its order, and what an emitted one may stand for.
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "json", "node")
STANDS_FOR = {"js": ("ts", "tsx", "js"), "mjs": ("mts", "mjs"), "cjs": ("cts", "cjs")}

#: Formats that hold no modules.
ASSETS = (
    "avif", "css", "gif", "ico", "jpeg", "jpg", "json", "less", "otf", "png", "sass", "scss", "styl", "svg", "ttf",
    "wasm", "webp", "woff", "woff2",
)

#: Diagnostics of imports, whether they block, and what they say.
DIAGNOSTICS = {
    "unresolved_import": (True, "Could not resolve `{}`"),
    "outside_analysis_root": (True, "`{}` resolved to source outside the configured project root"),
    "unsupported_imported_source": (True, "`{}` resolved to a source format whose embedded module graph is not modeled"),
    "resolved_into_excluded_path": (False, "`{}` resolved to a path that discovery leaves out"),
    "outside_file_universe": (True, "`{}` resolved to source outside the explicit universe"),
    "unsupported_specifier": (True, "`{}` needs a resolver feature that is not modeled"),
}


def suffix(path: Column) -> Column:
    """What stands after the last point of the last segment; '' if there is none."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def analyzable(path: Column) -> Column:
    return suffix(path).isin(*scalars.SOURCE_EXTENSIONS)


def inert_asset(path: Column) -> Column:
    return suffix(path).isin(*ASSETS)


def dependency_path(path: Column) -> Column:
    return path.rlike(r"(?:^|/)node_modules(?:/|$)")


def archive_dependency(path: Column) -> Column:
    """Whether a path leads into an archive's node_modules, as plug-and-play installs do."""
    return path.rlike(r"(?:^|/)[^/]+\.zip/(?:.*/)?node_modules(?:/|$)")


def builtin(specifier: Column) -> Column:
    """``node:`` modules, runtime modules and their subpaths."""
    return F.startswith(specifier, F.lit("node:")) | F.split(specifier, "/").getItem(0).isin(*scalars.NODE_BUILTINS)


def ranked(place: Column) -> Column:
    """Paths that a place may stand for, in the resolver's order."""
    e = suffix(place)
    stem = F.regexp_replace(place, r"\.[^./]*$", "")
    alias = F.array(place)
    for ending, others in STANDS_FOR.items():
        alias = F.when(e == ending, F.array(*[F.concat(stem, F.lit("." + o)) for o in others])).otherwise(alias)
    more = [F.concat(place, F.lit("." + x)) for x in EXTENSIONS]
    index = [F.concat(place, F.lit("/index." + x)) for x in EXTENSIONS]
    return F.concat(alias, F.array(*more, *index))


def own_configuration(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config): the configuration of the deepest root that holds a file, a tsconfig before a jsconfig of one folder."""
    own = configs.groupBy("root").agg(F.min_by("path", F.struct(F.when(F.col("kind") == "typescript", 0).otherwise(1), "path")).alias("config"))
    return nearest(paths.select("path").distinct(), own.select("root"), "root").where("root is not null").join(own, "root").select("path", "config")


def aliased(imports: DataFrame, configs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, specifier, position, place) of specifiers that a path alias of the nearest configuration maps.

    ``configs(path, root, kind)``: the deepest root that holds a file is its
    configuration, a tsconfig before a jsconfig of the same folder.
    ``aliases(config, pattern, position, target)``, targets relative to the root:
    an exact pattern goes before wildcards, of which the longest prefix wins.
    """
    files = own_configuration(imports, configs)
    rows = imports.where(~scalars.relative_specifier(F.col("specifier"))).select("path", "specifier").distinct().join(files, "path")
    rows = rows.join(aliases, "config")
    star = F.instr("pattern", "*")
    before = F.when(star > 0, F.expr("substring(pattern, 1, instr(pattern, '*') - 1)")).otherwise(F.col("pattern"))
    after = F.when(star > 0, F.expr("substring(pattern, instr(pattern, '*') + 1)")).otherwise(F.lit(""))
    fits = F.when(star > 0, F.startswith("specifier", before) & F.endswith("specifier", after) & (F.length("specifier") >= F.length(before) + F.length(after))).otherwise(F.col("specifier") == F.col("pattern"))
    held = F.expr("substring(specifier, length(before) + 1, length(specifier) - length(before) - length(after))")
    rows = rows.where(fits).withColumn("before", before).withColumn("after", after).withColumn("held", F.when(star > 0, held).otherwise(F.lit("")))
    strength = F.struct(F.when(star > 0, 0).otherwise(1).alias("exact"), F.length("before").alias("n"), F.col("pattern").alias("pattern"))
    best = rows.groupBy("path", "specifier").agg(F.max(strength).alias("best"))
    rows = rows.join(best, ["path", "specifier"]).where(F.col("pattern") == F.col("best.pattern"))
    return rows.select("path", "specifier", "position", F.replace("target", F.lit("*"), F.col("held")).alias("place"))


def candidates(imports: DataFrame, configs: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(path, specifier, rank, candidate): relative places, or those of path aliases; queries and fragments are off."""
    relative = imports.where(scalars.relative_specifier(F.col("specifier"))).select("path", "specifier").distinct()
    plain = F.regexp_replace("specifier", r"[?#].*$", "")
    place = F.when(F.startswith("specifier", F.lit("/")), plain).otherwise(F.concat_ws("/", F.regexp_replace("path", r"[^/]*$", ""), plain))
    places = relative.select("path", "specifier", F.lit(0).alias("position"), scalars.popped_path(place).alias("place"))
    if aliases is not None:
        places = places.union(aliased(imports, configs, aliases).withColumn("place", scalars.popped_path(F.col("place"))))
    rows = places.select("path", "specifier", "position", F.posexplode(ranked(F.col("place"))).alias("n", "candidate"))
    return rows.select("path", "specifier", (F.col("position") * 100 + F.col("n")).alias("rank"), "candidate")


def ladder(imports: DataFrame, places: DataFrame, files: DataFrame, others: DataFrame, declared: DataFrame, targets: DataFrame, discovered: bool = False, archives: bool = False) -> DataFrame:
    """``imports(path, specifier, mode, deferred)`` with status, target, targets, code and blocks.

    ``places`` are ``candidates``; ``files(path)`` is the universe, ``others(path)``
    what exists beside it, paths that leave the root starting with ``../``;
    ``declared(package)`` are external packages; ``targets(package, specifier,
    esm, common_js)`` map workspace packages to paths, null or empty if none.

    The first that holds decides: a deferred load; a workspace target; a runtime
    module; a file of the universe; a dependency's file; one outside the root; an
    asset; a format that is not read; a file that discovery leaves out (or, in an
    explicit universe, that isn't in it).  Without a file: a workspace package is
    unresolved, a declared package external, a relative path unresolved, and the
    rest unsupported.  Only a file of the universe makes an edge.
    """
    there = files.select(F.col("path").alias("candidate"), F.lit(True).alias("inside")).union(others.select("path", F.lit(False)))
    there = there.groupBy("candidate").agg(F.bool_or("inside").alias("inside"))
    hit = places.join(there, "candidate").groupBy("path", "specifier").agg(F.min_by(F.struct("candidate", "inside"), "rank").alias("hit"))
    rows = imports.withColumn("package", scalars.package_name(F.col("specifier"))).join(hit, ["path", "specifier"], "left")

    own = targets.select("specifier", F.posexplode(F.when(F.size(F.coalesce("common_js", F.array())) > 0, F.col("common_js")).otherwise(F.col("esm"))).alias("n", "candidate"), F.lit("common_js").alias("mode"))
    own = own.union(targets.select("specifier", F.posexplode("esm").alias("n", "candidate"), F.lit("esm").alias("mode")))
    own = own.join(files.select(F.col("path").alias("candidate")), "candidate", "left_semi")
    own = own.groupBy("specifier", "mode").agg(F.transform(F.array_sort(F.collect_set(F.struct("n", "candidate"))), lambda x: x["candidate"]).alias("mapped"))
    rows = rows.join(own, ["specifier", "mode"], "left")
    rows = rows.join(targets.where("package is not null").select("package", F.lit(True).alias("ours")).distinct(), "package", "left")
    rows = rows.join(declared.where("package is not null").select("package", F.lit(True).alias("named")).distinct(), "package", "left")

    found, inside, ours = F.col("hit.candidate"), F.coalesce("hit.inside", F.lit(False)), F.coalesce("ours", F.lit(False))
    steps = [
        (F.col("deferred"), "deferred", None),
        (F.col("mapped").isNotNull(), "resolved", None),
        (builtin(F.col("specifier")), F.when(ours, "unresolved").otherwise("external"), F.when(ours, "unresolved_import")),
        (found.isNotNull() & archive_dependency(found) & F.col("package").isNotNull() & ~ours & F.lit(archives), "external", None),
        (inside, "resolved", None),
        (found.isNotNull() & dependency_path(found), "external", None),
        (F.startswith(found, F.lit("../")), "unresolved", "outside_analysis_root"),
        (found.isNotNull() & inert_asset(found), "external", None),
        (found.isNotNull() & ~analyzable(found), "unsupported", "unsupported_imported_source"),
        (found.isNotNull(), "external" if discovered else "unresolved", "resolved_into_excluded_path" if discovered else "outside_file_universe"),
        (ours, "unresolved", "unresolved_import"),
        (F.col("named"), "external", None),
        (scalars.relative_specifier(F.col("specifier")), "unresolved", "unresolved_import"),
    ]
    status, code = F.lit("unsupported"), F.lit("unsupported_specifier")
    for test, s, c in reversed(steps):
        status = F.when(test, s if isinstance(s, Column) else F.lit(s)).otherwise(status)
        code = F.when(test, c if isinstance(c, Column) else F.lit(c).cast("string")).otherwise(code)
    rows = rows.withColumn("status", status).withColumn("code", code)
    # A target that discovery leaves out is recorded, but is no edge.
    kept = F.when(F.col("status") == "resolved", F.coalesce(F.get("mapped", F.lit(0)), found)).when(F.col("code") == "resolved_into_excluded_path", found)
    all_of = F.when(F.col("status") == "resolved", F.coalesce("mapped", F.array(found)))
    blocks = F.coalesce(F.col("code").isin(*[k for k, (b, _) in DIAGNOSTICS.items() if b]), F.lit(False))
    return rows.select("path", "specifier", "mode", "deferred", "status", kept.alias("target"), all_of.alias("targets"), "code", blocks.alias("blocks"))


def edges(resolved: DataFrame) -> DataFrame:
    """(src, dst): a workspace target of several files has an edge to each."""
    return resolved.select(F.col("path").alias("src"), F.explode("targets").alias("dst")).distinct()


def diagnostics(resolved: DataFrame) -> DataFrame:
    """(path, code, message, blocks) of imports that the ladder could not follow."""
    text = F.lit(None).cast("string")
    for code, (_, form) in DIAGNOSTICS.items():
        before, after = form.split("{}")
        text = F.when(F.col("code") == code, F.concat(F.lit(before), "specifier", F.lit(after))).otherwise(text)
    return resolved.where("code is not null").select("path", "code", text.alias("message"), "blocks").distinct()


def additional_edges(extra: DataFrame, files: DataFrame) -> DataFrame:
    """(path, specifier, target): edges of plugins, as import rows; those without a file at either end are dropped."""
    known = files.select("path")
    rows = extra.join(known.withColumnRenamed("path", "src"), "src", "left_semi").join(known.withColumnRenamed("path", "dst"), "dst", "left_semi")
    return rows.select(F.col("src").alias("path"), F.concat(F.lit("plugin: "), "reason").alias("specifier"), F.col("dst").alias("target")).distinct()


def first_targets(resolved: DataFrame) -> DataFrame:
    """(path, specifier, target): of a file's resolved imports of a specifier, the one that stands first.

    ``resolved(path, specifier, start, end, status, target)``.
    """
    order = Window.partitionBy("path", "specifier").orderBy("start", "end", "target")
    rows = resolved.where("status = 'resolved' and target is not null").withColumn("_n", F.row_number().over(order))
    return rows.where("_n = 1").select("path", "specifier", "target")


def symbol_links(bindings: DataFrame, exports: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src_path, src_symbol, src_usage, dst_path, dst_symbol, usage): import bindings tied to the symbols they mean.

    ``bindings(path, source, imported, local, kind, type_only)``; ``exports(path,
    exported, source, imported, local, kind, type_only)``.  Namespace and CommonJS
    bindings mean every name of the target, through ``export *`` chains.
    """
    first = first_targets(resolved)
    at = first.select("path", F.col("specifier").alias("source"), F.col("target").alias("dst"))
    tied = bindings.join(at, ["path", "source"])
    own = exports.where("local is not null").select("path", "exported", "local", F.when(F.col("type_only"), "type").otherwise("runtime").alias("usage"))
    named = exports.where("kind <> 'star' and source is not null").join(at, ["path", "source"]).select("path", "exported", "dst", "imported")
    stars = exports.where("kind = 'star' and source is not null").join(at, ["path", "source"]).select(F.col("path").alias("src"), "dst").distinct()
    names = symbols.exported_names(exports.where("kind <> 'star'").select("path", "exported"), stars)
    whole = tied.where(F.col("kind").isin("namespace", "common_js")).join(names.select(F.col("path").alias("dst"), F.col("exported").alias("name")), "dst")
    name = F.when(F.col("kind") == "default", "default").otherwise(F.col("imported"))
    single = tied.where(F.col("kind").isin("default", "named")).withColumn("name", name).where("name is not null")
    columns = ["path", "local", "type_only", "dst", "name"]
    wanted = single.select(*columns).union(whole.select(*columns)).distinct()
    meant = symbols.export_targets(wanted.select(F.col("dst").alias("path"), F.col("name").alias("exported")), own, named, stars)
    rows = wanted.join(meant.select(F.col("path").alias("dst"), F.col("exported").alias("name"), "local_path", F.col("local").alias("dst_symbol"), "usage"), ["dst", "name"])
    usage = F.when(F.col("type_only"), "type").otherwise("runtime")
    return rows.select(F.col("path").alias("src_path"), F.col("local").alias("src_symbol"), usage.alias("src_usage"), F.col("local_path").alias("dst_path"), "dst_symbol", "usage").distinct()


def open_world_roots(exports: DataFrame, resolved: DataFrame, open_files: DataFrame) -> DataFrame:
    """(path, symbol, usage): symbols that open entry files re-export, by name or by star."""
    at = first_targets(resolved).select("path", F.col("specifier").alias("source"), F.col("target").alias("dst"))
    own = exports.where("local is not null").select("path", "exported", "local", F.when(F.col("type_only"), "type").otherwise("runtime").alias("usage"))
    named = exports.where("kind <> 'star' and source is not null").join(at, ["path", "source"]).select("path", "exported", "dst", "imported")
    stars = exports.where("kind = 'star' and source is not null").join(at, ["path", "source"]).select(F.col("path").alias("src"), "dst").distinct()
    mine = exports.where("local is null").join(open_files.select("path").distinct(), "path", "left_semi")
    names = symbols.exported_names(exports.where("kind <> 'star'").select("path", "exported"), stars)
    starred = mine.where("kind = 'star'").join(at, ["path", "source"]).join(names.select(F.col("path").alias("dst"), F.col("exported").alias("name")), "dst").select("path", "name")
    wanted = mine.where("kind <> 'star'").select("path", F.col("exported").alias("name")).union(starred).distinct()
    meant = symbols.export_targets(wanted.select("path", F.col("name").alias("exported")), own, named, stars)
    return meant.select(F.col("local_path").alias("path"), F.col("local").alias("symbol"), "usage").distinct()
