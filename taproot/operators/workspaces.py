"""Workspaces: owners by longest prefix, unused ones, module targets, import resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """All directories of a path, the nearest first and the root ('') last."""
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    return F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def nearest(paths: DataFrame, roots: DataFrame, name: str = "owner") -> DataFrame:
    """``paths(path)`` with the nearest containing one of ``roots(root)``, null if none.

    A path meets its own directories only, by hash: no range join.  Both sides are
    plain tables, so that Spark can split what lies below one hot directory.
    """
    rows = paths.select("path", F.posexplode(ancestors(F.col("path"))).alias("up", "root"))
    found = rows.join(roots.select("root"), "root", "left_semi").groupBy("path").agg(F.min_by("root", "up").alias(name))
    return paths.join(found, "path", "left")


def unused(packages: DataFrame, files: DataFrame, imports: DataFrame, script_refs: DataFrame, blockers: DataFrame) -> DataFrame:
    """(root, name, evidence, outcome) of every package but the root one.

    ``packages(root, name, private)``; ``files(owner, status)``; ``imports(owner,
    package)``; ``script_refs(value)``; ``blockers(owner)``, '' blocking all.  The
    first evidence that holds retains.
    """
    rows = packages.where("root <> ''").withColumn("label", F.coalesce("name", "root"))
    live = files.where("status = 'reachable'").select(F.col("owner").alias("root"), F.lit(True).alias("live")).distinct()
    used = imports.where("package is not null").select("owner", "package").distinct()
    asked = rows.select("root", "name").join(used, (F.col("name") == F.col("package")) & (F.col("owner") != F.col("root"))).select("root", F.lit(True).alias("imported")).distinct()
    refs = script_refs.select("value").distinct()
    told = rows.select("root", "label").join(refs, (F.col("value") == F.col("label"))).select("root").union(rows.select("root").join(refs, F.col("value") == F.col("root")).select("root")).distinct().withColumn("scripted", F.lit(True))
    stop = blockers.select(F.col("owner").alias("root"), F.lit(True).alias("blocked")).distinct()
    everywhere = not blockers.where("owner = ''").isEmpty()
    for more in (live, asked, told, stop):
        rows = rows.join(more, "root", "left")
    evidence = F.when(~F.col("private"), "public_contract").when(F.col("live"), "reachable_file").when(F.col("imported"), "imported_by_workspace").when(F.col("scripted"), "referenced_by_script").when(F.col("blocked") | F.lit(everywhere), "incomplete_coverage")
    return rows.select("root", F.col("label").alias("name"), F.coalesce(evidence, F.lit("")).alias("evidence"), F.when(evidence.isNull(), "unused").otherwise("retained").alias("outcome"))


def resolved(imports: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """``imports(path, specifier, deferred)`` with status and target.

    ``candidates(path, specifier, rank, candidate)`` are the places to look at;
    the first that is a file is the target.  A deferred load has no target and
    blocks; what has no file is external if bare, else unresolved.
    """
    there = files.select(F.col("path").alias("candidate"))
    hit = candidates.join(there, "candidate", "left_semi").groupBy("path", "specifier").agg(F.min_by("candidate", "rank").alias("target"))
    rows = imports.join(hit, ["path", "specifier"], "left")
    bare = ~(F.col("specifier").isin(".", "..") | F.col("specifier").rlike(r"^(?:\./|\.\./|/)"))
    status = F.when(F.col("deferred"), "deferred").when(F.col("target").isNotNull(), "resolved").when(bare, "external").otherwise("unresolved")
    return rows.select("path", "specifier", status.alias("status"), F.when(~F.col("deferred"), F.col("target")).alias("target"))
