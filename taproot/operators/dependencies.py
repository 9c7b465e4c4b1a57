"""Dependencies: declarations against evidence, blockers and the root workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_binaries(evidence: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of binaries mapped to their owning packages, and the binaries that no package owns."""
    named = evidence.where("binary is not null").join(owners, "binary", "left")
    mapped = named.where("owner is not null").select("workspace", F.col("owner").alias("package"), "kind")
    return evidence.where("binary is null").select("workspace", "package", "kind").union(mapped).distinct(), named.where("owner is null").select("workspace", "binary").distinct()


def outcomes(declarations: DataFrame, evidence: DataFrame, blockers: DataFrame, root: str) -> DataFrame:
    """(workspace, package, declared_workspace, categories, kind, confidence, evidence).

    Declared: retained by evidence, undetermined by a blocker of the workspace
    (of this or of any package), else unreferenced by category, else unused.  Not
    declared: misplaced when the root declares it, else unlisted.
    """
    declared = declarations.groupBy("workspace", "package").agg(F.array_sort(F.collect_set("category")).alias("categories")).withColumn("declared", F.lit(True))
    found = evidence.groupBy("workspace", "package").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    rows = declared.join(found, ["workspace", "package"], "full_outer")
    whole = blockers.where("package is null").select("workspace", F.lit(True).alias("blocked_all")).distinct()
    part = blockers.where("package is not null").select("workspace", "package", F.lit(True).alias("blocked_one")).distinct()
    at_root = declared.where(F.col("workspace") == root).select("package", F.col("categories").alias("root_categories"))
    rows = rows.join(whole, "workspace", "left").join(part, ["workspace", "package"], "left").join(at_root, "package", "left")
    blocked = F.coalesce("blocked_all", "blocked_one", F.lit(False))
    peer, optional = (F.array_contains("categories", c) for c in ("peer", "optional"))
    kind = (
        F.when(F.col("declared").isNull(), F.when(F.col("root_categories").isNotNull() & (F.col("workspace") != root), "misplaced").otherwise("unlisted"))
        .when(F.col("kinds").isNotNull(), "retained")
        .when(blocked, "undetermined")
        .when(peer, "unreferenced_peer")
        .when(optional, "unreferenced_optional")
        .otherwise("unused")
    )
    rows = rows.withColumn("kind", kind)
    confidence = F.when(F.col("kind").isin("retained", "undetermined"), "not_applicable").when(F.col("kind").isin("unreferenced_peer", "unreferenced_optional"), "medium").otherwise("high")
    where = F.when(F.col("declared"), F.col("workspace")).when(F.col("kind") == "misplaced", root)
    categories = F.when(F.col("declared"), F.col("categories")).when(F.col("kind") == "misplaced", F.col("root_categories"))
    none = F.expr("cast(array() as array<string>)")
    return rows.select("workspace", "package", where.alias("declared_workspace"), F.array_join(F.coalesce(categories, none), ",").alias("categories"), "kind", confidence.alias("confidence"), F.array_join(F.coalesce("kinds", none), ",").alias("evidence"))
