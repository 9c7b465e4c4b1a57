"""Symbols: two-lane liveness, dead groups, export closures, unused exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot.operators import graph

#: Declarations that are never reported on their own.
NOT_REPORTABLE = ("catch", "enum_member", "type_parameter", "unknown")


def _key(path: str, symbol: str) -> Column:
    return F.concat_ws("#", F.col(path), F.col(symbol).cast("string"))


def liveness(symbols: DataFrame, links: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, symbol, runtime, type): the lanes in which each symbol is live.

    An edge fires whichever lane its source was reached in; its target is live in
    the lane that the edge declares.  So nodes are closed first, lanes follow.
    """
    one = F.lit("all").alias("profile")
    known = symbols.select(_key("path", "symbol").alias("path"))
    edges = links.select(one, _key("src_path", "src_symbol").alias("src"), _key("dst_path", "dst_symbol").alias("dst"), "usage")
    edges = edges.join(known.withColumnRenamed("path", "src"), "src", "left_semi").join(known.withColumnRenamed("path", "dst"), "dst", "left_semi")
    start = roots.select(one, _key("path", "symbol").alias("path"), "usage").join(known, "path", "left_semi")
    edges, start = graph.checkpointed(edges.distinct()), graph.checkpointed(start)
    live = graph.reachable(edges.select("profile", "src", "dst"), start.select("profile", "path"), limit)
    given = edges.join(live.withColumnRenamed("path", "src"), ["profile", "src"], "left_semi").select(F.col("dst").alias("key"), "usage").union(start.select(F.col("path").alias("key"), "usage"))
    lanes = given.groupBy("key").agg(F.bool_or(F.col("usage") == "runtime").alias("runtime"), F.bool_or(F.col("usage") == "type").alias("type"))
    out = symbols.withColumn("key", _key("path", "symbol")).join(lanes, "key", "left")
    return out.select(*symbols.columns, F.coalesce("runtime", F.lit(False)).alias("runtime"), F.coalesce("type", F.lit(False)).alias("type"))


def dead_groups(live: DataFrame, links: DataFrame, limit: int | None = None) -> DataFrame:
    """(symbols, n, cyclic, paths): strong components of dead, reportable symbols.

    Import bindings are part of groups but not of reports; a group of imports only is not reported.
    """
    dead = live.where("not runtime and not type").where(~F.col("kind").isin(*NOT_REPORTABLE)).withColumn("key", _key("path", "symbol"))
    dead = graph.checkpointed(dead)
    one = F.lit("all").alias("profile")
    edges = links.select(one, _key("src_path", "src_symbol").alias("src"), _key("dst_path", "dst_symbol").alias("dst"))
    groups = graph.strong_components(edges, dead.select(one, F.col("key").alias("path")), limit).select(F.col("path").alias("key"), "component", "cyclic")
    shown = dead.where("kind <> 'import'").join(groups, "key")
    out = shown.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("path", "symbol", "name"))).alias("m"), F.max("cyclic").alias("cyclic"), F.array_sort(F.collect_set("path")).alias("p"))
    return out.select(F.array_join(F.transform("m", lambda x: x["name"]), ", ").alias("symbols"), F.size("m").cast("long").alias("n"), "cyclic", F.array_join("p", ",").alias("paths"))


def exported_names(exports: DataFrame, stars: DataFrame) -> DataFrame:
    """(path, exported): names that each file exports, those through ``export *`` chains too.

    ``stars(src, dst)`` are the files that a file forwards; a star adds no name of its own.
    """
    own = exports.select("path", "exported")
    reach = _closure(stars.select("src", "dst").where("src <> dst").distinct())
    return own.union(reach.join(exports.select(F.col("path").alias("dst"), "exported"), "dst").select(F.col("src").alias("path"), "exported")).distinct()


def _closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a way of one step or more, by doubling: rounds are the logarithm of the longest."""
    paths = graph.checkpointed(edges.select("src", "dst").distinct())
    n = paths.count()
    while True:
        far = paths.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        paths = graph.checkpointed(paths.union(paths.join(far, "dst").select("src", F.col("far").alias("dst"))).distinct())
        if (now := paths.count()) == n:
            return paths
        n = now


def export_targets(wanted: DataFrame, exports: DataFrame, forwards: DataFrame, stars: DataFrame) -> DataFrame:
    """(path, exported, local_path, local, usage): the symbols that a wanted (path, exported) stands for.

    ``exports(path, exported, local, usage)`` bind names to symbols of the file;
    ``forwards(path, exported, dst, imported)`` re-export one name; ``stars(src,
    dst)`` forward every name.  States are (path, name), each visited once, so
    cycles end.
    """
    seen = new = graph.checkpointed(wanted.select("path", "exported", F.col("path").alias("at"), F.col("exported").alias("name")).distinct())
    while not new.isEmpty():
        by_name = new.join(forwards.select(F.col("path").alias("at"), F.col("exported").alias("name"), "dst", "imported"), ["at", "name"]).select("path", "exported", F.col("dst").alias("at"), F.coalesce("imported", "name").alias("name"))
        by_star = new.join(stars.select(F.col("src").alias("at"), "dst"), "at").select("path", "exported", F.col("dst").alias("at"), "name")
        new = graph.checkpointed(by_name.union(by_star).distinct().join(seen, ["path", "exported", "at", "name"], "left_anti"))
        seen = graph.checkpointed(seen.union(new))
    local = exports.where("local is not null").select(F.col("path").alias("at"), F.col("exported").alias("name"), "local", "usage")
    return seen.join(local, ["at", "name"]).select("path", "exported", F.col("at").alias("local_path"), "local", "usage").distinct()


def unused_exports(exports: DataFrame, links: DataFrame, reachable: DataFrame, open_world: DataFrame) -> DataFrame:
    """Exports of reachable, closed files whose symbol no link consumes in the export's lane.

    Consumers count wherever they are, and consuming one alias consumes all.
    """
    used = links.select(F.col("dst_path").alias("path"), F.col("dst_symbol").alias("local"), "usage").distinct()
    rows = exports.where("local is not null").join(reachable.select("path"), "path", "left_semi").join(open_world.select("path"), "path", "left_anti")
    return rows.join(used, ["path", "local", "usage"], "left_anti")
