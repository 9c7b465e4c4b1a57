"""Graph fixpoints: reachability, strong components, shortest paths, closures.

Every operator takes edges of a ``profile`` and answers for all profiles at once.
Two ways give the same rows.  Up to ``KERNEL_EDGES`` edges, counted first, each
profile's edges meet in one task and a linear algorithm runs there.  Beyond it,
rounds of joins run over the whole table; each round's result is written to the
shared checkpoint folder, so no plan grows with the rounds and a lost executor
costs one round.  Long chains would take as many rounds as they are long, so
vertices with one way on get shortcuts of 2, 4, 8, ... steps first.
"""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KERNEL_EDGES = 1_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, its lineage cut."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="taproot-"))
    return df.checkpoint(eager=True)


def _small(edges: DataFrame, limit: int | None) -> bool:
    limit = KERNEL_EDGES if limit is None else limit
    return edges.limit(limit + 1).count() <= limit


def _per_profile(edges: DataFrame, nodes: DataFrame, kernel, schema: str) -> DataFrame:
    """Runs ``kernel(names, src, dst, nodes)`` where each profile's rows meet.

    Paths are numbered in their byte order, so that kernels handle integers only:
    ``names`` are the paths, ``src`` and ``dst`` the ends of edges sorted by both,
    ``nodes`` the other table with its path numbered.
    """

    def run(key, a: pa.Table, b: pa.Table):
        coded = pa.chunked_array([*a["src"].chunks, *a["dst"].chunks, *b["path"].chunks], pa.string()).combine_chunks().dictionary_encode()
        words = np.array(coded.dictionary.to_pylist(), object)
        order = np.array(sorted(range(len(words)), key=lambda i: words[i].encode()), np.int64)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        codes = place[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        n = a.num_rows
        src, dst, own = codes[:n], codes[n : 2 * n], codes[2 * n :]
        by = np.lexsort((dst, src))
        names = words[order]
        found = kernel(names, src[by], dst[by], b.set_column(b.column_names.index("path"), "path", pa.array(own)))
        rows = len(next(iter(found.values()), []))
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
        return pa.table({c: pa.array([key[0].as_py()] * rows if c == "profile" else found[c], types[t]) for c, t in (x.split() for x in schema.split(", "))})

    # new names for the columns: both sides may come from one table
    edges, nodes = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (edges, nodes))
    return edges.groupBy("profile").cogroup(nodes.groupBy("profile")).applyInArrow(run, schema)


def _ways(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Where each vertex's ways on begin in the sorted edges, and where those lead."""
    return np.searchsorted(src, np.arange(n + 1)).tolist(), dst.tolist()


def with_shortcuts(edges: DataFrame, steps: int = 20) -> DataFrame:
    """``edges`` and, for vertices with exactly one way on, jumps of 2, 4, 8, ... of those."""
    one = edges.groupBy("profile", "src").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1 and src <> dst").drop("n")
    out, jump = edges, checkpointed(one)
    for _ in range(steps):
        far = jump.select("profile", F.col("src").alias("dst"), F.col("dst").alias("far"))
        jump = checkpointed(jump.join(far, ["profile", "dst"]).select("profile", "src", F.col("far").alias("dst")).where("src <> dst"))
        if jump.isEmpty():
            break
        out = out.union(jump)
    return out.distinct()


def reachable(edges: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """(profile, path) of all that ``roots(profile, path)`` reach over ``edges(profile, src, dst)``, roots included."""
    edges = checkpointed(edges.select("profile", "src", "dst").where("src is not null and dst is not null").distinct())
    roots = roots.select("profile", "path").where("path is not null").distinct()
    if _small(edges, limit):

        def kernel(names, src, dst, starts):
            begin, to = _ways(src, dst, len(names))
            seen = np.zeros(len(names), bool)
            todo = np.unique(starts["path"].to_numpy()).tolist()
            seen[todo] = True
            while todo:
                v = todo.pop()
                for w in to[begin[v] : begin[v + 1]]:
                    if not seen[w]:
                        seen[w] = True
                        todo.append(w)
            return {"path": names[seen].tolist()}

        return _per_profile(edges, roots, kernel, "profile string, path string")
    edges = checkpointed(with_shortcuts(edges))
    seen = new = checkpointed(roots)
    while True:
        step = new.withColumnRenamed("path", "src").join(edges, ["profile", "src"]).select("profile", F.col("dst").alias("path")).distinct()
        new = checkpointed(step.join(seen, ["profile", "path"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = checkpointed(seen.union(new))


def strong_components(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """(profile, path, component, cyclic) of the subgraph induced by ``nodes(profile, path)``.

    component is its smallest path; cyclic tells whether it has several members or an edge to itself.
    """
    nodes = checkpointed(nodes.select("profile", "path").where("path is not null").distinct())
    ends = [nodes.withColumnRenamed("path", c) for c in ("src", "dst")]
    edges = edges.select("profile", "src", "dst").distinct().join(ends[0], ["profile", "src"], "left_semi").join(ends[1], ["profile", "dst"], "left_semi").select("profile", "src", "dst")
    edges = checkpointed(edges)
    loops = edges.where("src = dst").select("profile", F.col("src").alias("path"), F.lit(True).alias("loop"))
    found = _kernel_components(edges, nodes) if _small(edges, limit) else _looped_components(edges, nodes)
    size = Window.partitionBy("profile", "component")
    found = found.join(loops, ["profile", "path"], "left").withColumn("n", F.count("*").over(size))
    return found.select("profile", "path", "component", ((F.col("n") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def _kernel_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    def kernel(names, src, dst, members):
        # Tarjan's algorithm with an explicit stack.
        begin, to = _ways(src, dst, len(names))
        index, low, on = [-1] * len(names), [0] * len(names), bytearray(len(names))
        stack, component, count = [], [-1] * len(names), 0
        own = np.unique(members["path"].to_numpy()).tolist()
        for root in own:
            if index[root] >= 0:
                continue
            work = [(root, begin[root])]
            index[root] = low[root] = count
            count += 1
            stack.append(root)
            on[root] = 1
            while work:
                v, at = work.pop()
                for i in range(at, begin[v + 1]):
                    w = to[i]
                    if index[w] < 0:
                        index[w] = low[w] = count
                        count += 1
                        stack.append(w)
                        on[w] = 1
                        work += [(v, i + 1), (w, begin[w])]
                        break
                    if on[w]:
                        low[v] = min(low[v], index[w])
                else:
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == index[v]:
                        at = len(stack) - 1
                        while stack[at] != v:
                            at -= 1
                        group = stack[at:]
                        del stack[at:]
                        least = min(group)
                        for w in group:
                            on[w] = 0
                            component[w] = least
        return {"path": names[own].tolist(), "component": names[np.array(component, np.int64)[own]].tolist()}

    return _per_profile(edges, nodes, kernel, "profile string, path string, component string")


def _looped_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Trim vertices without a way in or out; then colour forward and collect backward, until none is left."""
    done = None
    edges = checkpointed(edges.where("src <> dst"))

    def add(rows):
        nonlocal done
        done = rows if done is None else checkpointed(done.union(rows))

    while not nodes.isEmpty():
        while True:  # vertices on no cycle
            inner = edges.select("profile", F.col("src").alias("path")).distinct().join(edges.select("profile", F.col("dst").alias("path")).distinct(), ["profile", "path"])
            alone = checkpointed(nodes.join(inner, ["profile", "path"], "left_anti"))
            if alone.isEmpty():
                break
            add(alone.select("profile", "path", F.col("path").alias("component")))
            nodes = checkpointed(nodes.join(alone, ["profile", "path"], "left_anti"))
            for c in ("src", "dst"):
                edges = edges.join(alone.withColumnRenamed("path", c), ["profile", c], "left_anti")
            edges = checkpointed(edges.select("profile", "src", "dst"))
        if nodes.isEmpty():
            break
        # The least path that reaches each vertex.
        colour = checkpointed(nodes.withColumn("colour", F.col("path")))
        while True:
            given = edges.join(colour.withColumnRenamed("path", "src"), ["profile", "src"]).select("profile", F.col("dst").alias("path"), "colour")
            after = checkpointed(colour.union(given).groupBy("profile", "path").agg(F.min("colour").alias("colour")))
            same = after.exceptAll(colour).isEmpty()
            colour = after
            if same:
                break
        # Of each colour, what reaches its first vertex back inside the colour.
        inside = edges.join(colour.select("profile", F.col("path").alias("src"), F.col("colour").alias("a")), ["profile", "src"]).join(colour.select("profile", F.col("path").alias("dst"), F.col("colour").alias("b")), ["profile", "dst"]).where("a = b")
        back = checkpointed(inside.select("profile", F.col("dst").alias("src"), F.col("src").alias("dst")))
        heads = colour.where("path = colour").select("profile", "path")
        group = checkpointed(reachable(back, heads, limit=0).join(colour, ["profile", "path"]))
        add(group.select("profile", "path", F.col("colour").alias("component")))
        nodes = checkpointed(nodes.join(group, ["profile", "path"], "left_anti"))
        for c in ("src", "dst"):
            edges = edges.join(group.select("profile", F.col("path").alias(c)), ["profile", c], "left_anti")
        edges = checkpointed(edges.select("profile", "src", "dst"))
    return done if done is not None else nodes.withColumn("component", F.col("path"))


def discovery(edges: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """(profile, path, depth, rank, parent): breadth-first discovery.

    ``roots(profile, path, position)`` come in their order, neighbours by path.
    rank is the order of discovery, parent the earliest that leads to a vertex on
    a shortest path; following parents gives the shortest path that the order
    prefers.
    """
    edges = checkpointed(edges.select("profile", "src", "dst").where("src is not null and dst is not null").distinct())
    roots = roots.groupBy("profile", "path").agg(F.min("position").alias("position"))
    schema = "profile string, path string, depth int, rank long, parent string"
    if _small(edges, limit):

        def kernel(names, src, dst, starts):
            begin, to = _ways(src, dst, len(names))
            depth, rank, parent, found = [-1] * len(names), [0] * len(names), [-1] * len(names), []
            for _, v in sorted(zip(starts["position"].to_pylist(), starts["path"].to_pylist(), strict=True)):
                depth[v], rank[v] = 0, len(found)
                found.append(v)
            for v in found:  # grows as it is read
                for w in to[begin[v] : begin[v + 1]]:
                    if depth[w] < 0:
                        depth[w], rank[w], parent[w] = depth[v] + 1, len(found), v
                        found.append(w)
            return {"path": names[found].tolist(), "depth": [depth[v] for v in found], "rank": [rank[v] for v in found], "parent": [names[parent[v]] if parent[v] >= 0 else None for v in found]}

        return _per_profile(edges, roots, kernel, schema)
    new = roots.withColumn("rank", F.row_number().over(Window.partitionBy("profile").orderBy("position", "path")) - 1)
    new = checkpointed(new.select("profile", "path", F.lit(0).alias("depth"), F.col("rank").cast("long").alias("rank"), F.lit(None).cast("string").alias("parent")))
    seen, depth = new, 0
    while True:
        depth += 1
        step = new.select("profile", F.col("path").alias("src"), "rank").join(edges, ["profile", "src"])
        step = step.groupBy("profile", F.col("dst").alias("path")).agg(F.min("rank").alias("by"), F.min_by("src", "rank").alias("parent"))
        step = step.join(seen.select("profile", "path"), ["profile", "path"], "left_anti")
        start = seen.groupBy("profile").agg(F.count("*").alias("n"))
        step = step.withColumn("at", F.row_number().over(Window.partitionBy("profile").orderBy("by", "path")) - 1).join(start, "profile")
        new = checkpointed(step.select("profile", "path", F.lit(depth).alias("depth"), (F.col("n") + F.col("at")).cast("long").alias("rank"), "parent"))
        if new.isEmpty():
            return seen
        seen = checkpointed(seen.union(new))
