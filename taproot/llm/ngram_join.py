"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A text's set is its distinct five-word shingles (words lower-cased A-Z; a text
of fewer words has its whole sequence as one shingle, one without words has
none and links with nothing).  Two texts link when 100 * |A n B| >= 75 * |A u B|.
Copies are one node, a hash of their words.

1. One pass counts shingles into a fixed table of 2**22 numbers.  It orders all
   shingles rare first: by the counted class, then by hash.  Any total order gives
   the same links.  The table tells apart what is commoner than its mean load, so
   the commonest shingles never stand in a prefix, however large the corpus is.
   What is rarer than that has the order of its hash; step 2 does not need it.
2. A text of n shingles has the n - ceil(0.75 n) + l(n) rarest as its prefix, with
   l(n) = 1 + n / 10.  Texts that link share at least l shingles of their prefixes,
   l being that of the smaller.  So each node's prefix shingles that stand in other
   prefixes too are counted, and a node with too few links with nothing.  Texts
   that share only a passage, most of those that share anything, end here, before
   any pair is made.  Tasks combine first: a shingle of several nodes in a task is
   one row there, so the commonest has no more rows than there are tasks.
3. Only the nodes left, some tenths of all, are looked at further: one text of each
   is written with its signs, and so are their prefixes, by shingle.
4. Each shingle's nodes are paired with its first node only, if sizes, positions
   and signs (512 parity bits of either set) allow 75 %.  Pairs are made distinct,
   the texts of both are joined and the pair is verified, first by a suffix filter,
   then by intersection.  Links make components.
5. While shingles hold many pairs of nodes of different components, another node of
   each is paired with the rest: members of a group of near copies find a link with
   one of many heads.  After each round, nodes whose prefix has fewer than l shingles
   in common with other components go.  The pairs that are still left are verified,
   each once; nodes already connected need no more, so no connection is lost and a
   group of near copies is not squared.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from taproot.llm.links import components
from taproot.llm.shared import new_names, saved
from taproot.llm.sketch import bit_table, has_bit, summed
from taproot.llm.words import between, cut, mix, running, shingle_sets, slices

TABLE = 1 << 22
MARGIN = 10
HELD = 500_000
ROUNDS = 2
SIGNS = [f"s{i}" for i in range(8)]
U = np.uint64


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with anything that a set of n can link with: ceil(percent % of n)."""
    return -(-n * percent // 100)


def prefix(n: int, percent: int) -> int:
    """Length of the prefix: with the largest overlap missing, l(n) shared members lie in it."""
    return min(n, n - int(required(n, percent)) + 1 + n * MARGIN // 100)


def _least_shared(size: Column, percent: int) -> Column:
    """l of the smallest set that a set of ``size`` can link with."""
    return F.floor(F.floor((size * percent + 99) / 100) * MARGIN / 100) + 1


def _texts(batch: pa.RecordBatch, k: int):
    """Slices of a batch: row numbers, node and size of each text, and its set."""
    texts = batch.column("text")
    for lo, hi in slices(texts):
        words = cut(texts.slice(lo, hi - lo), fold=True)
        sums = running(words.hashes())
        nodes = between(sums, words.at[:-1], words.at[1:])
        yield lo, hi, nodes.astype(np.int64), list(shingle_sets(words, k))


def _nodes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, node) of every row; node is null for texts without words."""

    def run(batches):
        for batch in batches:
            for lo, hi, nodes, sets in _texts(batch, k):
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(nodes, mask=n == 0)], ["doc_id", "n_shingles", "node"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long")


def _rarest(found: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a sorted set, rarest first; ties go by hash."""
    rank = ranks[(found & U(TABLE - 1)).astype(np.int64)]
    return found[np.argsort(rank, kind="stable")[: prefix(len(found), percent)]]


def _combined(shingle: np.ndarray, node: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """What a task says of some prefixes.

    Of each shingle one row: its node, or null if it has several.  Of each node one
    row with ``copies`` 1 and the number of its shingles that other nodes here have.
    """
    by = np.argsort(shingle, kind="stable")
    shingle, node, size = shingle[by], node[by], size[by]
    new = np.ones(len(by), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(by)))
    several = n > 1  # a node has each shingle once
    met = np.repeat(several, n)
    each, at, back = np.unique(node, return_index=True, return_inverse=True)
    here = np.bincount(back, met, len(each)).astype(np.int32)
    none, one = np.zeros(len(first), np.int32), np.ones(len(each), np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([shingle[first].astype(np.int64), each])),
            pa.array(np.concatenate([node[first], each]), mask=np.concatenate([several, np.zeros(len(each), bool)])),
            pa.array(np.concatenate([none, size[at]])),
            pa.array(np.concatenate([none, here])),
            pa.array(np.concatenate([none, one])),
        ],
        ["key", "node", "size", "met", "copies"],
    )


def _likely(docs: DataFrame, k: int, percent: int, order) -> DataFrame:
    """(node): those with as many shared prefix shingles as any link needs."""

    def run(batches):
        ranks, seen, held, n_held = order.value, set(), [], 0
        for batch in batches:
            for _, _, nodes, sets in _texts(batch, k):
                for node, found in zip(nodes.tolist(), sets, strict=True):
                    if not len(found) or node in seen:
                        continue
                    seen.add(node)
                    own = _rarest(found, ranks, percent)
                    held.append((own, np.full(len(own), node), np.full(len(own), len(found), np.int32)))
                    n_held += len(own)
                    if n_held >= HELD:
                        yield _combined(*map(np.concatenate, zip(*held, strict=True)))
                        held, n_held = [], 0
        if held:
            yield _combined(*map(np.concatenate, zip(*held, strict=True)))

    rows = docs.select("text").mapInArrow(run, "key long, node long, size int, met int, copies int")
    alike = Window.partitionBy("key", "copies")
    rows = rows.withColumn("shared", (F.min("node").over(alike) != F.max("node").over(alike)) | (F.count("*").over(alike) > F.count("node").over(alike)))
    rows = rows.where("node is not null and (copies = 1 or shared)")
    # Each task that has a copy of a node says the same of it.
    found = rows.groupBy("node").agg(F.sum(F.when(F.col("copies") == 1, F.col("met")).otherwise(1)).alias("met"), F.sum("copies").alias("copies"), F.max("size").alias("size"))
    return found.where(F.col("met") >= F.col("copies") * _least_shared(F.col("size"), percent)).select("node")


def _signed(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, size, s0 to s7, text): one text and its signs for each of ``nodes``.

    A bit table of bounded size keeps most other texts out of the shuffle; the join
    that follows is exact.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(nodes, "node"))

    def some(batches):
        table, seen = bits.value, set()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                words = cut(part, fold=True)
                found = between(running(words.hashes()), words.at[:-1], words.at[1:]).astype(np.int64)
                new = []
                for i in np.flatnonzero(has_bit(table, found) & (words.counts > 0)):
                    if (node := int(found[i])) not in seen:
                        seen.add(node)
                        new.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(found[new]), part.take(pa.array(new, pa.int64()))], ["node", "text"])

    def sign(batches):
        for batch in batches:
            for lo, hi, _, sets in _texts(batch, k):
                each = np.array([sign_of(s) for s in sets], np.int64).reshape(-1, len(SIGNS))
                size = pa.array([len(s) for s in sets], pa.int32())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("node"), size, *map(pa.array, np.ascontiguousarray(each.T)), part.column("text")], ["node", "size", *SIGNS, "text"])

    texts = docs.select("text").mapInArrow(some, "node long, text string").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return texts.mapInArrow(sign, "node long, size int, " + ", ".join(f"{s} long" for s in SIGNS) + ", text string")


def _prefixes(texts: DataFrame, k: int, percent: int, order) -> DataFrame:
    """(shingle, node, size, pos): the prefixes of distinct texts."""

    def run(batches):
        ranks = order.value
        for batch in batches:
            for lo, hi, _, sets in _texts(batch, k):
                own = [_rarest(s, ranks, percent) for s in sets]
                n = np.array([len(x) for x in own])
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                node = np.repeat(batch.column("node").slice(lo, hi - lo).to_numpy(), n)
                size = np.repeat(np.array([len(s) for s in sets], np.int32), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype(np.int64)), pa.array(node), pa.array(size), pa.array(at.astype(np.int32))], ["shingle", "node", "size", "pos"])

    return texts.select("node", "text").mapInArrow(run, "shingle long, node long, size int, pos int")


def _may_link(size_a, pos_a, size_b, pos_b, percent: int):
    """Length and positional filters: can the pair's first shared prefix shingle be this one?"""
    most = F.least(size_a - pos_a, size_b - pos_b)
    return (100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)) & ((100 + percent) * most >= percent * (size_a + size_b))


def suffix_bound(a: np.ndarray, b: np.ndarray, need: int, depth: int = 3) -> bool:
    """Whether sorted sets may share ``need`` members, from the sizes of matching parts.

    Both are split at equally spaced members of ``a``; a part's overlap is at most its
    smaller side.
    """
    cuts = a[np.linspace(0, len(a), 2**depth + 1).astype(int)[1:-1]]
    parts_a = np.diff(np.concatenate([[0], np.searchsorted(a, cuts), [len(a)]]))
    parts_b = np.diff(np.concatenate([[0], np.searchsorted(b, cuts), [len(b)]]))
    return int(np.minimum(parts_a, parts_b).sum()) >= need


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The verification: suffix filter, then the exact intersection."""
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    if not suffix_bound(a, b, need):
        return False
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= need


def sign_of(found: np.ndarray) -> np.ndarray:
    """512 bits of a set: of the members that fall on a bit, whether they are odd in number."""
    bits = np.bincount(((found >> U(3)) & U(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def may_link(size_a: int, a: np.ndarray, size_b: int, b: np.ndarray, percent: int) -> bool:
    """Whether two sets may link, from their signs: bits that differ are at most as many as members in one set only."""
    need = -(-percent * (size_a + size_b) // (100 + percent))
    return int(np.unpackbits((a ^ b).view(np.uint8)).sum()) <= size_a + size_b - 2 * need


def _near_signs(a: list[str], b: list[str], size_a: Column, size_b: Column, percent: int) -> Column:
    """``may_link`` as an expression over the columns of two signs."""
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    need = F.ceil(percent * (size_a + size_b) / (100 + percent) - 1e-9)
    return differ <= size_a + size_b - 2 * need


def _of(texts: DataFrame, x: str, columns: list[str]) -> DataFrame:
    """``columns`` of the texts, named for side ``x`` of a pair."""
    return texts.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among distinct pairs (a, b) of nodes: by signs, then by both texts."""
    signs = ["size", *SIGNS]
    likely = pairs.join(_of(texts, "a", signs), "a").join(_of(texts, "b", signs), "b")
    likely = likely.where(_near_signs([f"{s}_a" for s in SIGNS], [f"{s}_b" for s in SIGNS], F.col("size_a"), F.col("size_b"), percent))
    likely = saved(likely.select("a", "b"), "likely")
    both = likely.join(_of(texts, "a", ["text"]), "a").join(_of(texts, "b", ["text"]), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        cache: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node, texts, i):
            if node not in cache:
                cache[node] = next(shingle_sets(cut(texts.slice(i, 1), fold=True), k))
                if len(cache) > 256:
                    cache.popitem(last=False)
            cache.move_to_end(node)
            return cache[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = [i for i in range(len(a)) if linked(of(a[i], batch.column("text_a"), i), of(b[i], batch.column("text_b"), i), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, b)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _mixed(rows: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """The prefix rows that nodes of different components share, with each node's root.

    Nodes with fewer of them than any link needs have no link outside their component.
    """
    if roots is not None:
        rows = rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    rows = saved(rows.join(more, "shingle", "left_semi").select("shingle", "node", "size", "pos", "root"), "mixed")
    able = rows.groupBy("node").agg(F.count("*").alias("n"), F.max("size").alias("size")).where(F.col("n") >= _least_shared(F.col("size"), percent))
    return rows.join(able.select("node"), "node", "left_semi")


def _cross_pairs(mixed: DataFrame) -> tuple[int, int]:
    """How many pairs of rows of one shingle are of different components, and how many rows there are."""
    n = mixed.groupBy("shingle", "root").count().groupBy("shingle").agg((F.pow(F.sum("count"), 2) - F.sum(F.pow("count", F.lit(2)))).alias("x"), F.sum("count").alias("n"))
    pairs, rows = n.agg(F.sum("x"), F.sum("n")).first()
    return int((pairs or 0) / 2), rows or 0


def _head_pairs(mixed: DataFrame, order: Column, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of each shingle's least node in ``order`` with its nodes of other components."""
    one = F.min_by(F.struct("node", "size", "pos", "root"), order).alias("x")
    heads = mixed.groupBy("shingle").agg(one).select("shingle", *[F.col(f"x.{c}").alias(f"{c}_b") for c in ("node", "size", "pos", "root")])
    return _ordered(mixed.join(heads, "shingle").where("root <> root_b").where(_may_link(F.col("size"), F.col("pos"), F.col("size_b"), F.col("pos_b"), percent)))


def _all_pairs(mixed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes of one shingle and different components that may link."""
    rows = mixed.join(texts.select("node", *SIGNS), "node")
    others = rows.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "pos", "root", *SIGNS)])
    both = rows.join(others, "shingle").where("root < root_b").where(_may_link(F.col("size"), F.col("pos"), F.col("size_b"), F.col("pos_b"), percent))
    return _ordered(both.where(_near_signs(SIGNS, [f"{s}_b" for s in SIGNS], F.col("size"), F.col("size_b"), percent)))


def _ordered(both: DataFrame) -> DataFrame:
    return both.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, node, root.

    component_id is the smallest doc_id reachable by links, the row's own
    included.  node is a hash of the text's words, root one of the component: rows
    are of one component when their roots are equal.  Each row is a document by
    itself: rows of one doc_id with different texts are in one component only if
    their texts are.  Null, empty and blank texts have n_shingles 0, their own id and
    neither node nor root.  A row without doc_id links with nothing and has no
    component_id and no root.  Other columns are ignored.  An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    able = docs.where("doc_id is not null")
    rows = saved(_nodes(docs, k), "nodes")

    def cells(batch):
        for _, _, _, sets in _texts(batch, k):
            if sets:
                yield (np.concatenate(sets) & U(TABLE - 1)).astype(np.int64)

    counts = summed(able.select("text"), TABLE, cells)
    order = docs.sparkSession.sparkContext.broadcast(np.floor(4 * np.log2(1 + counts)).astype(np.uint8))
    texts = saved(_signed(able, saved(_likely(able, k, percent, order), "likely"), k), "texts")
    shared = saved(_mixed(_prefixes(texts, k, percent, order).withColumn("root", F.col("node")), None, percent), "shared")

    tried = saved(_head_pairs(shared, F.struct("size", "node"), percent), "pairs")
    links = _verified(tried, texts, k, percent)
    roots = components(links)
    shared = saved(_mixed(shared, roots, percent), "shared")
    for seed in range(ROUNDS):
        pairs, left = _cross_pairs(shared)
        if pairs <= 2 * left:
            break
        more = saved(_head_pairs(shared, F.struct(F.xxhash64("node", "shingle", F.lit(seed)), "node"), percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        roots = _joined_roots(roots, _verified(more, texts, k, percent))
        tried = tried.union(more)
        shared = saved(_mixed(shared, roots, percent), "shared")
    last = saved(_all_pairs(shared, texts, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    if not last.isEmpty():
        roots = _joined_roots(roots, _verified(last, texts, k, percent))

    classes = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = saved(classes.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # a plain table: Spark can split a join's hot roots
    named = classes.join(least, "root").select("node", "component_id", "root")
    out = rows.join(named, "node", "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), "node", F.when(known, F.col("root")).alias("root"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``; all columns stay.

    It is the row of the smallest doc_id; of several with that id, the one of the
    least hash of words, then of all columns.  Rows without doc_id and rows without
    words link with nothing: all of them stay.
    """
    groups = saved(near_duplicates(docs, k, percent), "groups").where("root is not null")
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("x"))
    tag, lone, first_id, first_node = new_names(docs, "tag", "lone", "first_id", "first_node")
    text, ids = docs.columns.index("text"), docs.columns.index("doc_id")
    schema = StructType([*docs.schema.fields, StructField(tag, LongType()), StructField(lone, BooleanType())])
    names = schema.names

    def run(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in slices(batch.column(text)):
                rows = batch.slice(lo, hi - lo)
                words = cut(rows.column(text), fold=True)
                node = between(running(words.hashes()), words.at[:-1], words.at[1:])
                alone = (words.counts == 0) | ~rows.column(ids).is_valid().to_numpy(zero_copy_only=False)
                # Rows that stay anyway get a number of their own, so that they don't meet in one task.
                own = mix((np.arange(hi - lo) + done).astype(U) + (U(part) << U(40)))
                done += hi - lo
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.where(alone, own, node).astype(np.int64)), pa.array(alone)], names)

    tagged = docs.mapInArrow(run, schema)
    first = first.select(F.col("x.doc_id").alias(first_id), F.col("x.node").alias(first_node))
    both = tagged.join(first, (F.col(tag) == F.col(first_node)) & F.col("doc_id").cast("long").eqNullSafe(F.col(first_id)), "left")
    both = both.where(F.col(lone) | F.col(first_id).isNotNull())
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = Window.partitionBy(tag, "doc_id").orderBy(F.xxhash64(F.to_json(whole)))
    return both.withColumn(first_id, F.row_number().over(order)).where(F.col(first_id) == 1).select([f"`{c}`" for c in docs.columns])


def _joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
