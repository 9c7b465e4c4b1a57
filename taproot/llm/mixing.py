"""Mixing sources to target weights by weighted fair queueing.

Targets share the budget by weight; none exceeds ``most`` times its source's
size, and what is over goes to the others by weight until none is above.

Each source is a queue of its documents in a shuffled order, once for each time
that it may be repeated.  A copy's virtual finish time is the running size of
its source up to its end, divided by the source's target: every source reaches
time 1 as it reaches its target.  All copies are taken in order of that time
until the budget is spent.

Running sums need no task that holds a source.  The shuffled order is a hash,
its leading bits are a bucket, sums of whole buckets are added up over a table
of a bounded number of buckets, and only rows inside one bucket are ordered.
The final cut is done alike, over buckets of the finish time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.llm.shared import saved

WEIGHTS = (5.0, 2.0, 1.0)
ROWS_IN_BUCKET = 4_000


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, target) for each source; weights go by code point of the source, null last.

    Sources in the order of what they can take for their weight: those before the
    first that can take its part of what is left are full, the others share it by
    weight.  The table has one row a source, and its order is found in one task; it
    never leaves the executors.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1)).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    free = rows.where("source_size > 0").withColumn("rank", F.row_number().over(order))
    free = free.withColumn("full", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    free = free.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.col("full"))
    first = F.min(F.when(F.col("left") * F.col("weight") / F.col("weights") <= F.col("most"), F.struct("rank", "left", "weights"))).over(Window.partitionBy()).alias("first")
    free = free.select("source", "most", "weight", "rank", first)
    own = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("most")).otherwise(F.col("first.left") * F.col("weight") / F.col("first.weights"))
    free = free.select(F.col("source").alias("free"), own.alias("target"))
    return rows.join(free, rows["source"].eqNullSafe(free["free"]), "left").select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def shuffled(doc_id: Column, seed: int) -> Column:
    """The place of a row in its queue: 60 bits of a digest that other engines have too; rows without id share one."""
    text = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _running(rows: DataFrame, by: list[str], bucket: str, order: list[str]) -> DataFrame:
    """``rows`` with upto: the running sum of size over ``by``, up to and with each row.

    ``bucket`` must not fall along ``order``.
    """
    sums = rows.groupBy(*by, bucket).agg(F.sum("size").alias("whole"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("whole").over(before), F.lit(0))).drop("whole")
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    alike = [rows[c].eqNullSafe(sums[c]) for c in (*by, bucket)]
    rows = rows.join(sums, alike).select(rows["*"], sums["below"])
    return rows.withColumn("upto", F.col("below") + F.sum("size").over(within)).drop("below")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 17) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)``: doc_id, size, source_size, target, taken.

    taken is the words that the mix takes of the row, repeats counted: a multiple
    of its size, ``most`` times at most.  Null and empty texts have size 0 and are
    not taken; rows without a source are a source of their own, the last.
    Repeated rows are taken each on its own.  The order is that of a digest of id and
    seed, then of size, so reruns agree.  An empty table gives an empty result.

    Rows inside one bucket are put in order in one task.  There are at most 2**16
    buckets a source, so beyond some 260 million rows buckets grow.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    sized = saved(sized, "sizes")
    goal = saved(targets(sized, weights, share, most), "targets")
    n = sized.count()
    bits = min(16, max(4, math.ceil(math.log2(max(1, n / ROWS_IN_BUCKET)))))

    joined = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).select("doc_id", "size", sized["source"], "source_size", "target")
    queue = joined.where("size > 0 and target > 0").withColumn("key", shuffled(F.col("doc_id"), seed)).withColumn("bucket", F.shiftright("key", 60 - bits))
    queue = saved(_running(queue, ["source"], "bucket", ["key", "doc_id", "size"]), "queues")

    # Round r of a source runs from r * source_size on; no target reaches beyond round most - 1.
    def finish(r):
        return (F.col("upto") + r * F.col("source_size")) / F.col("target")

    slots = 1 << bits + 2
    copies = queue.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", finish(F.col("round")))
    copies = copies.withColumn("slot", F.floor(F.least("finish", F.lit(2.0)) * slots))
    budget = min(share, most) * float(goal.agg(F.sum("source_size")).first()[0] or 0)
    below = F.coalesce(F.sum("whole").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = copies.groupBy("slot").agg(F.sum("size").alias("whole")).withColumn("below", below).where(F.col("below") < budget).orderBy(F.desc("slot")).first()
    taken = F.lit(0)
    if last:
        # Only the slot in which the budget ends is put in order; a copy that fits by half is taken.
        order = Window.orderBy("finish", "key", "doc_id", "size", "round").rowsBetween(Window.unboundedPreceding, 0)
        edge = copies.where(F.col("slot") == last["slot"]).withColumn("all", F.lit(last["below"]) + F.sum("size").over(order)).where(F.col("all") - F.col("size") / 2 <= budget)
        edge = edge.agg(F.max(F.struct("finish", "key", "doc_id", "size", "round")).alias("x")).select("x.*").first()
        if edge["finish"] is None:
            ends = [finish(r) < last["slot"] / slots for r in range(most)]
        else:
            stop = F.struct(*[F.lit(edge[c]).cast(t).alias(c) for c, t in (("finish", "double"), ("key", "long"), ("doc_id", "long"), ("size", "long"), ("round", "int"))])
            ends = [F.struct(finish(r).alias("finish"), F.col("key"), F.col("doc_id"), F.col("size"), F.lit(r).alias("round")) <= stop for r in range(most)]
        taken = sum((e.cast("long") for e in ends), F.lit(0)) * F.col("size")
    rest = joined.where("not (size > 0 and target > 0)").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return queue.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken")).union(rest)
