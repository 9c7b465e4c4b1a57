"""Benchmark decontamination: size-partitioned MinHash containment search.

An item's set is its distinct five-word shingles (words lower-cased A-Z; an item
of fewer words has its whole sequence).  A document contains it when it holds at
least 75 % of them, wherever they stand.

Comparing MinHash sketches of a long document and a short item says little: the
document's other shingles take all the places.  So the sketch is the item's
alone, and the document answers with membership: each of the item's smallest
hashes is in the document with a chance equal to the containment, whatever the
document's size.  Items are partitioned by size.  A class with sets of up to u
shingles has sketches of floor(0.25 u) + 1, so a document that contains an item
misses fewer of its sketch than the sketch has, and at least ``sketch - floor
(0.25 n)`` members are found: the search loses nothing.  Candidates are then
verified by exact containment of all shingles.

Items are read in blocks of at most ``BLOCK_SHINGLES`` shingles, so what is
broadcast has a bound; a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.llm.words import between, cut, running, shingle_sets, slices

U = np.uint64
BLOCK_SHINGLES = 2_000_000
CLASSES = (1, 2, 3, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 1 << 40)


@dataclass
class Index:
    """Sketches and whole sets of a block of items, by hash."""

    ids: list
    sizes: np.ndarray
    need: np.ndarray  # members of the sketch that a containing document has at least
    sketch: np.ndarray  # sorted hashes
    sketch_item: np.ndarray
    hashes: np.ndarray  # all shingles, sorted
    owner: np.ndarray
    widths: list[int]  # lengths of the items' shingles in words


def indexed(items: list[tuple[object, str]], k: int, percent: int) -> Index:
    texts = pa.array([t for _, t in items], pa.string())
    words = cut(texts, fold=True)
    sets = list(shingle_sets(words, k))
    n = np.array([len(s) for s in sets], np.int64)
    lost = n * (100 - percent) // 100
    upper = np.array([next(c for c in CLASSES if c >= max(1, x)) for x in n.tolist()])
    size = np.minimum(upper * (100 - percent) // 100 + 1, n)

    # Another hash than the shingle's own picks the sketch, so that it is a random part of the set.
    def part(s, m):
        return s[np.argsort(s * U(0x9E3779B97F4A7C15) ^ (s >> U(29)), kind="stable")[:m]]

    picked = [part(s, m) for s, m in zip(sets, size.tolist(), strict=True)]
    at = np.arange(len(items))
    sketch, sketch_item = np.concatenate(picked or [np.zeros(0, U)]), np.repeat(at, [len(x) for x in picked])
    hashes, owner = np.concatenate(sets or [np.zeros(0, U)]), np.repeat(at, n)
    by, all_by = np.argsort(sketch, kind="stable"), np.argsort(hashes, kind="stable")
    widths = sorted({min(k, int(c)) for c in words.counts if c})
    return Index([i for i, _ in items], n, np.maximum(1, size - lost), sketch[by], sketch_item[by], hashes[all_by], owner[all_by], widths)


def _matches(found: np.ndarray, table: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The owners of all table entries that are among ``found`` (distinct)."""
    lo, hi = np.searchsorted(table, found, "left"), np.searchsorted(table, found, "right")
    n = hi - lo
    if not n.any():
        return np.zeros(0, np.int64)
    start = np.repeat(lo, n)
    return owner[start + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def found_in(texts: pa.Array, ix: Index, percent: int):
    """(row, item's place in the index, shingles found) for each text that contains an item."""
    words = cut(texts, fold=True)
    sums = running(words.hashes())
    last = np.repeat(words.at[1:], words.counts)
    text = words.text_of()
    grams, owner, asked_by, asked = [], [], [], []
    distinct = np.unique(ix.sketch)
    if not len(distinct):
        return
    for w in ix.widths:
        first = np.flatnonzero(np.arange(len(text)) + w <= last)
        g = between(sums, first, first + w)
        hit = distinct[np.minimum(np.searchsorted(distinct, g), len(distinct) - 1)] == g
        grams.append(g)
        owner.append(text[first])
        asked.append(g[hit])
        asked_by.append(text[first[hit]])
    asked, asked_by = np.concatenate(asked), np.concatenate(asked_by)
    by = np.argsort(asked_by, kind="stable")
    rows, start = np.unique(asked_by[by], return_index=True)
    for d, mine in zip(rows.tolist(), np.split(asked[by], start[1:]), strict=False):
        some, times = np.unique(_matches(np.unique(mine), ix.sketch, ix.sketch_item), return_counts=True)
        some = some[times >= ix.need[some]]
        if not len(some):
            continue
        own = np.unique(np.concatenate([g[slice(*np.searchsorted(o, (d, d + 1)))] for g, o in zip(grams, owner, strict=True)]))
        whole = np.bincount(_matches(own, ix.hashes, ix.owner), minlength=len(ix.ids))[some]
        for i, c in zip(some.tolist(), whole.tolist(), strict=True):
            if 100 * c >= percent * ix.sizes[i]:
                yield d, i, c


def contained(docs: DataFrame, items: list[tuple[object, str]], k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_item, n_found) for documents that contain an item of one block."""
    index = docs.sparkSession.sparkContext.broadcast(indexed(items, k, percent))

    def run(batches):
        ix = index.value
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for lo, hi in slices(texts):
                out = [(ids[lo + d].as_py(), ix.ids[i], int(ix.sizes[i]), c) for d, i, c in found_in(texts.slice(lo, hi - lo), ix, percent)]
                cols = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_item", "n_found"])

    return docs.mapInArrow(run, "doc_id long, item_id long, n_item long, n_found long")


def blocks(benchmark: DataFrame, most: int = BLOCK_SHINGLES):
    """The items, as lists of at most ``most`` shingles (or one item) each, streamed to the driver."""
    held, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).toLocalIterator():
        size = 1 + len(r["t"].split())
        if held and n + size > most:
            yield held
            held, n = [], 0
        held.append((r["i"], r["t"]))
        n += size
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_item, n_found, containment) for each document and item that it contains.

    Null, empty and blank items are contained in nothing, and nothing is contained
    in such documents.  Repeated rows on either side give repeated pairs.  An
    empty table on either side gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks(benchmark):
        found = contained(docs, block, k, percent)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item long, n_found long")
    return out.withColumn("containment", F.col("n_found") / F.col("n_item"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns stay."""
    at = docs.columns.index("text")
    for block in blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(indexed(block, k, percent))

        def run(batches, index=index):
            for batch in batches:
                for lo, hi in slices(batch.column(at)):
                    part = batch.slice(lo, hi - lo)
                    clean = np.ones(hi - lo, bool)
                    clean[[d for d, _, _ in found_in(part.column(at), index.value, percent)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
