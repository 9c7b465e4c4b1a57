"""Substring dedup: repeated passages, located by sharded Aho-Corasick automata.

A window is ``width`` consecutive words of one text.  Every word inside a window
whose words also start anywhere else, in the same text or another, is removed.

1. Texts alike in all words have one class, by hash.  A class of several texts
   of ``width`` words or more goes whole, and counts twice below.
2. Each window has an anchor, its smallest hash of ``GRAM`` words.  Equal windows
   have equal anchors, and neighbours share theirs, so there is about one anchor
   in 14 words.  Anchors are counted over the corpus; one that occurs once can
   not be in a recurring window.  (Schleimer et al., "Winnowing", 2003.)
3. Windows with a recurring anchor are hashed and counted: this confirms them, and
   says where one occurrence of each is, from which its words are read.  Neighbouring
   windows of one anchor are one passage.  Counts have map-side partial sums, so the commonest passage costs one row a task.
4. Confirmed passages are dealt to shards by their anchors, and each shard is
   compiled into an automaton over what the windows of each passage share.  Where a passage occurs else is not known by then:
   every text of every class is streamed, cut to the stretches around its confirmed
   anchors, through the shards of these anchors, and the automata locate all
   occurrences.  A text meets only shards that can hold something of it, so the work
   grows with the corpus and not with corpus times passages.  Shards are as many as
   keep an automaton small; a shard with many stretches is compiled in several tasks.
"""

from __future__ import annotations

import hashlib
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.llm.shared import saved
from taproot.llm.sketch import bit_table, has_bit
from taproot.llm.words import Words, as_array, between, cut, running, slices

U = np.uint64
GRAM = 8
_EMPTY = hashlib.sha256(b"").hexdigest()


def _classes(words: Words, hashes: np.ndarray) -> np.ndarray:
    sums = running(hashes)
    return between(sums, words.at[:-1], words.at[1:]).astype(np.int64)


def _windows(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, the first word of its anchor, and hashes of grams by first word."""
    n = len(hashes)
    last = np.repeat(words.at[1:], words.counts)
    first = np.flatnonzero(np.arange(n) + width <= last)
    if not len(first):
        return first, first, np.zeros(0, U)
    at = np.arange(n - GRAM + 1)
    grams = between(running(hashes), at, at + GRAM)
    least = sliding_window_view(grams, width - GRAM + 1).argmin(1)
    return first, least[first] + first, grams


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, class, n_words, whole): every row, with the digest of all its words."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                words = cut(texts.slice(lo, hi - lo))
                raw = words.buf.tobytes()
                whole = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(words.off[:-1].tolist(), words.off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(_classes(words, words.hashes())), pa.array(words.counts.astype(np.int64)), pa.array(whole, pa.string())], ["doc_id", "class", "n_words", "whole"])

    return docs.mapInArrow(run, "doc_id long, class long, n_words long, whole string")


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    """(anchor, class, pos) of every text, once per task and class."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                words = cut(texts.slice(lo, hi - lo))
                hashes = words.hashes()
                classes = _classes(words, hashes)
                first, anchor, grams = _windows(words, hashes, width)
                if not len(first):
                    continue
                new = np.zeros(len(classes), bool)
                for i, c in enumerate(classes.tolist()):
                    if c not in seen:
                        seen.add(c)
                        new[i] = True
                # anchors never decrease inside a text
                change = np.ones(len(first), bool)
                change[1:] = anchor[1:] != anchor[:-1]
                anchor = anchor[change]
                text = words.text_of()[anchor]
                anchor, text = anchor[new[text]], text[new[text]]
                yield pa.RecordBatch.from_arrays([pa.array(grams[anchor].astype(np.int64)), pa.array(classes[text]), pa.array((anchor - words.at[text]).astype(np.int32))], ["anchor", "class", "pos"])

    return docs.select("text").mapInArrow(run, "anchor long, class long, pos int")


def _texts(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(class, text, spots): one text for each class with recurring anchors.

    A bit table of bounded size keeps most other texts out of the shuffle.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(hits, "class"))

    def run(batches):
        table, seen = bits.value, set()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                words = cut(part)
                classes = _classes(words, words.hashes())
                new = []
                for i in np.flatnonzero(has_bit(table, classes)):
                    if (c := int(classes[i])) not in seen:
                        seen.add(c)
                        new.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(classes[new]), part.take(pa.array(new, pa.int64()))], ["class", "text"])

    return docs.select("text").mapInArrow(run, "class long, text string").join(hits, "class").dropDuplicates(["class"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and value of each member of a list column."""
    column = as_array(column)
    n = np.diff(np.asarray(column.offsets))
    return np.repeat(np.arange(len(column)), n), np.asarray(column.flatten())


def _counted(texts: DataFrame, width: int) -> DataFrame:
    """(window, anchor, class, start, weight) of windows with a recurring anchor."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for lo, hi in slices(column):
                words = cut(column.slice(lo, hi - lo))
                hashes = words.hashes()
                first, anchor, grams = _windows(words, hashes, width)
                row, spot = _lists(batch.column("spots").slice(lo, hi - lo))
                keep = np.isin(anchor, words.at[row] + spot)
                first, anchor = first[keep], anchor[keep]
                text = words.text_of()[first]
                window = between(running(hashes), first, first + width)
                classes, copied = batch.column("class").slice(lo, hi - lo).to_numpy(), batch.column("copied").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(window.astype(np.int64)), pa.array(grams[anchor].astype(np.int64)), pa.array(classes[text]), pa.array((first - words.at[text]).astype(np.int32)), pa.array((1 + copied[text]).astype(np.int32))], ["window", "anchor", "class", "start", "weight"])

    return texts.mapInArrow(run, "window long, anchor long, class long, start int, weight int")


def _passages(texts: DataFrame, confirmed: DataFrame, width: int) -> DataFrame:
    """(anchor, n, passage): runs of ``n`` neighbouring confirmed windows of one anchor, from the text that they were first seen in.

    A run is so short that its windows have ``GRAM`` words in common.
    """
    from_text = confirmed.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("start", "anchor"))).alias("own"))
    most = width - GRAM + 1

    def run(batches):
        for batch in batches:
            own = as_array(batch.column("own"))
            bounds = np.asarray(own.offsets)
            starts, anchors = own.values.field(0).to_numpy(), own.values.field(1).to_numpy()
            for lo, hi in slices(batch.column("text")):
                words = cut(batch.column("text").slice(lo, hi - lo))
                raw = words.buf.tobytes()
                some = slice(bounds[lo], bounds[hi])
                first, anchor = np.repeat(words.at[:-1], np.diff(bounds[lo : hi + 1])) + starts[some], anchors[some]
                new = np.ones(len(first), bool)
                new[1:] = (first[1:] != first[:-1] + 1) | (anchor[1:] != anchor[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
                new |= (np.arange(len(first)) - head) % most == 0
                begin = np.flatnonzero(new)
                n = np.diff(np.append(begin, len(first)))
                first = first[begin]
                passages = [raw[i:j] for i, j in zip(words.start[first].tolist(), words.end[first + n + width - 2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[begin]), pa.array(n.astype(np.int32)), pa.array(passages, pa.binary()).cast(pa.string())], ["anchor", "n", "passage"])

    return texts.select("class", "text").join(from_text, "class").mapInArrow(run, "anchor long, n int, passage string")


def _stretches(texts: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """(anchor, class, first, stretch): what windows of each confirmed anchor can cover, from word ``first`` on.

    A bit table of bounded size keeps most unconfirmed anchors out; others meet no passage.
    """
    bits = texts.sparkSession.sparkContext.broadcast(bit_table(anchors, "anchor"))

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                words = cut(batch.column("text").slice(lo, hi - lo))
                hashes = words.hashes()
                row, spot = _lists(batch.column("spots").slice(lo, hi - lo))
                at = words.at[row] + spot
                if not len(at):
                    continue
                grams = between(running(hashes), at, at + GRAM).astype(np.int64)
                keep = has_bit(bits.value, grams)
                row, at, grams = row[keep], at[keep], grams[keep]
                low = np.maximum(words.at[row], at - (width - GRAM))
                high = np.minimum(words.at[row + 1], at + width)
                raw = words.buf.tobytes()
                found = [raw[i:j] for i, j in zip(words.start[low].tolist(), words.end[high - 1].tolist(), strict=True)]
                classes = batch.column("class").slice(lo, hi - lo).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(classes), pa.array((low - words.at[row]).astype(np.int32)), pa.array(found, pa.binary()).cast(pa.string())], ["anchor", "class", "first", "stretch"])

    return texts.select("class", "text", "spots").mapInArrow(run, "anchor long, class long, first int, stretch string")


class Automaton:
    """An Aho-Corasick automaton over the words of passages, each of ``n`` windows of ``width`` words.

    Its keys are the passages' cores, the words that all windows of a passage share.
    Where a core is found, the passage is compared with the words on both sides, which
    tells which of its windows are there.  A word is two symbols, as the automaton
    looks through a node's children one by one.
    """

    def __init__(self, passages: pa.Array, n: np.ndarray, width: int):
        words = cut(passages)
        self.known, self.ids = np.unique(words.hashes(), return_inverse=True)
        self.width, self.n = width, n.astype(np.int64)
        self.low = 1 + len(self.known) // 256 + 1
        self.core = words.at[:-1] + self.n - 1  # the first word of each core; it ends ``width`` words after the passage's first
        self.end = words.at[:-1] + width
        symbols, cores = self._symbols(self.ids), {}
        for i, (a, b) in enumerate(zip((2 * self.core).tolist(), (2 * self.end).tolist(), strict=True)):
            cores.setdefault(tuple(symbols[a:b]), []).append(i)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for core, owners in cores.items():
            self.found.add_word(core, owners)
        self.found.make_automaton()

    def _symbols(self, ids: np.ndarray) -> list[int]:
        """Two numbers for each id, of ranges that don't meet; 0 stands for unknown words (-1)."""
        out = np.zeros((len(ids), 2), np.int64)
        known = ids >= 0
        out[known, 0] = 1 + ids[known] // 256
        out[known, 1] = self.low + ids[known] % 256
        return out.ravel().tolist()

    def locate(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, low, high): the words of each text that a run of windows covers, a row for each place of a passage."""
        words = cut(texts)
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        ids = np.where(self.known[at] == hashes, at, -1)
        symbols, bounds = self._symbols(ids), (2 * words.at).tolist()
        where, which, text = [], [], []
        for t, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            for end, owners in self.found.iter(tuple(symbols[i:j])):
                for o in owners:
                    where.append((i + end + 1) // 2)
                    which.append(o)
                    text.append(t)
        where, which, text = (np.array(x, np.int64) for x in (where, which, text))
        n, core = self.n[which], where - (self.end - self.core)[which]
        left, right = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        low, high = words.at[text], words.at[text + 1]
        for step in range(1, int(self.n.max(initial=1))):
            # as long as words before the core, and after it, are alike
            on = (left == step - 1) & (step < n) & (core - step >= low)
            left[on] += ids[core[on] - step] == self.ids[self.core[which[on]] - step]
            on = (right == step - 1) & (step < n) & (where + step <= high)
            right[on] += ids[where[on] + step - 1] == self.ids[self.end[which[on]] + step - 1]
        there = left + right >= n - 1
        return text[there], (core - left - low)[there], (where + right - low)[there]


def _occurrences(stretches: DataFrame, passages: DataFrame, width: int, shard: int, task: int) -> DataFrame:
    """(class, low, high): the words that passages cover, as ranges, from each shard's automaton.

    A shard has about ``shard`` passages, those of its anchors.  If it has more than
    twice as many, as for one anchor of very many passages, they are dealt to several
    automata and its stretches go through each.  Its stretches are split by class into
    as many tasks as have about ``task`` of them each.
    """
    n = max(1, math.ceil(passages.count() / shard))
    passages = passages.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n)))
    stretches = stretches.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n)))
    deals = passages.groupBy("shard").agg(F.ceil(F.count("*") / (2 * shard)).alias("deals"))
    parts = stretches.groupBy("shard").agg(F.ceil(F.count("*") / task).alias("parts"))
    dealt = saved(parts.join(deals, "shard"), "shards")

    def numbers(column):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(column) - 1))

    stretches = stretches.join(dealt, "shard").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))).withColumn("deal", numbers("deals"))
    passages = passages.join(dealt, "shard").withColumn("deal", F.pmod(F.xxhash64("passage"), F.col("deals"))).withColumn("part", numbers("parts"))
    key = ["shard", "deal", "part"]
    stretches, passages = stretches.select(*key, "class", "first", "stretch"), passages.select(*key, "n", "passage")

    def run(_, left, right):
        out = []
        if left.num_rows and right.num_rows:
            automaton = Automaton(as_array(right["passage"]), right["n"].to_numpy(), width)
            texts, first, own = as_array(left["stretch"]), left["first"].to_numpy(), left["class"].to_numpy()
            for lo, hi in slices(texts):
                text, low, high = automaton.locate(texts.slice(lo, hi - lo))
                out.append((own[lo:hi][text], first[lo:hi][text] + low, first[lo:hi][text] + high))
        found = np.unique(np.concatenate([np.stack(x, 1) for x in out] or [np.zeros((0, 3), np.int64)]), axis=0)
        return pa.table({"class": pa.array(found[:, 0].astype(np.int64)), "low": pa.array(found[:, 1].astype(np.int32)), "high": pa.array(found[:, 2].astype(np.int32))})

    return stretches.groupBy(*key).cogroup(passages.groupBy(*key)).applyInArrow(run, "class long, low int, high int")


def _marked(texts: DataFrame) -> DataFrame:
    """(class, n_removed, kept) of (class, text, ranges)."""

    def run(batches):
        for batch in batches:
            ranges = as_array(batch.column("ranges"))
            bounds = np.asarray(ranges.offsets)
            low, high = ranges.values.field(0).to_numpy(), ranges.values.field(1).to_numpy()
            for lo, hi in slices(batch.column("text")):
                words = cut(batch.column("text").slice(lo, hi - lo))
                own = slice(bounds[lo], bounds[hi])
                base = np.repeat(words.at[:-1], np.diff(bounds[lo : hi + 1]))
                step = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(step, base + low[own], 1)
                np.add.at(step, base + high[own], -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.at[:-1]) * (words.counts > 0)
                raw, kept = words.buf.tobytes(), []
                for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
                    rest = (a + np.flatnonzero(~gone[a:b])).tolist()
                    kept.append(hashlib.sha256(b" ".join([raw[words.start[j] : words.end[j]] for j in rest])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("class").slice(lo, hi - lo), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], ["class", "n_removed", "kept"])

    return texts.mapInArrow(run, "class long, n_removed long, kept string")


def without_repeats(docs: DataFrame, width: int = 35, shard: int = 8_000, task: int = 60_000) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_sha256.

    Words are cut and compared unchanged.  Texts shorter than a window, null and
    empty ones lose nothing.  Repeated rows repeat each other's windows, whatever
    their ids.  An empty table gives an empty result.  ``shard`` is the number of passages
    of an automaton, ``task`` that of stretches of text which one task streams
    through it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = saved(_rows(docs), "rows")
    copies = rows.where(F.col("n_words") >= width).groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class", F.lit(True).alias("copied"))
    copies = saved(copies, "copies")

    anchors = _anchors(docs, width)
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    often = saved(often, "anchors")  # a plain table: Spark can split a join's hot keys only where no aggregation is below it
    hits = anchors.join(often, "anchor").groupBy("class").agg(F.collect_set("pos").alias("spots"))
    hits = hits.join(copies, "class", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    texts = saved(_texts(docs, saved(hits, "hits")), "texts")

    windows = _counted(texts, width).groupBy("window").agg(F.sum("weight").alias("n"), F.min(F.struct("class", "start", "anchor")).alias("x"))
    confirmed = saved(windows.where("n > 1").select("x.*"), "windows")
    passages = saved(_passages(texts, confirmed, width), "passages")
    own = texts.where("not copied")
    stretches = saved(_stretches(own, confirmed.select("anchor").distinct(), width), "stretches")
    ranges = _occurrences(stretches, passages, width, shard, task).groupBy("class").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    found = _marked(own.select("class", "text").join(ranges, "class"))

    out = rows.join(copies, "class", "left").join(found, "class", "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= width)
    return out.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )
