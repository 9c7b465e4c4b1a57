"""Token counts by a map-side lookup in two tiers.

A unit is a run of non-space with at most one space before it, or what is left
of a run of white space; the tokenizer's pattern never makes a pre-token across
a unit's ends, so a text's tokens are the sum over its units.  Units are cut and
hashed with numpy.  Tier one is a broadcast table of the hashes and token counts
of the corpus's frequent units (at most ``FREQUENT``); tier two is a cache in
each Python worker, filled by encoding what tier one misses and emptied at
``CACHED`` entries.  Rows and their units are never shuffled.  To make tier one, each
task passes on its most frequent units, ``FREQUENT // 4`` at most, with their counts;
packed by hash into ``SLICES`` tables, these are merged in three rounds.

Texts with special strings or white space outside ASCII go to the library whole.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.llm.words import _BYTE, Words, between, cut, running, slices

U = np.uint64
FREQUENT = 1 << 16
FAN_IN = 128
SLICES = 16
CACHED = 1_000_000
#: White space, or what some Unicode versions take for it, other than the six ASCII separators.
_ODD = "[\u001c-\u001f\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"

_loaded: dict[str, object] = {}
_cache: dict[str, dict[int, int]] = {}


class Counter:
    """How a library counts the tokens of whole strings."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.units = False  # its pieces cross spaces
            self._encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._tok = tok
            kind = str(tok.pre_tokenizer)
            self.units = tok.normalizer is None and "ByteLevel(add_prefix_space=False" in kind and "use_regex=True" in kind
            self.special = [t.content for t in tok.get_added_tokens_decoder().values()]

    def counts(self, texts: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return [len(x) for x in self._encode(texts, num_threads=1)]
        return [len(x) for x in self._tok.encode_batch_fast(texts, add_special_tokens=False)]


def _counter(path: str) -> Counter:
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Counter(path)
    return _loaded[path]


def units(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The units of each text: words (for buf and off), starts, ends, and each one's text."""
    words = cut(texts)
    text = words.text_of()
    buf, off = words.buf, words.off
    begin = off[text]
    before = words.start - 1
    joined = (before >= begin) & (buf[np.maximum(before, 0)] == 0x20)
    first = words.start - joined
    # What lies between a unit and the end of the one before it.
    fresh = np.ones(len(text), bool)
    fresh[1:] = text[1:] != text[:-1]
    gap = begin.copy()
    gap[~fresh] = words.end[:-1][~fresh[1:]]
    # Of a run of white space before a word, the last one stands alone if it isn't joined.
    alone = ~joined & (first > gap)
    inner_end = first - alone
    run = inner_end > gap
    n = np.diff(off)
    tail = off[:-1].copy()
    has = words.counts > 0
    tail[has] = words.end[words.at[1:][has] - 1]
    rest = (tail < off[1:]) & (n > 0)
    start = np.concatenate([first, gap[run], first[alone] - 1, tail[rest]])
    end = np.concatenate([words.end, inner_end[run], first[alone], off[1:][rest]])
    owner = np.concatenate([text, text[run], text[alone], np.flatnonzero(rest)])
    return words, start, end, owner


def _plain(texts: pa.Array, special: list[str]) -> np.ndarray:
    odd = pc.match_substring_regex(texts, _ODD)
    for s in special:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    return ~np.asarray(odd.to_numpy(zero_copy_only=False), bool)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    texts = texts.fill_null("") if texts.null_count else texts
    for lo, hi in slices(texts):
        yield lo, hi, texts.slice(lo, hi - lo)


def frequent_units(docs: DataFrame, path: str, most: int = FREQUENT) -> dict[int, int]:
    """Tier one: hash to token count of the most frequent units of all texts.

    Each task holds counts of at most 4 * ``most`` units at a time (rarer ones are
    let go) and passes on ``most // 4``; packed tables are merged in three rounds, each
    slice of the hashes by itself.  What is let go only costs an encoding later, never a
    wrong count.
    """

    def top_of(count: dict, n: int) -> list[int]:
        return sorted(count, key=lambda h: (-count[h], h))[:n]

    def packed(units: list) -> bytes:
        return zlib.compress(pickle.dumps(units), 1)

    def task(batches):
        count: dict[int, int] = {}
        text: dict[int, bytes] = {}
        for batch in batches:
            for _, _, part in _pieces(batch.column("text")):
                words, start, end, _ = units(part)
                keys = between(running(_BYTE[words.buf]), start, end)
                found, at, times = np.unique(keys, return_index=True, return_counts=True)
                often = np.flatnonzero(times > 1)
                for h, i, c in zip(found[often].tolist(), at[often].tolist(), times[often].tolist(), strict=True):
                    if h in count:
                        count[h] += c
                    elif end[i] - start[i] <= 64:
                        count[h] = c
                        text[h] = words.buf[start[i] : end[i]].tobytes()
                if len(count) > 4 * most:
                    top = sorted(count, key=count.__getitem__, reverse=True)[:most]
                    count, text = {h: count[h] for h in top}, {h: text[h] for h in top}
        if count:
            bin, parts = TaskContext.get().partitionId() // FAN_IN, [[] for _ in range(SLICES)]
            for h in top_of(count, most // 4):
                parts[h % SLICES].append((h, count[h], text[h]))
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([bin] * SLICES, pa.int32()), pa.array(map(packed, parts), pa.binary())], ["slice", "bin", "units"])

    def merge(table):
        count: dict[int, int] = {}
        text: dict[int, bytes] = {}
        for blob in table["units"]:
            for h, c, t in pickle.loads(zlib.decompress(blob.as_py())):
                count[h] = count.get(h, 0) + c
                text[h] = t
        top = [(h, count[h], text[h]) for h in top_of(count, most // SLICES)]
        return pa.table({"slice": table["slice"][:1], "bin": pa.array([table["bin"][0].as_py() // FAN_IN], pa.int32()), "units": pa.array([packed(top)], pa.binary())})

    schema = "slice int, bin int, units binary"
    found = docs.mapInArrow(task, schema)
    for _ in range(3):  # FAN_IN tables a group at most, for up to FAN_IN ** 3 tasks
        found = found.groupBy("slice", "bin").applyInArrow(merge, schema)
    top = [u for row in found.collect() for u in pickle.loads(zlib.decompress(row["units"]))]
    lengths = _counter(path).counts([t.decode() for _, _, t in top])
    return {h: n for (h, _, _), n in zip(top, lengths, strict=True)}


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit.

    ``path`` is a tokenizers ``.json`` or a sentencepiece ``.model`` file that all
    executors have.  Null and empty texts have no bytes and no tokens.  Special
    strings inside texts are handled as the library does by default.  Repeated
    rows are counted each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counter = _counter(path)
    table = frequent_units(docs.select("text"), path) if counter.units else {}
    keys = np.array(sorted(table), U)
    tier_one = spark.sparkContext.broadcast((keys, np.array([table[int(k)] for k in keys], np.int32)))

    def lookup(keys, words, start, end):
        """Token counts of distinct units, by their hashes."""
        known, lengths = tier_one.value
        out = np.zeros(len(keys), np.int64)
        found = np.zeros(len(keys), bool)
        if len(known):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found = known[at] == keys
            out[found] = lengths[at[found]]
        cache = _cache.setdefault(path, {})
        todo = []
        for i, h in zip(np.flatnonzero(~found).tolist(), keys[~found].tolist(), strict=True):
            if (n := cache.get(h)) is None:
                todo.append((i, h))
            else:
                out[i] = n
        if todo:
            raw = words.buf.tobytes()
            lengths = _counter(path).counts([raw[start[i] : end[i]].decode() for i, _ in todo])
            if len(cache) + len(todo) > CACHED:
                cache.clear()
            for (i, h), n in zip(todo, lengths, strict=True):
                out[i] = cache[h] = n
        return out

    def run(batches):
        c = _counter(path)
        for batch in batches:
            for lo, hi, part in _pieces(batch.column("text")):
                n_bytes = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
                tokens = np.zeros(hi - lo, np.int64)
                plain = _plain(part, c.special) if c.units else np.zeros(hi - lo, bool)
                if plain.any():
                    some = part.filter(pa.array(plain))
                    words, start, end, owner = units(some)
                    keys = between(running(_BYTE[words.buf]), start, end)
                    distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
                    each = lookup(distinct, words, start[at], end[at])[back]
                    tokens[plain] = np.bincount(owner, each, len(some)).astype(np.int64)
                if not plain.all():
                    tokens[~plain] = c.counts(part.filter(pa.array(~plain)).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
