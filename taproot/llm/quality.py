"""Quality rules on documents, with verdicts on the hosts that they come from.

Each text is measured once, in a map.  Failures are counted by host with
map-side partial sums, so a host with a third of all rows costs one row a task.
A host's failure rate is shrunk towards the corpus by a beta prior whose two
parameters are fitted to all hosts by moments; a host whose shrunk rate reaches
``bound`` for a rule is rejected, and its verdict is joined back to its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.llm.shared import saved
from taproot.llm.words import cut, gram_hashes, mix, slices

U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules on one document; the first two make base_failed.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * word_chars",
    "dup_lines": "2 * n_dup_lines > n_words",
}


def _repeated(words, width: int = 5) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    n = len(words.start)
    grams, first = gram_hashes(words, width)
    if not len(grams):
        return np.zeros(len(words.at) - 1, np.int64)
    key = mix(grams + mix(words.text_of()[first].astype(U) + U(1)))
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    twice = np.zeros(len(key), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + width, -1)
    return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(step[:n]) > 0)])[words.at])


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the five counts of each row's whole text (null: empty)."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                words = cut(texts.slice(lo, hi - lo))
                buf, off = words.buf, words.off
                inside = np.zeros(len(buf) + 1, np.int8)
                inside[words.start] += 1
                np.subtract.at(inside, words.end, 1)
                letters = (np.cumsum(inside[:-1], dtype=np.int64) > 0) & ((buf & 0xC0) != 0x80)
                # a word that ends where the next text's word starts: both marks meet, the sum stays 1
                chars = np.concatenate([[0], np.cumsum(letters)])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
                raw = buf.tobytes()
                dup = [_dup_lines(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                out = [words.counts, np.diff(chars[off]), np.diff(symbols[off]), np.array(dup, np.int64), _repeated(words)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "host")] + [pa.array(x.astype(np.int64)) for x in out], ["doc_id", "host", *MEASURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def host_rates(rows: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Per host: n and, for each rule, the failures and their rate under the beta prior.

    The prior's mean is the corpus rate p.  Its weight is (p (1 - p) - v) / (v - p
    (1 - p) / m) for the hosts' variance v and mean size m, held between 1 and
    10**6: the more alike the hosts are, the more each is drawn to the mean.
    """
    hosts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.expr(f"cast({test} as long)")).alias(f"fails_{name}") for name, test in rules.items()])
    hosts = saved(hosts, "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *[F.sum(f"fails_{r}").alias(r) for r in rules]).first()
    if not total["n"]:
        return hosts.select("host", "n", *[f"fails_{r}" for r in rules], *[F.lit(0.0).alias(f"rate_{r}") for r in rules])
    mean = {r: total[r] / total["n"] for r in rules}
    spread = hosts.agg(*[(F.sum(F.col("n") * F.pow(F.col(f"fails_{r}") / F.col("n") - mean[r], 2)) / total["n"]).alias(r) for r in rules]).first()
    rates = []
    for r in rules:
        noise = mean[r] * (1 - mean[r])
        excess = spread[r] - noise * total["hosts"] / total["n"]
        weight = min(1e6, max(1.0, (noise - spread[r]) / excess)) if excess > 0 else 1e6
        rates.append(((F.col(f"fails_{r}") + mean[r] * weight) / (F.col("n") + weight)).alias(f"rate_{r}"))
    return hosts.select("host", "n", *[f"fails_{r}" for r in rules], *rates)


def with_verdicts(docs: DataFrame, host: str = "source", bound: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, host_rejected, kept.

    Null texts count as empty and so fail.  Rows without a host have no host
    verdict and stand on their own.  Repeated rows count each time.  An empty
    table gives an empty result.
    """
    rows = saved(measured(docs, host), "measures")
    hosts = host_rates(rows)
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    verdict = hosts.select("host", (worst >= bound).alias("host_rejected"))
    base = F.expr(f"{RULES['short']} or {RULES['repeats']}")
    out = rows.join(verdict, "host", "left").withColumn("base_failed", base).withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.select("doc_id", *MEASURES, "base_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))
