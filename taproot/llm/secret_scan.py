"""Secret scans: fixed patterns, then dictionary-primed zstandard novelty.

Base spans follow three patterns.  The method adds strings that no pattern names:
a candidate is a long token of mixed characters with a sensitive word shortly
before or after it, directly after a reported one, or in a private key block.  It is compressed after a dictionary of common identifiers and the
code around it; the bytes that it adds, over what the same frame costs with
nothing in it, are its novelty.  Prose, identifiers and strings that the
surroundings repeat add little; keys add nearly all of their length.  Only
repetition saves bytes: literals are not entropy-coded, as a small alphabet would
then make long random strings look known.  Instead, long stretches whose letters
are as uneven as those of words count as known.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.llm.words import slices

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is the pattern with + and shorter ones dropped
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
_SENSITIVE = re.compile(r"pass|pwd|secret|token|api.?key|private.?key|access.?key|auth|bearer|credential|signature|session", re.I | re.A)

_BLOCK = re.compile(r"-----(BEGIN) [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----|-----END ")
_PROSE = re.compile(r"[A-Za-z]+ [A-Za-z]+")
_RUN = re.compile(r"(?:(?<=\\)[nrt])?([A-Za-z0-9+/=]*)")
_GAP = re.compile(r"(?:\\[nrt]|[\W_])*")  # no letters or digits, but for line ends as escapes
_PADDED = re.compile(r"(?:\\[nrt]|[\W_])*?([A-Za-z0-9+/]{2,15}={1,2})(?![A-Za-z0-9+/_=-])")

# What source code near a string commonly holds.
_DICTIONARY = (
    b"password passwd pwd secret token api_key apikey access_key private_key public_key client_id client_secret "
    b"authorization bearer credential signature session username hostname endpoint connection database default "
    b"environment variable configuration settings request response header content length application version "
    b"function return import from export const static public private class string number boolean object array "
    b"index value name type true false null none self this that with and the for while else error exception "
    b"create update delete select insert where order group limit offset https://www.example.com/path/file.txt "
    b"0123456789 abcdefghijklmnopqrstuvwxyz \" = ' : { } [ ] ( ) ; , . / _ - + "
)


_FOLD = {c: c + 32 for c in range(65, 91)}
# zstandard leaves literals as they are with the fast strategy and a target length
_PACKING = zstandard.ZstdCompressionParameters(
    window_log=17, hash_log=15, chain_log=15, search_log=1, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST, write_checksum=False, write_content_size=False
)
_FRAME = _DICTIONARY[:48]  # one match, so that the costs of a frame with sequences cancel out


def _wordy(s: str) -> bool:
    """Letters as uneven as in words: two of them are alike in 6 of 100 cases, in random ones of 20 or more symbols in 5 at most."""
    if len(s) < 128:
        return False
    counts = Counter(s).values()
    return len(counts) >= 20 and sum(c * (c - 1) for c in counts) > 0.055 * len(s) * (len(s) - 1)


class Novelty:
    """Marginal compressed bytes of a string after its surroundings."""

    def __init__(self, around: int = 512, piece: int = 256):
        self.around, self.piece = around, piece

    def __call__(self, text: str, start: int, end: int) -> float:
        """Added bytes for each byte of ``text[start:end]``, or of the piece of it that adds most; pieces overlap by half."""
        last = max(start, end - self.piece)
        starts = [*range(start, last, self.piece // 2), last]
        return max(self._of(text, x, min(end, x + self.piece)) for x in starts)

    def _of(self, text: str, start: int, end: int) -> float:
        """Upper and lower case are alike; long words add nothing."""
        low = max(0, start - self.around)
        text, start, end = text[low : end + self.around], start - low, end - low
        text = text.translate(_FOLD)  # identifiers differ in case alone
        if _wordy(text[start:end]):
            return 0.0
        near = text[max(0, start - self.around) : start] + text[end : end + self.around]
        words = " ".join(sorted(set(re.findall(r"[a-z_]{4,}", near))))
        primer = zstandard.ZstdCompressionDict(_DICTIONARY + words.encode("utf-8", "replace") + near.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(compression_params=_PACKING, dict_data=primer)
        body = text[start:end].encode()
        return (len(packer.compress(_FRAME + body)) - len(packer.compress(_FRAME))) / len(body)


# Words in one letter case or with a capital first, or short numbers, with marks between them: what people name things.
_PART = r"(?:(?:[A-Z]?[a-z]{2,}+)++\d{0,4}|[A-Z]{2,}+\d{0,4}|\d{1,4}|[a-z]\d{1,2})"
_NAME = re.compile(rf"[_/=+-]*{_PART}(?:[_/=+-]++{_PART})+[_/=+-]*")


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three patterns, leftmost and not overlapping in each kind."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def novel_spans(text: str, base: list[tuple[int, str, int]], novelty: Novelty, least: float, reach: int = 48) -> list[tuple[int, str, int]]:
    """Incompressible candidates in reach, their parts outside base spans.

    Names, words and short numbers with marks between them, are none.  In reach are candidates within ``reach`` characters of a sensitive word on
    either side, those that directly follow a reported one or an assign or access
    span, and those in a private key block.  A candidate counts whole if any part
    of 16 characters or more, as cut by base spans, does.  A short padded last line
    belongs to the candidate before it; what follows a reported span in a key block
    belongs to the key.
    """
    marks = [m.span() for m in _SENSITIVE.finditer(text)]
    if not marks:
        return []
    out, ends = [], [y for _, y in marks]
    blocks = [(x.end(), y.start()) for x, y in itertools.pairwise(_BLOCK.finditer(text)) if x[1] and not y[1]]
    taken = sorted((s, e) for s, _, e in base)
    leads = sorted(e for _, k, e in base if k != "hex")
    at = begin = lead = block = 0
    last = None  # where the last reported string ends
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(marks) and ends[at] <= s:
            at += 1
        while begin < len(taken) and taken[begin][1] <= s:
            begin += 1
        while lead < len(leads) and leads[lead] <= s:
            last = max(last or 0, leads[lead])
            lead += 1
        while block < len(blocks) and blocks[block][1] <= s:
            block += 1
        near = at and s - ends[at - 1] <= reach
        if not near:
            after = bisect.bisect_left(marks, (e, 0), at)
            near = after < len(marks) and marks[after][0] - e <= reach
        near = near or (block < len(blocks) and blocks[block][0] <= s)
        near = near or (last is not None and 0 <= s - last <= reach and _GAP.fullmatch(text, last, s))
        if not near or not _mixed(m[0]) or _NAME.fullmatch(m[0]):
            continue
        parts = _outside(taken, begin, s, e)
        if any(y - x >= 16 and _mixed(text[x:y]) and novelty(text, x, y) >= least for x, y in parts):
            out += [(x, "novel", y) for x, y in parts]
            last = e
            if tail := _PADDED.match(text, e, e + reach + 18):
                rest = _outside(taken, begin, *tail.span(1))
                out += [(x, "novel", y) for x, y in rest]
    return sorted(set(out) | _rest_of_blocks(text, blocks, sorted(taken + [(s, e) for s, _, e in out])))


def _outside(taken: list[tuple[int, int]], begin: int, start: int, end: int) -> list[tuple[int, int]]:
    """Parts of start:end outside the sorted spans from ``begin`` on."""
    parts, done = [], start
    while begin < len(taken) and taken[begin][0] < end:
        x, y = taken[begin]
        if x > done:
            parts.append((done, x))
        done = max(done, y)
        begin += 1
    return parts + [(done, end)] if done < end else parts


def _rest_of_blocks(text: str, blocks: list[tuple[int, int]], spans: list[tuple[int, int]]) -> set[tuple[int, str, int]]:
    """What no span covers of the runs of key characters that follow a span in its block."""
    out = set()
    for low, high in blocks:
        begin = bisect.bisect_left(spans, (low, 0))
        if begin == len(spans) or spans[begin][0] >= high or _PROSE.search(text, spans[begin][0], high):
            continue
        for m in _RUN.finditer(text, spans[begin][0], high):
            if m[1]:
                while begin < len(spans) and spans[begin][1] <= m.start(1):
                    begin += 1
                out.update((x, "novel", y) for x, y in _outside(spans, begin, *m.span(1)))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _suspects(texts: pa.Array):
    """Texts that any pattern could match, by one automaton each."""
    able = pc.match_substring_regex(texts, "(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]")
    able = pc.or_(able, pc.match_substring(texts, "AKIA"))
    able = pc.or_(able, pc.match_substring_regex(texts, "[0-9a-f]{24}"))
    return pc.or_(able, pc.and_(pc.match_substring_regex(texts, "[A-Za-z0-9+/_=-]{16}"), pc.match_substring_regex(texts, "(?i)pass|pwd|secret|token|api.?key|private.?key|access.?key|auth|bearer|credential|signature|session")))


def _scan(texts: pa.Array, novelty: Novelty, least: float):
    texts = texts.fill_null("") if texts.null_count else texts
    for ok, text in zip(_suspects(texts).to_pylist(), texts, strict=True):
        if not ok:
            yield [], [], None
            continue
        text = text.as_py()
        base = base_spans(text)
        more = novel_spans(text, base, novelty, least)
        yield base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1]))), text


def secrets(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    Spans are kind:start:end in code points, the end exclusive.  Null and empty
    texts have none: counts of 0, the digest of the empty string, an empty list.
    Repeated rows are scanned each; an empty table gives an empty result.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                rows = []
                for base, spans, _ in _scan(batch.column("text").slice(lo, hi - lo), novelty, least):
                    kinds = [k for _, k, _ in spans]
                    rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo)] + [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def redacted(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """``docs`` with each span, or run of overlapping ones, replaced by ``[kind]`` in its text.

    Texts without a span, null ones too, are unchanged; every row and column stays.
    """
    at = docs.columns.index("text")
    schema = docs.schema

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                out = []
                for (_, spans, text), old in zip(_scan(part.column(at), novelty, least), part.column(at), strict=True):
                    if not spans:
                        out.append(old.as_py())
                        continue
                    pieces, done = [], 0
                    for s, k, e in spans:
                        if s >= done:
                            pieces += [text[done:s], f"[{k}]"]
                        done = max(done, e)
                    out.append("".join(pieces) + text[done:])
                cols = list(part.columns)
                cols[at] = pa.array(out, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)
