"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate(_FOLD) if fold else text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, k=5):
    w = words(text, fold=True)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def conversations(rows):
    """rows: (conv_id, turn, role, text) -> conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t is not None, t or 0, r or "", x or ""))
    found = {}
    for c, turns in out.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        found[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return found


def near_duplicates(docs):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        for n, b in enumerate(ids):
            shared.update((a, b) for a in ids[:n])
    for (a, b), c in shared.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def without_repeats(docs, width=35):
    """{doc_id: (n_words, n_removed, kept_sha256)}."""
    held = [(i, words(t)) for i, t in docs]
    seen = Counter(tuple(w[j : j + width]) for _, w in held for j in range(len(w) - width + 1))
    out = {}
    for i, w in held:
        gone = {k for j in range(len(w) - width + 1) if seen[tuple(w[j : j + width])] > 1 for k in range(j, j + width)}
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def leaks(docs, items):
    """{(doc_id, item_id, n_item, n_found)} by exact containment."""
    out = set()
    sets = [(i, shingles(t), len(words(t))) for i, t in items]
    for d, t in docs:
        w = words(t, fold=True)
        grams = {k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for k in range(1, 6)}
        for i, s, n in sets:
            if s:
                c = len(s & grams[min(5, n)])
                if 100 * c >= 75 * len(s):
                    out.add((d, i, len(s), c))
    return out


def base_spans(text):
    """kind:start:end of the three base patterns, as the contract words them."""
    text = text or ""
    found = []
    for kind, pattern, least, group in (
        ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
        ("access", r"AKIA[A-Z0-9]+", 20, 0),
        ("hex", r"[0-9a-f]+", 24, 0),
    ):
        found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [x[2] for x in sorted(found)]


def shares(sizes, weights, budget, most):
    """The budget by weight, none above ``most`` times its size, the excess shared again until none is."""
    target, left = [0.0] * len(sizes), budget
    free = {i for i, s in enumerate(sizes) if s > 0}
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > most * sizes[i]}
        for i in over or free:
            target[i] = most * sizes[i] if over else left * weights[i] / total
        left -= sum(target[i] for i in over)
        free = free - over if over else set()
    return target
