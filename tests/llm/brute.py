"""Plain versions of the operators, one document at a time, to compare with."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    covered = {j for i, t in enumerate(windows) if times[t] > 1 for j in range(i, i + 3)}
    seen, same = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            same += line in seen
            seen.add(line)
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, sum(map(len, w)), symbols, same, len(covered), failed


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items, window=10):
    """doc text -> (n_words, hit positions, item ids)."""
    known = {}
    for item, text in items:
        w = benchmark_words(text)
        m = min(len(w), window)
        for a in range(len(w) - m + 1) if m else ():
            known.setdefault(tuple(w[a : a + m]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = benchmark_words(text)
        hit, ids = set(), set()
        for m in {len(k) for k in known}:
            for a in range(len(w) - m + 1):
                if found := known.get(tuple(w[a : a + m])):
                    hit.update(range(a, a + m))
                    ids |= found
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), digest, bool(hit)))
    return out


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=2):
    """(doc, fp) pairs -> smallest doc id reachable, per row."""
    groups = {}
    for doc, fp in fps:
        groups.setdefault(fp, []).append(doc)
    left, names = set(groups), {}
    while left:
        todo = [left.pop()]
        found = list(todo)
        while todo:
            a = todo.pop()
            near = {b for b in left if (a ^ b).bit_count() <= radius}
            left -= near
            todo += near
            found += near
        ids = [d for fp in found for d in groups[fp] if d is not None]
        names |= dict.fromkeys(found, min(ids, default=None))
    return [(doc, f"{fp:016x}", names[fp]) for doc, fp in fps]


def base_spans(text):
    text = text or ""
    names = "password|passwd|secret|token|api_?key"
    kinds = [
        ("assign", rf"""(?:(?i:{names}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ]
    found = []
    for place, (kind, pattern, group, least) in enumerate(kinds):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                found.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


def water_level(sizes, weights, total, epochs):
    """Targets by rounds of clamping and sharing out again."""
    caps = {s: n * epochs for s, n in sizes.items()}
    clamped: dict = {}
    while True:
        rest = total - sum(clamped.values())
        weight = sum(weights[s] for s in sizes if s not in clamped)
        shares = {s: rest * weights[s] / weight for s in sizes if s not in clamped}
        over = [s for s, v in shares.items() if v > caps[s]]
        if not over:
            return clamped | shares
        clamped |= {s: caps[s] for s in over}
        if len(clamped) == len(sizes):
            return clamped


def losses(docs, good, pair_weight, equal):
    """doc id -> words and mean loss under the models of the ``good`` documents and of all."""
    split = [(doc, words(lower(text))) for doc, text in docs]
    vocabulary = len({w for _, found in split for w in found}) + 1
    singles, doubles = (Counter(), Counter()), (Counter(), Counter())
    for doc, found in split:
        for model in (0, 1) if doc in good else (1,):
            singles[model].update(found)
            doubles[model].update(zip(found, found[1:], strict=False))

    def loss(model, before, word):
        total = sum(singles[model].values())
        share = singles[model][word] / total if total else 1 / vocabulary
        share = (1 - equal) * share + equal / vocabulary
        times = singles[model][before]
        by_pair = doubles[model][before, word] / times if times else share
        return -math.log(pair_weight * by_pair + (1 - pair_weight) * share)

    def mean(model, found):
        return sum(loss(model, b, w) for b, w in zip([None, *found], found, strict=False)) / max(len(found), 1)

    return {doc: (len(found), mean(0, found), mean(1, found)) for doc, found in split}
