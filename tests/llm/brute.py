"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import xxhash

SPACE = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACE, text or "")


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def personal(text):
    """Base spans by the plain patterns."""
    text = text or ""
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    kinds = {
        "email": [m for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }
    return {k: [m.span() for m in v] for k, v in kinds.items()}


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)


def simhash(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(SPACE.encode(), raw)
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(rows, most=3):
    """doc_id -> smallest reachable doc_id, by comparing all fingerprints; rows are (doc_id, text)."""
    fps = [(d, simhash(t)) for d, t in rows]
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= most:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {}
    for (d, _), g in zip(fps, label):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [(d, f"{f:016x}", least.get(g)) for (d, f), g in zip(fps, label)]


def shingles(text, width):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode()) for x in words(text)]
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def kept_ids(rows, width=5, least=0.8):
    """Smallest doc_id of each component of the pairs that are alike; rows are (doc_id, text)."""
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both, total = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if (both / total if total else 1.0) >= least and label[i] != label[j]:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    named = {}
    for (d, _), g in zip(rows, label):
        if d is not None:
            named[g] = min(d, named.get(g, d))
    return sorted(named.values())


def measures(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    found = Counter(windows)
    again = {j for i, x in enumerate(windows) if found[x] > 1 for j in range(i, i + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Reshare the excess until no target is above its bound; ``sizes`` maps sources to words."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total = {}, share * sum(sizes.values())
    while len(target) < len(names):
        left = [s for s in names if s not in target]
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in left}
        target |= {s: float(most * sizes[s]) for s in over}
    return target


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return dot / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
