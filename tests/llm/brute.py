"""Plain single-process versions of the operators, for tests."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def contamination(docs, bench, n=10):
    items = [(str(i), BENCH_WORD.findall(lower(t))) for i, t in bench]
    out = []
    for doc, text in docs:
        w = BENCH_WORD.findall(lower(text))
        hit, found = set(), set()
        for item, v in items:
            k = min(n, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found.add(item)
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def longest(docs, bench, n=10):
    """{item: (words, doc, start, item start)} of the longest verbatim match of every item."""
    out = {}
    for item, text in bench:
        v = BENCH_WORD.findall(lower(text))
        best = None
        for doc, t in docs:
            w = BENCH_WORD.findall(lower(t))
            before = {}
            for j in range(len(v)):
                now = {i: before.get(i - 1, 0) + 1 for i in range(len(w)) if w[i] == v[j]}
                for i, k in now.items():
                    if k >= min(n, len(v)):
                        rank = (-k, doc is None, doc or 0, i - k + 1, j - k + 1)
                        best = min(best or rank, rank)
                before = now
        if best:
            out[str(item)] = (-best[0], None if best[1] else best[2], *best[3:])
    return out


def fingerprint(text):
    w = SPACE_WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(prints, radius=4):
    """{id: smallest id reachable} for (id, fingerprint) pairs."""
    parent = {i: i for i, _ in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if j < i and (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def secrets(text):
    s, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", s, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", s) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", s) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def linked(text, scope=256):
    """All spans of a text: the base ones and the weak ones next to a part that completes them."""
    s, parts = text or "", set()
    base = {(int(a), ["assign", "access", "hex"].index(k), int(b)) for k, a, b in (x.split(":") for x in secrets(s).split(",") if x)}
    weak = [r"""\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", r"[A-Za-z0-9+/_=-]+", r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|ssh)://[^\s\"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|(?<![a-z0-9-])[a-z0-9-]+\.(?:com|net|org|io|dev|cloud|internal|local)\b"]
    for rank, pattern in enumerate(weak, 3):
        for m in re.finditer(pattern, s, re.ASCII | (re.I if rank == 3 else 0)):
            if rank != 4 or (re.fullmatch("[A-Za-z0-9+/_-]{24,}={0,2}", m[0]) and all(re.search(x, m[0]) for x in ("[0-9]", "[A-Z]", "[a-z]"))):
                parts.add((m.start(), rank, m.end()))
    every, out = base | parts, list(base)
    for a, rank, b in parts:
        wants = (1, 3, 5) if rank == 4 else (0, 2, 4) if rank == 3 else ()
        if any(r in wants and abs(a - c) <= scope for c, r, _ in every):
            out.append((a, rank, b))
    return sorted(out)


def masked(text, spans, mask="[secret]"):
    out, at = "", 0
    for a, _, b in spans:
        if a >= at:
            out += text[at:a] + mask
        at = max(at, b)
    return out + text[at:]


def repeated_words(text, k=5):
    w = SPACE_WORD.findall(text or "")
    grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    n = Counter(grams)
    return len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + k)})


def deduplicated(docs, k=13):
    first = defaultdict(list)
    rows = [(i, SPACE_WORD.findall(t or "")) for i, t in docs]
    for i, w in rows:
        for a in range(len(w) - k + 1) if i is not None else ():
            first[tuple(w[a : a + k])].append(i)
    least = {g: min(v) for g, v in first.items()}
    out = []
    for i, w in rows:
        gone = {j for a in range(len(w) - k + 1) if i is not None and least[tuple(w[a : a + k])] < i for j in range(a, a + k)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)
