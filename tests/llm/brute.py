"""Plain restatements of what the corpus queries return, row by row, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def simhash(rows):
    """doc_id -> (hex, component) for (doc_id, text) rows."""
    prints = {}
    for i, text in rows:
        words = [w for w in SPACE.split((text or "").translate(LOWER)) if w]
        parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def substrings(rows, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha)."""
    first, out = {}, {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for p in range(len(data[i]) - length + 1):
            first.setdefault(data[i][p : p + length], i)
    for i, d in data.items():
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if first[d[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(d), sum(gone), runs, sha(bytes(b for b, g in zip(d, gone) if not g)))
    return out


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def contamination(rows, items, n=13):
    """doc_id -> (n_words, n_hit, n_items, sha, contaminated)."""
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1) if w else ():
            windows[tuple(w[k : k + size])].add(str(i))
    out = {}
    for d, text in rows:
        w = words(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if names := windows.get(tuple(w[k : k + size])):
                    found |= names
                    hit.update(range(k, k + size))
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    """Counts per kind and the base spans."""
    counts, spans = [], []
    for kind, pattern in BASE.items():
        n = 0
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                n += 1
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, sha(",".join(spans))), spans


def lines(rows, least=5, length=40):
    """doc_id -> (n_lines, n_dropped, sha)."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= length:
                holders[key(x)].add(i)
    out = {}
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(holders.get(key(x), ())) < least or i == max(holders[key(x)])]
        out[i] = (len(every), len(every) - len(kept), sha("\n".join(kept)))
    return out


def conversations(rows):
    """conv_id -> (n_turns, turns sha, loss chars, loss sha) for (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out
