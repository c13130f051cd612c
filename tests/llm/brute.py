"""What the operators must return, worked out the plain way."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "kept string, keep_id string, text_sha256 string, h string, at string, pos string, row string, score string, lang_pred string, leaks string, node string, _len string, length string, anchors string"


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def words(t: str | None) -> list[str]:
    return WORDS.findall(t or "")


def crc(i, n: int) -> int:
    return zlib.crc32(str(i).encode()) % n if i is not None else 0


def licenses(t: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    places, labels = [], set()
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def substrings(rows: list[tuple], size: int = 13) -> dict:
    first: dict = {}
    cut = [(d, words(t)) for d, t in rows]
    for d, w in cut:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, w in cut:
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for j in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def near(rows: list[tuple], size: int = 2) -> dict:
    sets = {}
    for d, t in rows:
        w = words(lower(t or ""))
        sets[d] = set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    some = [d for d in sets if sets[d]]
    for i, a in enumerate(some):
        for b in some[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind: str, m: str) -> bool:
    digits = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def personal(t: str | None) -> tuple:
    spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, t or "") if _passes(kind, m.group()))
    names = list(PII)
    text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    return *(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(text.encode()).hexdigest(), text


def unigram(rows: list[tuple]) -> list[tuple]:
    cut = [(d, [*words(lower(t or "")), None]) for d, t in rows]
    counts: Counter = Counter()
    for d, w in cut:
        if crc(d, 7) != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return [(d, crc(d, 7) == 2, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for d, w in cut]


def lines(rows: list[tuple], size: int = 3) -> dict:
    seen: set = set()
    gone = defaultdict(set)
    cut = {d: (t or "").split("\n") for d, t in rows}
    for d in sorted(cut):
        for i in range(len(cut[d]) - size + 1):
            key = tuple(cut[d][i : i + size])
            if key in seen:
                gone[d].update(range(i, i + size))
            seen.add(key)
    return {d: (len(x), len(gone[d]), hashlib.sha256("\n".join(s for i, s in enumerate(x) if i not in gone[d]).encode()).hexdigest()) for d, x in cut.items()}


def spread(rows: list[tuple], shards: int, seed: str) -> list[tuple]:
    """(doc_id, source, size, crc, shard, slot) of (doc_id, source, text) rows."""
    unit = lambda *w: int(hashlib.md5(":".join(w).encode()).hexdigest()[:13], 16)
    groups = defaultdict(list)
    for d, s, t in rows:
        tie = hashlib.md5((t or "").encode()).hexdigest()
        groups[s].append(((unit(seed, "-" if d is None else str(d)), d is not None, d or 0, tie), d, t or ""))
    order = []
    for s, g in groups.items():
        u = unit(seed, "source", "-" if s is None else "=" + s) / (1 << 52)
        for rank, (_, d, t) in enumerate(sorted(g, key=lambda x: x[0]), 1):
            order.append((((rank - u) / len(g), s is not None, s or "", rank), d, s, t))
    order.sort(key=lambda x: x[0])
    n, out, used = len(order), [], Counter()
    for at, (_, d, s, t) in enumerate(order):
        shard = at * shards // n
        out.append((d, s, len(t.encode()) + 16, zlib.crc32(t.encode()), shard, used[shard]))
        used[shard] += 1
    return out


def periodic(w: list, least: int = 6, power: int = 4) -> list[tuple]:
    """(start, length, period) of every run."""
    found: dict = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, power * q):
                found.setdefault((s, i + q - s), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def moved(doc_id: int | None, w: list) -> list:
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w: list, found: list[tuple]) -> str:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values: list) -> str:
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha(*low[i : i + 8]) for i in range(0, len(low), 8)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for low in levels[:-1]:
        first = i // 8 * 8
        out.append(("".join(low[first:i]), "".join(low[i + 1 : first + 8])))
        i //= 8
    return out


def manifest(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    ordered = {k: sorted(groups[k], key=lambda x: x[0]) for k in names}
    trees = {k: tree([key[2] for key, _ in ordered[k]]) for k in names}
    over = tree([trees[k][-1][0] for k in names])
    out = []
    for at, k in enumerate(names):
        for i, (key, r) in enumerate(ordered[k]):
            path = siblings(trees[k], i) + siblings(over, at)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = leaf([*r[:4], lower(r[4])]) if changed else key[2]
            for before, after in path:
                node = sha(before, node, after)
            root = over[-1][0]
            out.append((r[0], key[2], trees[k][-1][0], root, sha(*(x for s in path for x in s)), node, node == root))
    return out
