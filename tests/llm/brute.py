"""Brute-force versions of the contracts, one plain Python pass each."""

import hashlib
import base64
import re
from collections import defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url(u, rules):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def line_dedup(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text) -> (doc_id, n_lines, n_dropped, sha256)"""
    holders = defaultdict(set)
    keyed = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keys = [x.strip(SPACE).translate(LOWER) for x in lines]
        keyed.append((d, lines, keys))
        for k in keys:
            if d is not None:
                holders[k].add(d)
    out = []
    for d, lines, keys in keyed:
        kept = [x for x, k in zip(lines, keys) if not (len(k) >= min_chars and len(holders[k]) >= min_docs and d != max(holders[k]))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def warc(rows):
    first = {}
    for p, html in rows:
        if p is not None:
            first[html or ""] = min(p, first.get(html or "", p))
    out = []
    for p, html in rows:
        data = (html or "").encode()
        r = first.get(html or "")
        again = r is not None and p != r
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", r if again else None))
    return out


def contamination(docs, items, window=10):
    patterns = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns[tuple(w[k:k + m])].add("null" if i is None else str(i))
    sizes = {len(p) for p in patterns}
    out = []
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (p := tuple(w[k:k + m])) in patterns:
                    hit.update(range(k, k + m))
                    found |= patterns[p]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text, shingle=3):
    w = WORD.findall((text or "").translate(LOWER))
    parts = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, max_bits=2):
    """rows: (id, fingerprint) -> {(id, fp): smallest reachable id}"""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                parent[find(a)] = find(b)
    least = {}
    for d, f in rows:
        r = find(f)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return {(d, f): least.get(find(f)) for d, f in rows}


def maximal(rows):
    """rows: (conv, turn, role, text) -> {smallest conv of equal ones: (n_turns, n_copies)}"""
    def null_first(x):
        return (x is not None, x if x is not None else 0)

    convs = defaultdict(set)
    for c, *t in rows:
        convs[c].add(tuple(t))
    said = {c: tuple((r, x) for _, r, x in sorted(ts, key=lambda t: tuple(map(null_first, t)))) for c, ts in convs.items()}
    inner = {s[:k] for s in said.values() for k in range(1, len(s))}
    groups = defaultdict(list)
    for c, s in said.items():
        groups[s].append(c)
    return {min((c for c in cs if c is not None), default=None): (len(s), len(cs)) for s, cs in groups.items() if s not in inner}


def byte_pair_ids(text, ranks, pattern):
    """Each match merged by itself: always the pair of least rank, the leftmost first."""
    import regex
    out = []
    for m in regex.finditer(pattern, text or ""):
        parts = [bytes([b]) for b in m[0].encode()]
        while len(parts) > 1 and m[0].encode() not in ranks:
            least = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[least] + parts[least + 1] not in ranks:
                break
            parts[least:least + 2] = [parts[least] + parts[least + 1]]
        out += [ranks[m[0].encode()]] if m[0].encode() in ranks else [ranks[p] for p in parts]
    return out


def made_runs(doc_id, text):
    import zlib
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def runs(words, min_words=6, min_periods=4):
    """Sorted (start, length, period): every period tried, the smallest of one stretch stays."""
    n, found = len(words), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(min_words, min_periods * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_row(doc_id, words):
    found = runs(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    rows = "".join("%d,%d,%d\n" % r for r in found)
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256(rows.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, found).encode()).hexdigest())


def hard_negatives(rows, is_anchor=lambda i: i % 50 == 0, label=lambda i, y: (y + 1) % 10 if i % 7 == 0 else y, n_positives=5, n_negatives=3):
    """rows: (id, vector, label) -> (anchor, positive, rank, negative, positive score, negative score)"""
    from math import floor, isfinite
    part = sorted({(i, label(i, y), tuple(floor(256 * x) for x in v)) for i, v, y in rows
                   if i is not None and y is not None and v is not None and all(x is not None and isfinite(x) for x in v)})
    out = []
    for a in part:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in part if b != a)
        for s, p, _ in [x for x in scored if x[2] == a[1]][:n_positives]:
            fits = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a[0], p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits[:n_negatives])]
    return out
