"""Brute-force versions of the contracts, in plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows):
    """(doc_id, text) -> {doc_id: (hex, component)}."""
    f = {d: fingerprint(t) for d, t in rows}
    ids = sorted(f)
    parent = {d: d for d in ids}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (f[a] ^ f[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (f"{f[d]:016x}", top(d)) for d in ids}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    digits = lambda v: re.sub(r"[^0-9]", "", v)
    for rank, (kind, p) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in p.finditer(text):
            v = m[0]
            if kind == "ip" and any(int(x) > 255 for x in v.split(".")):
                continue
            if kind == "card" and not (12 <= len(digits(v)) <= 19 and luhn(digits(v))):
                continue
            if kind == "phone" and not 9 <= len(digits(v)) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def base_digest(text):
    s = base_spans(text)
    return [sum(1 for x in s if x[3] == k) for k in ("email", "ip", "card", "phone")] + [hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, z, k in s).encode()).hexdigest()]


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    n, rep = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 10 or 100 * rep > 20 * n)


def exact(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, (_, t) in enumerate(rows)}
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(norm[i], []).append(d)
    return [(d, min(groups[norm[i]]), len(groups[norm[i]]), hashlib.sha256(norm[i].encode()).hexdigest()) for i, (d, _) in enumerate(rows)]


def token_rows(rows, tokenizer):
    start, out = 0, []
    for d, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out
