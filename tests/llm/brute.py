"""Plain versions of the operators over lists of rows, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(docs, window=13):
    first = {}
    cut = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in cut:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in cut:
        gone = set()
        for k in range(len(w) - window + 1):
            if d is not None and first[tuple(w[k : k + window])] < d:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text, width=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    codes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def near_duplicates(docs, distance=4, width=4):
    prints = {}
    for _, t in docs:
        prints.setdefault(t, fingerprint(t, width))
    distinct = sorted(set(prints.values()))
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= distance:
            parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for d, t in docs:
        r = root(prints[t])
        if d is not None:
            least[r] = d if least[r] is None else min(d, least[r])
    return [(d, f"{prints[t]:016x}", least[root(prints[t])]) for d, t in docs]


def token_counts(docs, path, limit=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    out = []
    for d, t in docs:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        out.append((d, len((t or "").encode()), n, n > limit))
    return out


def mix(docs, share=1.5, most=2.0):
    """(doc_id, size, source_size, target) per row; how the words are taken is checked by its invariants."""
    size = [(d, s, len(WORD.findall(t or ""))) for d, s, t in docs]
    total = defaultdict(int)
    for _, s, n in size:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, stopped = {}, {s for s in order if not total[s]}
    for s in stopped:
        target[s] = 0.0
    while True:
        rest = share * sum(total.values()) - sum(target.get(s, 0.0) for s in stopped)
        open_ = [s for s in order if s not in stopped]
        if not open_:
            break
        unit = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > most * total[s]]
        if not over:
            target |= {s: weight[s] * unit for s in open_}
            break
        for s in over:
            target[s] = most * total[s]
            stopped.add(s)
    return [(d, n, total[s], round(target[s], 6)) for d, s, n in size]


def compression_base(docs):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) per row."""
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count = defaultdict(int)
        for g in grams:
            count[g] += 1
        cover = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed))
    return out


def base_pii(text):
    """Spans of the plain formats, each kind by one regular expression and its rule."""

    def luhn(s):
        n = [int(c) for c in reversed(s)]
        return (sum(n[0::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0

    text = text or ""
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def personal_data(docs):
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256) per row."""
    out = []
    for d, t in docs:
        spans = base_pii(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        out.append((d, *(sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone")), hashlib.sha256(said.encode()).hexdigest()))
    return out


def bm25_leaks(docs, items, score=0.6, overlap=0.5, stride=128, run=3):
    """(doc_id, item_id) pairs: every passage scored against every item, no index and no bounds. Items of one entry only."""
    import math

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    body = {i: words(t) for i, t in items if words(t)}
    mean = sum(map(len, body.values())) / max(1, len(body))
    df = defaultdict(int)
    for w in body.values():
        for x in set(w):
            df[x] += 1
    n = len(body)

    def impact(x, w):
        tf = w.count(x)
        return math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))

    def held(part, region):
        k = min(run, len(part))
        have = {tuple(region[j : j + k]) for j in range(len(region) - k + 1)}
        cover = {j + i for j in range(len(part) - k + 1) if tuple(part[j : j + k]) in have for i in range(k)}
        return len(cover) / len(part) if part else 1.0

    out = set()
    for d, t in docs:
        w = words(t)
        for at in range(0, max(1, len(w)), stride):
            passage = set(w[at : at + 2 * stride])
            for i, t2 in items:
                own = body.get(i)
                if not own:
                    continue
                if sum(impact(x, own) for x in set(own) & passage) >= score * sum(impact(x, own) for x in set(own)) - 1e-9:
                    cut = [p for p in (words(s) for s in re.split(r"(?<=[.?!\n])\s+", t2)) if p]
                    q, a = ([x for p in cut[:-1] for x in p], cut[-1]) if len(cut) > 1 else (cut[0][: len(cut[0]) - len(cut[0]) // 3], cut[0][len(cut[0]) - len(cut[0]) // 3 :])
                    region = w[max(0, at - len(own)) : at + 2 * stride + len(own)]
                    if len(own) < 8:
                        ok = any(region[j : j + len(own)] == own for j in range(len(region)))
                    else:
                        ok = held(q, region) >= overlap and held(a, region) >= overlap
                    if ok:
                        out.add((d, i))
    return out
