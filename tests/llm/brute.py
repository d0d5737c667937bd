"""The same results by plain Python over a small list of rows (doc_id, text, source)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANKS = "\t\n\x0b\x0c\r "
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LAST = (1 << 63) - 1


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def key_id(doc_id):
    return LAST if doc_id is None else doc_id


def line_dedup(rows):
    """(doc_id, n_lines, n_dropped, kept_sha256)"""
    holders = defaultdict(set)
    split = [(key_id(i), (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for i, lines in split:
        for line in lines:
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for (doc_id, _), (i, lines) in zip(rows, split):
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == i]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def near_duplicates(rows, size, percent=80):
    """(doc_id, n_shingles, component_id, kept), over all pairs."""
    sets = [(key_id(i), shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = defaultdict(list)
    for n, (_, own) in enumerate(sets):
        for s in own:
            by_shingle[s].append(n)
    shared = Counter()
    for group in by_shingle.values():
        for a in range(len(group)):
            for b in range(a):
                shared[group[b], group[a]] += 1
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = sorted((find(sets[a][0]), find(sets[b][0])))
            root[y] = x
    plain = lambda i: None if i == LAST else i
    return sorted(((plain(i), len(s), plain(find(i)), find(i) == i) for i, s in sets), key=str)


def repeated_bytes(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)"""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                hit[i:i + length] = b"\1" * length
        kept = bytes(b for b, h in zip(d, hit) if not h)
        spans = sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1]))
        out.append((doc_id, len(d), len(d) - len(kept), spans, sha(kept)))
    return sorted(out, key=str)


def base_statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if runs[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(hit), failed,
    )


def edited_texts(rows):
    """(doc_id, n_chars, edited_sha256)"""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for n, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(n + 1) % len(order)][1] or ""
        cut = len(text) // 3
        out.append((doc_id, len(text), sha(text[:len(text) - cut] + following[:cut])))
    return sorted(out, key=str)


def mix_targets(rows, weights=(5, 2, 1)):
    """source -> (source_size, target); rows are (doc_id, source, text)."""
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        free -= above
    return {s: (sizes[s], target.get(s, 0.0)) for s in order}
