"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingle_set(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(rows, size=5, threshold=75):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows with distinct ids."""
    sets = {d: shingle_set(t, size) for d, t in rows}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    links = set()
    for d, s in sets.items():
        shared = {}
        for x in s:
            for e in holders[x]:
                if e < d:
                    shared[e] = shared.get(e, 0) + 1
        for e, n in shared.items():
            if 100 * n >= threshold * (len(s) + len(sets[e]) - n):
                links.add((e, d))
    found = components(sets, links)
    return sorted((d, len(s), found[d], found[d] == d) for d, s in sets.items())


def edit_distance(a, b, most):
    """The distance, or most + 1 if it is larger."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != b[j - 1]))
        row = new
        if min(row[max(0, i - most):i + most + 1], default=0) > most:
            return most + 1
    return min(row[-1], most + 1)


def line_classes(rows, edits=2, chars_an_edit=20, words_an_edit=20):
    """(doc_id, line_no, n_chars, first_doc_id, first_line_no, kept) of (doc_id, text) rows with distinct ids.

    Lines with a character are linked by one edit for each 20 characters of the longer one, two at most, or by
    one changed word for each 20 of its words.
    """
    flat = [(d, i, x.strip()) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    first = {}
    for d, i, x in sorted(flat):
        if x:
            first.setdefault(x, (d, i))
    links = []
    by_chars, by_words = {}, {}
    for x in first:
        by_chars.setdefault(len(x), []).append((x, Counter(x)))
        words = x.split()
        by_words.setdefault(len(words), []).append((words, Counter(words), x))
    for n, held in by_chars.items():
        for k in range(n, n + edits + 1):
            most = min(edits, k // chars_an_edit)
            if most < max(1, k - n):
                continue
            for x, count in held:
                for y, other in by_chars.get(k, ()):
                    if (k > n or y > x) and len(list((count - other).elements())) <= most:
                        if edit_distance(x, y, most) <= most:
                            links.append((first[x], first[y]))
    for n, held in by_words.items():
        for k in by_words:
            most = k // words_an_edit
            if not n <= k <= n + most or most == 0:
                continue
            for a, count, x in held:
                for b, other, y in by_words[k]:
                    if (k > n or y > x) and k - sum((count & other).values()) <= most:
                        if edit_distance(a, b, most) <= most:
                            links.append((first[x], first[y]))
    found = components(first.values(), links)
    out = []
    for d, i, x in flat:
        f = found[first[x]] if x else (d, i)
        out.append((d, i, len(x), *f, f == (d, i)))
    return sorted(out)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    """(start, rank of the kind, end, kind) of the base spans, in order."""
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def line_fails(line):
    chars = sum(len(w) for w in WORD.findall(line))
    n = len(WORD.findall(line))
    symbols = sum(c in "#*$%&|<>" for c in line)
    closed = re.search("[.!?:;…\"'”’»)\\]][\\x20\\x09-\\x0D]*$", line)
    from encore.llm.quality import PHRASES, STOCK_LINE
    return (symbols * 20 > chars or sum(c in "|>»›•·→" for c in line) >= 3 or (not closed and n < 8)
            or (n <= STOCK_LINE and bool(re.search(f"(?i)({PHRASES})", line))))


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) and the text that is left."""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = {x for x in windows if windows.count(x) > 1} if len(windows) < 400 else None
    if often is None:
        counts = {}
        for x in windows:
            counts[x] = counts.get(x, 0) + 1
        often = {x for x, n in counts.items() if n > 1}
    repeated = len({i + k for i, x in enumerate(windows) if x in often for k in range(3)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    chars = sum(map(len, w))
    left = sum(len(v) for x in lines if not line_fails(x) for v in WORD.findall(x))
    base_failed = len(w) < 50 or 100 * repeated > 50 * len(w)
    rest = "\n".join(x for x in text.split("\n") if not WORD.search(x) or not line_fails(x))
    return (len(w), chars, sum(c in "#*$%&|<>" for c in text), dup, repeated, base_failed,
            not base_failed and 100 * left >= 50 * chars), rest


def without_repeated_lines(rows):
    gone = {(r[0], r[1]) for r in line_classes(rows) if not r[5]}
    return [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows]


def bare_words(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())


def alignment(p, t):
    row, best = [0] * (len(t) + 1), 0
    for x in p:
        new = [0]
        for j, y in enumerate(t):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, max(new))
    return best


def coded_alignment(p, t):
    """The same by rows of numbers, for long texts."""
    import numpy as np
    t, row, best = np.array(t), np.zeros(len(t) + 1, dtype=int), 0
    at = np.arange(len(t) + 1)
    for x in p:
        new = np.concatenate(([0], np.maximum(np.maximum(row[:-1] + np.where(t == x, 2, -1), row[1:] - 1), 0)))
        row = np.maximum.accumulate(new + at) - at
        best = max(best, int(row.max()))
    return best


def leaks(rows, items, least=0.5):
    """Best score of each (doc_id, item_id) that reaches `least`, from all pairs."""
    out, number = {}, {}
    words = [(d, [number.setdefault(w, len(number)) for w in bare_words(t)]) for d, t in rows]
    for i, text in items:
        p = [number.get(w, -1 - k) for k, w in enumerate(bare_words(text))]
        if len(p) < 3:
            continue
        for d, t in words:
            held = set(t)
            if sum(x in held for x in p) >= least * len(p):
                score = coded_alignment(p, t) / (2 * len(p))
                if score >= least:
                    out[d, i] = score
    return out
