"""Plain versions of the training-data operators, row by row, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def repeated_strings(rows, width=100):
    """Of (id, text) rows with distinct ids."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if raw[i : i + width] in seen:
                gone[i : i + width] = b"\x01" * width
            seen.add(raw[i : i + width])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[key] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def repeated_windows(rows, window=50):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = WORD.findall(text or "")
        gone, new = [0] * len(words), []
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                gone[i : i + window] = [1] * window
            new.append(run)
        seen.update(new)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[key] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def near_classes(rows, width, percent):
    sets = {}
    for key, text in rows:
        words = WORD.findall(lowered(text or ""))
        sets[key] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for k, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    for k, s in sets.items():
        shared = Counter(o for x in s for o in by_shingle[x] if o < k)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
    return {k: (len(s), root(k), root(k) == k) for k, s in sets.items()}


def base_counts(text):
    words = WORD.findall(text or "")
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = [0] * len(words)
    for i in range(len(words) - 4):
        if runs[tuple(words[i : i + 5])] > 1:
            inside[i : i + 5] = [1] * 5
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, sum(inside), len(words) < 10 or 100 * sum(inside) > 20 * len(words)


def folded(text):
    """Case and punctuation folded as bytes, for texts whose letters are ASCII or Latin-1."""
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", text.lower()).strip().encode()


def least_edits(item, text):
    """Of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for j, c in enumerate(item, 1):
        new = [j]
        for i, d in enumerate(text, 1):
            new.append(min(row[i - 1] + (c != d), row[i] + 1, new[i - 1] + 1))
        row = new
    return min(row)


def best_fit(pieces, capacity):
    """By looking at every bin for each piece."""
    bins, out = [], []
    for size, source, cluster in pieces:
        fit = [
            (b["left"], k) for k, b in enumerate(bins)
            if b["left"] >= size and not (source is not None and source in b["sources"]) and not (cluster is not None and cluster in b["clusters"])
        ]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= size
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
    return out


def kneser_ney(texts, order):
    """p(gram) of an interpolated modified model over bytes, by recursion on dictionaries."""
    counts = Counter()
    for text in texts:
        raw = bytes(order - 1) + text.encode()
        counts.update(raw[i : i + order] for i in range(len(text.encode())))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    off = {}
    for k, c in levels.items():
        n = [sum(1 for v in c.values() if v == j) for j in (1, 2, 3, 4)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            off[k] = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]
        else:
            off[k] = [0.5, 0.75, 0.9]

    def p(gram):
        if not gram:
            return 1 / 256
        k = len(gram)
        inside = {g: v for g, v in levels[k].items() if g[:-1] == gram[:-1]}
        total = sum(inside.values())
        if not total:
            return p(gram[1:])
        minus = lambda v: off[k][min(v, 3) - 1]
        own = inside.get(gram, 0)
        return (own - minus(own) if own else 0) / total + sum(map(minus, inside.values())) / total * p(gram[1:])

    return p
