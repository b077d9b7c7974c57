"""Plain versions of the operators' results, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = {k: [] for k in ("email", "ip", "card", "phone")}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def listed(spans):
    kinds = list(spans)
    rows = sorted((a, kinds.index(k), b) for k, v in spans.items() for a, b in v)
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in rows)


def quality_counts(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def shingles(text, k):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near(rows, k, percent):
    """{id: (size, component)} of (id, text) rows with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for x in s for j in where[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(rows, span=400):
    """[(id, bytes, removed, runs, sha of the kept bytes)] of (id, text) rows."""
    raws = [(i, t.encode()) for i, t in rows]
    many = Counter(hash(t[p : p + span]) for _, t in raws for p in range(len(t) - span + 1))
    out = []
    for i, t in raws:
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if many[hash(t[p : p + span])] > 1:
                gone[p : p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def best_fit_decreasing(histogram, capacity):
    """Number of sequences that best fit opens when it goes from the longest to the shortest."""
    import bisect

    gaps, opened = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                opened += 1
                gap = capacity
            else:
                gap = gaps.pop(at)
            if gap > length:
                bisect.insort(gaps, gap - length)
    return opened
