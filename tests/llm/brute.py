"""Plain versions of the operators for small inputs."""

import re


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        at[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def similar(a, b, percent=80):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))


def leaks(text, items, window=10):
    w, hit, found = bench_words(text), set(), set()
    for i, t in items:
        x = bench_words(t)
        n = min(window, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)
