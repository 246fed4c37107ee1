"""Plain versions of the operators, one text or row at a time."""

import hashlib

import numpy as np
import xxhash


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def groups(links, ids):
    least = {i: i for i in ids}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash(docs):
    prints = []
    for _, text in docs:
        words = lower(text).encode().split()
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    near = [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    links = [(docs[a][0], docs[b][0]) for a, b in near]
    found = groups(links, {i for i, _ in docs})
    return sorted((i, f"{p:016x}", found[i]) for (i, _), p in zip(docs, prints))


def passages(docs, size=50):
    first = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        words = (text or "").encode().split()
        for k in range(len(words) - size + 1):
            first.setdefault(tuple(words[k : k + size]), doc)
    out = []
    for doc, text in docs:
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < doc:
                gone[k : k + size] = True
        out.append((doc, len(words), int(gone.sum()), sha(b" ".join(w for w, g in zip(words, gone) if not g))))
    return sorted(out)


def lines(docs, least=10):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        kept = [line for line in own if len(holders.get(key(line), ())) < 2 or min(holders[key(line)]) == doc]
        out.append((doc, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def url(address, rules):
    host = path = ""
    if address is not None and "://" in address:
        rest = address.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = lower(rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, verdict, rule = max(fits, default=(0, "allow", None), key=lambda f: (f[0], f[1]))
    return host, path, rule, verdict


def minimax(sizes, shards):
    """The least greatest sum of a cut of sizes into so many runs, by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        now = [0] * (len(sizes) + 1)
        for end in range(1, len(sizes) + 1):
            now[end] = min(max(best[start], sum(sizes[start:end])) for start in range(end + 1))
        best = now
    return best[-1]
