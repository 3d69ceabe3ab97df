"""Plain versions of the corpus operators, for small inputs."""

import hashlib


def suffix_dedup(rows, size=50):
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for s in range(len(b) - size + 1):
            w = b[s : s + size]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < i:
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def quality_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def embedding_dedup(rows, threshold=0.93):
    import numpy as np

    ok = []
    for i, v, label in rows:
        if v is None or label is None or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        v = np.array(v, float)
        ok.append((i, v / 1.0, label))
    links, n = [], {i: 0 for i, _, _ in rows}
    for k, (i, v, a) in enumerate(ok):
        for j, w, b in ok[k + 1 :]:
            if a == b and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= threshold:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    comp = components([i for i, _, _ in rows], links)
    return sorted((i, n[i], comp[i], comp[i] == i) for i, _, _ in rows)


def ngram_join(rows, size=4, percent=85):
    import re

    sets = {}
    for i, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    where, links = {}, []
    for i in sorted(sets):
        seen = {}
        for s in sets[i]:
            for j in where.setdefault(s, []):
                seen[j] = seen.get(j, 0) + 1
            where[s].append(i)
        links += [(j, i) for j, both in seen.items() if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)]
    comp = components(list(sets), links)
    return sorted((i, len(sets[i]), comp[i]) for i in sets)
