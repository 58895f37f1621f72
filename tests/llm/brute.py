"""Slow, plain versions of the operators to compare with."""


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def closure(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, n):
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", lower(text or ""))]
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_duplicates(docs, n, percent=80):
    """{id: (set size, component)} of [(id, text)] by an inverted index over all shingles."""
    sets = {i: shingles(t, n) for i, t in docs}
    having, links = {}, []
    for i in sorted(sets):
        common = {}
        for s in sets[i]:
            for j in having.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            having[s].append(i)
        links += [(i, j) for j, c in common.items() if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c)]
    found = closure(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}
