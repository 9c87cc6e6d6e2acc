"""Plain versions of what the operators do, for small inputs."""

import collections
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORD.findall(raw)
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def components(rows, size, share):
    """Smallest id reachable from each place of ``rows`` (id, text), over exact links."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        met = collections.Counter()
        for g in s:
            met.update(where[g])
            where[g].append(i)
        for j, both in met.items():
            if 100 * both >= share * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    return sets, [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(len(rows))]
