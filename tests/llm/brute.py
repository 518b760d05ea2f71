"""Brute-force versions that several tests use."""

from collections import defaultdict

from sparkweave.llm import linededup


def brute_dedup(rows):
    """Every run of 50 words or more in whole lines that stood before goes."""
    runs = defaultdict(list)
    for i, text in rows:
        lines = text.split("\n")
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                if n >= linededup.MIN_WORDS:
                    runs["\n".join(lines[a : b + 1])].append((i, a, b + 1))
    gone = defaultdict(set)
    for places in runs.values():
        for i, a, b in sorted(places)[1:]:
            gone[i].update(range(a, b))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def brute_sets(texts):
    out = []
    for t in texts:
        words = (t or "").lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_groups(texts):
    sets = brute_sets(texts)
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root
