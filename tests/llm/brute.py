"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def benchmark_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def contamination(docs, items, window=10):
    """(n_words, n_hit, n_items, sha256 of the items) per row of docs."""
    phrases = defaultdict(set)
    for item, text in items:
        words = benchmark_words(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            phrases[tuple(words[k : k + size])].add(str(item))
    out = []
    for _, text in docs:
        words, hit, found = benchmark_words(text), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(words) - size + 1):
                for item in phrases.get(tuple(words[k : k + size]), ()):
                    found.add(item)
                    hit.update(range(k, k + size))
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def shingles(text, size=5):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    width = min(size, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()


def duplicate_groups(docs, percent=80):
    """doc_id -> (set size, smallest id that links reach), comparing every pair."""
    sets = [(i, shingles(text)) for i, text in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def recurring_lines(docs, depth=4, min_docs=5, min_constant=0.6, long_words=13, long_docs=2):
    """doc_id -> (text, n_dropped): lines of recurring templates, and long lines that several documents have."""

    def masked(line):
        return tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall("[^\x20\x09-\x0d]+", line))

    lines = [(i, n, masked(line)) for i, text in docs for n, line in enumerate((text or "").split("\n")) if masked(line)]
    leaf_docs, line_docs, tokens = defaultdict(set), defaultdict(set), Counter()
    for i, _, line in lines:
        leaf_docs[len(line), line[:depth]].add(i)
        line_docs[line].add(i)
    for line, ids in line_docs.items():
        for at, token in enumerate(line[depth:]):
            if token != "<*>":
                tokens[len(line), line[:depth], at, token] += len(ids)
    main = {}
    for (size, lead, at, token), n in tokens.items():
        if n >= min_docs:
            main.setdefault((size, lead, at), Counter())[token] = n
    template = {}
    for line in line_docs:
        leaf = len(line), line[:depth]
        lead, rest = sum(t != "<*>" for t in line[:depth]), enumerate(line[depth:])
        fixed = tuple(t if t != "<*>" and tokens[*leaf, at, t] >= min_docs else None for at, t in rest)
        alike = sum(t is not None and main[*leaf, at].most_common(1)[0][0] == t for at, t in enumerate(fixed))
        if len(leaf_docs[leaf]) >= min_docs and lead + sum(t is not None for t in fixed) >= min_constant * len(line):
            template[line] = leaf if lead + alike >= min_constant * len(line) else (leaf, fixed)
    seen, gone = defaultdict(set), defaultdict(set)
    for i, _, line in lines:
        if line in template:
            seen[template[line]].add(i)
    for i, n, line in lines:
        if line in template and len(seen[template[line]]) >= min_docs and i != min(seen[template[line]]):
            gone[i].add(n)
        if sum(t != "<*>" for t in line) >= long_words and len(line_docs[line]) >= long_docs and i != min(line_docs[line]):
            gone[i].add(n)
    return {
        i: (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[i]), len(gone[i]))
        for i, text in docs
    }


def phrases_needed(text, sample):
    """Greedy longest-match phrases of a symbol sequence against another; a symbol that cannot extend a phrase starts the next."""
    count, current = 1, ""
    for c in text:
        if current + c in sample:
            current += c
        else:
            count += 1
            current = c if c in sample else ""
    return count
