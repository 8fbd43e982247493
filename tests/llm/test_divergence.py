"""Distances of sources against a plain computation."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from terracell.llm import divergence
from terracell.llm.divergence import source_divergence

from .brute import FOLD
from .test_edges import TEXTS, documents, rows_of, with_clashes


def plain(rows, min_docs, top):
    docs = [((r[2] or ""), (r[3] or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(FOLD))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        frequency = Counter(t for x, _, words in docs if x == lang for t in set(words))
        kept = sorted(t for t, n in frequency.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for x, source, words in docs:
            if x == lang:
                counts[source].update(w for w in words if w in frequency and frequency[w] >= min_docs)
        whole = sum(counts.values(), Counter())
        price = lambda c, t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for a in counts:
            pairs = [(-sum(f(price(counts[a], t), price(counts[b], t)) for t in kept), b.encode()) for b in counts if b != a]
            terms = [(-f(price(counts[a], t), price(whole, t)), t.encode()) for t in kept if counts[a][t] and price(counts[a], t) > price(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, a, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out, key=str)


def made_up(seed, n_sources=12):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeé" for b in "xyzXYZß"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))), rng.choice(["en", "de"]), f"s{rng.randrange(n_sources)}") for k in range(300)]
    return rows + [(1000, None, "fr", "only"), (1001, "rare words here", "fr", "other"), (1002, "3 4", "en", "Silent")]


@pytest.mark.parametrize("block_terms, tile", [(32_768, 8), (3, 2), (1, 1)])
def test_against_plain_counts(spark, monkeypatch, block_terms, tile):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = made_up(tile)
    wanted = plain(rows, 6, 4)
    assert rows_of(source_divergence(documents(spark, rows).repartition(3), 6, 4)) == wanted
    assert {r[2] for r in wanted} == {"pair", "term"} and len(wanted) > 300


def test_prices_of_large_counts():
    counts, total, terms = np.array([0, 1, 7, 10**12, 5 * 10**14]), 6 * 10**14, 10**7
    wanted = [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]
    assert divergence.prices(counts, total, terms).tolist() == wanted
    assert divergence.prices(np.array([5]), 5, 1).tolist() == [10**9 + 1]


def test_prices_in_sql(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**14, 6 * 10**14, 10**7), (0, 0, 3)], "n long, total long, terms long")
    found = [r[0] for r in df.select(divergence.price(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert found == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in ((10**14, 6 * 10**14, 10**7), (0, 0, 3))]


def test_edges(spark):
    run = lambda d: source_divergence(d, 2, 10)
    found = rows_of(run(documents(spark)))
    assert found == plain(TEXTS, 2, 10)
    assert rows_of(run(with_clashes(documents(spark)))) == found
    assert rows_of(run(documents(spark, TEXTS[::-1]).repartition(5))) == found
    assert run(documents(spark, [])).collect() == []
