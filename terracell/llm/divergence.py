"""How far the vocabularies of a language's sources are apart (operator 12)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, keep, released
from .shingles import LOWER

#: ASCII letters and whatever is not ASCII, in UTF-8 bytes with A-Z lower-cased
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: bytes of text whose terms are counted together
STEP = 16 << 20
#: terms of a block of ids, about; the arrays of a pair task are no longer
BLOCK_TERMS = 32_768
#: sources of a tile, about; a task merges the pairs of two tiles
TILE = 8
#: prices are whole numbers out of this
SCALE = 1_000_000_000

COUNTS = "lang string, source string, term string, n long, n_docs long"


def term_counts(rows: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs, added up within STEP bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", STEP):
            found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                terms = TERM.findall(text.as_py().translate(LOWER))
                n, n_docs = found.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                n_docs.update(set(terms))
            for (lang, source), (n, n_docs) in found.items():
                size = len(n)
                columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string())]
                columns += [pa.array(list(n.values()), pa.int64()), pa.array([n_docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COUNTS.split(", ")])

    return rows.mapInArrow(released(run), COUNTS)


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), in decimals that hold any count of a corpus."""
    share = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.call_function("div", share, (total + 2 * terms).cast("decimal(29,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); prices are at most SCALE + 1, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """price for numpy: a long division by thousands, exact while 1000 (total + 2 terms) fits 63 bits."""
    divisor = np.int64(total + 2 * terms)
    if divisor > (1 << 63) // 1000:
        raise OverflowError(f"{total} occurrences are too many")
    rest, found = counts + 2, np.zeros(len(counts), np.int64)
    found += rest // divisor
    rest = rest % divisor
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // divisor
        rest = rest % divisor
    return found + 1


def distance(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) ** 2 // (p + q)).sum())


class Terms:
    """One source's terms of a block: sorted ids, their prices, and the price of a term it lacks."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, total: int, terms: int):
        order = np.argsort(ids)
        self.ids, self.prices = ids[order], prices(counts[order], total, terms)
        self.absent = prices(np.zeros(1, np.int64), total, terms)

    def merged(self, other: Terms) -> tuple[int, int]:
        """Distance over the terms that either has, and their number.

        The shorter array's ids are searched in the longer one, each from the place of the one before on.
        """
        short, long = (self, other) if len(self.ids) <= len(other.ids) else (other, self)
        at = np.searchsorted(long.ids, short.ids)
        both = at < len(long.ids)
        both[both] = long.ids[at[both]] == short.ids[both]
        alone = np.ones(len(long.ids), bool)
        alone[at[both]] = False
        value = distance(short.prices[both], long.prices[at[both]])
        value += distance(short.prices[~both], long.absent) + distance(long.prices[alone], short.absent)
        return value, len(short.ids) + int(alone.sum())


def merged_pairs(arrays: DataFrame) -> DataFrame:
    """lang, a, b, value, n_terms per block and unordered pair of sources a < b.

    arrays: lang, block, source, tile, tiles, total, terms, ids, counts. Every array goes to one task for each tile of its language.
    """

    def run(table: pa.Table) -> pa.Table:
        own, names = table.column("tile").to_pylist(), table.column("source").to_pylist()
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        totals, terms = table.column("total").to_pylist(), table.column("terms")[0].as_py()
        lists = zip(table.column("ids"), table.column("counts"), totals)
        groups = [Terms(np.array(i.values.to_numpy(), np.int64), np.array(c.values.to_numpy(), np.int64), total, terms) for i, c, total in lists]
        out = []
        for i in range(len(groups)):
            for j in range(len(groups)):
                if (own[i], own[j]) == (first, second) and (first != second or names[i] < names[j]):
                    a, b = sorted((names[i], names[j]))
                    out.append((a, b, *groups[i].merged(groups[j])))
        lang = [table.column("lang")[0].as_py()] * len(out)
        a, b, value, n_terms = zip(*out) if out else [[]] * 4
        return pa.table({"lang": pa.array(lang, pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64()), "n_terms": pa.array(n_terms, pa.int64())})

    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    spread = arrays.withColumn("other", other).withColumns({"first": F.least("tile", "other"), "second": F.greatest("tile", "other")})
    return spread.groupBy("lang", "block", "first", "second").applyInArrow(run, "lang string, a string, b string, value long, n_terms long")


def source_divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """Distances between the term prices of each language's sources, and the terms that set a source apart from its language.

    A language keeps the terms that at least min_docs of its documents have. A group (language and source) gives each kept
    term a price by its smoothed share of the group's kept occurrences (see price), and so does the language as a
    whole. Terms are counted where the texts are; counts meet by (language, term). Kept terms get ids in blocks of about
    BLOCK_TERMS, and a group is a sorted (id, count) array per block. For two sources the shorter array is searched in the
    longer one: terms of both, of the one, of the other and, once for all blocks, of neither are priced and added up. The distance is
    the same both ways. Tasks take the pairs of two tiles of about TILE sources in one block.

    Returns lang, source, part, item, value (long), rank (int). Part `pair`: item is each other source of the language. Part `term`:
    item is a kept term that the source has at a higher price than the language, the top_terms of them. Ranks start at 1 per
    group and part, by value from the largest, then by item.

    Null text, lang and source are ''; a text without terms makes a group like any other. Without kept terms all distances are 0.
    Texts of any length are counted whole; repeated rows count each. Ties go by item. An empty table gives no rows. Other columns
    are ignored.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    sources = keep(rows.select("lang", "source").distinct(), "sources")

    # one shuffle by term serves the sums per source and those of the language
    by_term = Window.partitionBy("lang", "term")
    counted = term_counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    counted = counted.withColumns(
        {
            "lang_docs": F.sum("n_docs").over(by_term),
            "lang_n": F.sum("n").over(by_term),
            "first_source": F.min("source").over(by_term),
        }
    )
    kept = keep(counted.filter(F.col("lang_docs") >= min_docs).drop("n_docs", "lang_docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count_if(F.col("source") == F.col("first_source")).alias("terms"), F.sum("n").alias("lang_total"))
    n_sources = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = sources.join(n_sources, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = keep(groups.fillna(0, ["terms", "lang_total", "total"]), "groups")

    known = kept.join(groups, ["lang", "source"])
    blocks = F.expr(f"(terms + {BLOCK_TERMS - 1}) div {BLOCK_TERMS}")
    known = known.withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    ids = known.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")))
    arrays = ids.groupBy("lang", "block", "source").agg(F.collect_list("id").alias("ids"), F.collect_list("n").alias("counts"))
    tiles = F.expr(f"(n_sources + {TILE - 1}) div {TILE}")
    # every source in every block, since what it lacks there has a price, too
    grid = groups.filter("terms > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    grid = grid.select("lang", "block", "source", "total", "terms", tiles.alias("tiles")).withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    empty = F.array().cast("array<bigint>")
    arrays = grid.join(arrays, ["lang", "block", "source"], "left").withColumns(
        {"ids": F.coalesce(F.col("ids").cast("array<bigint>"), empty), "counts": F.coalesce("counts", empty)}
    )
    arrays = keep(arrays, "term-arrays")

    merged = merged_pairs(arrays).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("n_terms").alias("n_terms"))
    absent = price(F.lit(0), F.col("total"), F.col("terms"))
    side = groups.select("lang", "source", "terms", F.when(F.col("terms") > 0, absent).alias("absent"))
    both = side.selectExpr("lang", "source as a", "terms", "absent as absent_a").join(
        side.selectExpr("lang", "source as b", "absent as absent_b"), "lang"
    )
    both = both.filter("a < b").join(merged, ["lang", "a", "b"], "left").fillna(0, ["value", "n_terms"])
    neither = F.when(F.col("terms") > 0, (F.col("terms") - F.col("n_terms")) * apart(F.col("absent_a"), F.col("absent_b"))).otherwise(0)
    distances = both.select("lang", "a", "b", (F.col("value") + neither).cast("long").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = distances.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    p, q = price(F.col("n"), F.col("total"), F.col("terms")), price(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    priced = known.withColumns({"p": p, "q": q}).filter("p > q")
    terms = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top = terms.withColumn("rank", rank).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", rank).unionByName(top)
