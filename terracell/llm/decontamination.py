"""Benchmark decontamination through an FM-index per training shard (operator 1)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released
from .fm_index import FMIndex

#: benchmark text that the driver or a task holds at a time; a larger benchmark is searched in several blocks
BLOCK_BYTES = 4_000_000
#: words of documents in one index; a longer document has an index of its own
SHARD_WORDS = 1_500_000

#: A-Z to lower case, every other ASCII byte but a-z and 0-9 to a space
FOLD = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))
WORD = re.compile(rb"[^ ]+")

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Phrases:
    """The windows of some benchmark items: distinct word sequences, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if words else 0):
                owners.setdefault(tuple(words[k : k + size]), set()).add(item)
        self.owners = [sorted(o) for o in owners.values()]
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        self.table = np.zeros((len(owners), window), np.int64)
        for k, p in enumerate(owners):
            self.table[k, : len(p)] = p


def search_shard(docs: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in a shard of documents: document, first word, word behind, phrase.

    The index holds the runs of words that the benchmark also has. A phrase lies inside one run, so runs
    shorter than the shortest phrase are left out of it.
    """
    counts = np.array([len(d) for d in docs], np.int64)
    total = int(counts.sum())
    ids = np.fromiter((i for d in docs for i in map(phrases.ids.get, d, repeat(0))), np.int64, total)
    doc = np.repeat(np.arange(len(docs)), counts)
    new_run = np.ones(total, bool)
    new_run[1:] = (ids[1:] == 0) | (ids[:-1] == 0) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new_run)
    lengths = np.diff(starts, append=total)
    use = (ids[starts] > 0) & (lengths >= phrases.shortest) if total else np.zeros(0, bool)
    starts, lengths = starts[use], lengths[use]
    # each run with a terminator behind it
    run_at = np.cumsum(lengths + 1) - (lengths + 1)
    run = np.repeat(np.arange(len(starts)), lengths + 1)
    inside = np.arange(len(run)) - run_at[run]
    closed = inside == lengths[run]
    source = np.where(closed, 0, starts[run] + inside)
    index = FMIndex(np.where(closed, 0, ids[source]) if len(run) else np.zeros(0, np.int64))
    who, low, high = index.search(phrases.table, phrases.lengths)
    times = high - low
    rows = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    phrase = np.repeat(who, times)
    at = source[index.locate(rows)] if len(rows) else rows
    first = at - (np.cumsum(counts) - counts)[doc[at]] if len(rows) else at
    return (doc[at] if len(rows) else at), first, first + phrases.lengths[phrase], phrase


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching half-open spans as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text with the bytes from each span's first word to its last one taken out."""
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def search_batches(
    batches: Iterator[pa.RecordBatch], phrases: Phrases, cut: bool, texts_out: bool, shard_words: int
) -> Iterator[pa.RecordBatch]:
    """Fill up shards with documents, search each, and give its rows back with spans and items added.

    Columns behind the first four (doc_id, text, spans, items) are passed on.
    """

    def flush(rows: list[dict], docs: list[list[bytes]], schema: pa.Schema) -> pa.RecordBatch:
        hits: dict[int, tuple[set, set]] = {}
        for doc, first, end, phrase in zip(*(x.tolist() for x in search_shard(docs, phrases))):
            spans, items = hits.setdefault(doc, (set(), set()))
            spans.add((first, end))
            items.update(phrases.owners[phrase])
        for k, (spans, items) in hits.items():
            before = [(s["start"], s["end"]) for s in rows[k]["spans"]]
            rows[k]["spans"] = [{"start": s, "end": e} for s, e in merged([*before, *spans])]
            rows[k]["items"] = sorted({*rows[k]["items"], *items})
        for row in rows:
            body = row.pop("body")
            if cut and row["spans"]:
                body = without_spans(body, [(s["start"], s["end"]) for s in row["spans"]])
            row["text"] = None if body is None or not texts_out else body.decode()
        return pa.RecordBatch.from_pylist(rows, schema)

    rows, docs, filled, schema = [], [], 0, None
    for batch in batches:
        given = batch.schema
        schema = pa.schema(
            [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))]
            + [(f.name, f.type) for f in list(given)[4:]]
        )
        texts = batch.column("text").cast(pa.binary())
        others = {f.name: batch.column(f.name).to_pylist() for f in given if f.name != "text"}
        for k in range(batch.num_rows):
            body = texts[k].as_py()
            words = words_of(body)
            if docs and filled + len(words) > shard_words:
                yield flush(rows, docs, schema)
                rows, docs, filled = [], [], 0
            rows.append({c: v[k] for c, v in others.items()} | {"body": body, "n_words": len(words)})
            docs.append(words)
            filled += len(words)
    if docs:
        yield flush(rows, docs, schema)


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Phrases, bool]]:
    """The benchmark's windows, at most about block_bytes of text at a time, and whether they are the last."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).filter(
        "item is not null and text is not null"
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield Phrases([(r["item"], bytes(r["text"])) for r in part.collect()], window), k == n - 1


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    cut: bool = True,
    with_text: bool = True,
    carry: tuple[str, ...] = (),
    block_bytes: int = BLOCK_BYTES,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Find every benchmark window in every document, and cut the merged spans out of the text.

    A window is `window` consecutive words of an item; an item of fewer words is one window. Each task gathers
    documents into shards of shard_words, builds an FM-index over a shard and searches all windows backwards in
    it. Only benchmark text travels, at most block_bytes at a time: a larger benchmark is searched block after block
    in one narrow pass over the documents. No shuffle takes place, and no document meets another outside its task.

    docs: doc_id, text. benchmark: item_id, text. Returns doc_id, text (without the spans if `cut`; no such column
    unless with_text), n_words, spans (merged half-open word spans of the original text), items (sorted ids of the items
    found), and the columns named in carry.

    Null text has no words and stays null; text of any length is searched whole. Null item ids or texts take no part;
    an item that occurs twice counts once. Repeated documents are reported each. An empty benchmark finds nothing, an
    empty table gives no rows. Other columns are ignored.
    """
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
        *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)),
    )
    columns = out.columns
    fields = T.StructType([*FOUND.fields, *out.schema.fields[4:]])
    for phrases, last in benchmark_blocks(benchmark, window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(phrases)

        def run(batches, shared=shared, last=last):
            return search_batches(batches, shared.value, cut and last, with_text or not last, shard_words)

        out = out.select(*columns).mapInArrow(released(run), fields)
    out = out.withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry)})
    return out if with_text else out.drop("text")
