"""Packing of token sequences by harmonic classes (operator 6)."""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, keep, released

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker long, rank long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: words, and pieces of words, that a task remembers; beyond that it starts anew, which costs time only
MEMO_WORDS = 400_000
#: bytes of text that are tokenised together, and words or pieces that the tokenizer takes at once
STEP, AT_ONCE = 2 << 20, 20_000

#: a line: punctuation, lower-case letters without marks of their own, punctuation, three pieces to the tokenizer; or anything else
PLAIN = re.compile("^(?:([.,;:!?*#$%&|]*)([a-zß-öø-ÿ]+)([.,;:!?*#$%&|]*)|(.*))$", re.MULTILINE)

#: fixed values: the normaliser and the split into words for which words and their pieces can be taken one by one
KNOWN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The tokenizer that KNOWN describes drops white space and never joins what stands on both sides of it, so a text's ids are
    those of its words in order. The same holds for a run of letters and the punctuation around it, so the many words
    that differ in that only cost one call. Any other tokenizer gets whole texts.
    """

    def __init__(self, tokenizer_path: str):
        # Spark has a task for each core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(tokenizer_path)
        given = json.loads(self.whole.to_str())
        self.by_word = all(given[k] == known for k, known in KNOWN.items())
        # for pieces that are in normal form and cannot be split
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def of(self, texts: bytes | list[bytes]) -> bytes | list[bytes]:
        """Of each text, or of a single one."""
        if isinstance(texts, bytes):
            return self.of([texts])[0]
        if not self.by_word:
            return [as_bytes(e.ids) for e in self.whole.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        if len(self.words) + len(self.pieces) > 2 * MEMO_WORDS:
            self.forget()
        split = [text.split() for text in texts]
        self.learn(list(set().union(*split).difference(self.words)))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def learn(self, words: list[bytes]) -> None:
        if not words:
            return
        before, letters, after, rest = zip(*PLAIN.findall(b"\n".join(words).decode().lower()))
        self.encode_into(self.pieces, self.bare, [p for p in set().union(before, letters, after) if p not in self.pieces])
        ids = self.pieces.__getitem__
        self.words.update(zip(words, map(b"".join, zip(map(ids, before), map(ids, letters), map(ids, after)))))
        odd = [w for w, other in zip(words, rest) if other]
        self.encode_into(self.words, self.whole, [w.decode() for w in odd], odd)

    @staticmethod
    def encode_into(memory: dict, tokenizer, texts: list[str], keys: list | None = None) -> None:
        keys = texts if keys is None else keys
        for k in range(0, len(texts), AT_ONCE):
            found = tokenizer.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)
            memory.update(zip(keys[k : k + AT_ONCE], [as_bytes(e.ids) for e in found]))


def as_bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@functools.cache
def word_ids(tokenizer_path: str) -> WordIds:
    """Loaded once a worker process; what it remembers goes with the task."""
    return WordIds(tokenizer_path)


def cut_lengths(n: int, capacity: int, shares: int) -> list[int]:
    """Lengths that a document of n tokens is cut into.

    Full sequences first; what is left gives up the largest reciprocal share of the capacity
    (capacity/1, /2, ... /shares, rounded down) again and again, and ends in a rest below the smallest share.
    """
    lengths = [capacity] * (n // capacity)
    rest = n % capacity
    smallest = capacity // shares
    while rest >= smallest:
        part = next(capacity // m for m in range(max(1, capacity // rest), shares + 1) if capacity // m <= rest)
        lengths.append(part)
        rest -= part
    return lengths + [rest] * (rest > 0)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, shares: int) -> DataFrame:
    """One row a piece, with its number among the pieces of the same length of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        words, ranks, end = word_ids(tokenizer_path), {}, end_id.to_bytes(4, "little")
        schema = pa.schema([(name.split()[0], pa.int64()) for name in PIECES.split(", ")])
        words.forget()
        for batch in by_bytes(batches, "text", STEP):
            rows = []
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), words.of(texts)):
                ids = body + end
                start, total = 0, len(ids) // 4
                for length in cut_lengths(total, capacity, shares):
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, worker, rank))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)
        words.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), PIECES)


def fill_leftovers(rows: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """First fit, longest piece first, over the few pieces that fill no bin of their own class."""
    pieces = sorted((x for batch in rows for x in batch.to_pylist()), key=lambda x: (-x["length"], x["class_rank"]))
    free: list[int] = []
    at = 0  # no bin before it takes the present length
    length = None
    for x in pieces:
        if x["length"] != length:
            length, at = x["length"], 0
        while at < len(free) and free[at] < length:
            at += 1
        if at == len(free):
            free.append(capacity)
        x["sequence_id"], x["offset"] = x["first_id"] + at, capacity - free[at]
        free[at] -= length
    names = [name.split()[0] for name in PLACED.split(", ")]
    schema = pa.schema([(name, pa.int64()) for name in names])
    yield pa.RecordBatch.from_pylist([{k: x[k] for k in names} for x in pieces], schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, shares: int = 32, end_id: int = 1) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    Harmonic packing with free cuts. A document is cut to lengths that are reciprocal shares of the capacity
    (see cut_lengths), so a class is one length L and a bin of it takes exactly floor(capacity / L) pieces:
    at most `shares` of rounding, or one short rest, stays empty. Every task numbers its pieces class by class on its
    own; the counts per task and class are added up, and a piece's number in its class gives bin and offset. Less
    than one bin of each class is left over, a bounded number of pieces at any input size, and those are packed first fit.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long).

    Null or empty text is the end token alone. Texts of any length are tokenised whole. Repeated rows are
    packed as often as they occur. A null doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    pieces = keep(tokenized_pieces(docs, tokenizer_path, end_id, capacity, shares), "pack-pieces")
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    counts = keep(pieces.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    starts = counts.select("length", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    # one row a class: at most shares + capacity / shares of them
    classes = counts.groupBy("length").agg(F.sum("n").alias("n")).withColumn("per_bin", F.expr(f"{capacity} div length"))
    classes = classes.withColumn("bins", F.expr("n div per_bin"))
    by_length = Window.orderBy(F.desc("length"))
    classes = classes.select(
        "length",
        "per_bin",
        "bins",
        F.sum("bins").over(by_length).alias("bins_to"),
        F.sum("bins").over(Window.partitionBy()).alias("all_bins"),
    )
    ranked = keep(
        pieces.join(starts, ["length", "worker"])
        .join(F.broadcast(classes), "length")
        .withColumn("class_rank", F.col("n_before") + F.col("rank")),
        "pack-ranked",
    )
    in_bins = ranked.filter("class_rank < per_bin * bins").selectExpr(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "bins_to - bins + class_rank div per_bin as sequence_id",
        "(class_rank % per_bin) * length as offset",
    )
    left = ranked.filter("class_rank >= per_bin * bins").withColumn("first_id", F.col("all_bins")).repartition(1)
    return in_bins.unionByName(left.mapInArrow(lambda rows: fill_leftovers(rows, capacity), PLACED))
