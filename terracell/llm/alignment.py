"""Tokens of two tokenizers aligned by the bytes they stand for (operator 13)."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, keep, released
from .tokenization import ByteTokenizer, Words

#: bits of a pair's key that hold the id of the second tokenizer
ID_BITS = 24
#: id pairs that are broadcast to price links; beyond that links and pairs are shuffled
BROADCAST_PAIRS = 2_000_000
#: bytes of text that are aligned together
STEP = 2 << 20

ALIGNED = (
    "text_key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, pair_links array<int>"
)


class TwoTokenizers:
    """A byte-level vocabulary file and a piece model, with the bytes that each id of them stands for."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.first = ByteTokenizer(byte_path)
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.second_bytes = [
            bytes([int(piece[3:5], 16)]) if self.second.is_byte(k) else piece.replace("▁", " ").encode()
            for k, piece in ((k, self.second.id_to_piece(k)) for k in range(self.second.get_piece_size()))
        ]
        self.first_sizes = self.first.sizes
        self.second_sizes = np.array([len(x) for x in self.second_bytes], np.int64)
        # an id with what may follow it: the next id of its side, the other side, the next group
        self.written = [f"{k}{mark}" for k in range(max(len(self.first_sizes), len(self.second_bytes))) for mark in ",|;"]

    def tokens(self, text: str, words: Words) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None where the second side's bytes are not those of a space and the text; the first side's always are."""
        second = self.second.encode(text)
        if b"".join(map(self.second_bytes.__getitem__, second)) != b" " + text.encode():
            return None
        return self.first.encode_plain(" " + text, words).astype(np.int64), np.array(second, np.int64)

    def meet(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the tokens of both sides that end together; the last ones always do."""
        ends = np.cumsum(self.first_sizes[first]), np.cumsum(self.second_sizes[second])
        _, at_first, at_second = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        return at_first, at_second

    def groups(self, first: np.ndarray, second: np.ndarray, at_first: np.ndarray, at_second: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3`: ids of the first and of the second side, group by group."""
        order_first, order_second = np.arange(len(first)), np.arange(len(second))
        in_group, other_group = np.searchsorted(at_first, order_first), np.searchsorted(at_second, order_second)
        out = np.empty(len(first) + len(second), np.int64)
        mark_first, mark_second = np.zeros(len(first), np.int64), np.zeros(len(second), np.int64)
        mark_first[at_first], mark_second[at_second] = 1, 2
        out[order_first + np.concatenate([[0], at_second + 1])[in_group]] = 3 * first + mark_first
        out[order_second + (at_first + 1)[other_group]] = 3 * second + mark_second
        return "".join(map(self.written.__getitem__, out.tolist()))[:-1]


@functools.cache
def two_tokenizers(byte_path: str, piece_path: str) -> TwoTokenizers:
    """Loaded once a worker process."""
    return TwoTokenizers(byte_path, piece_path)


def aligned_texts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Every distinct text once: its digest, how often it occurs, its token counts, groups and linked id pairs.

    Texts without tokens (null, empty, or not given back by both tokenizers byte for byte) are left out.
    A pair is the first side's id, shifted by ID_BITS, and the second side's.
    """
    given = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null and text <> ''")
    distinct = given.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = two_tokenizers(byte_path, piece_path)
        words = both.first.memory()
        schema = pa.schema(
            [("text_key", pa.binary()), ("copies", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("pair_links", pa.list_(pa.int32()))]
        )
        for batch in by_bytes(batches, "text", STEP):
            out: list[tuple] = []
            for text, copies in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist()):
                tokens = both.tokens(text, words)
                if tokens is None:
                    continue
                first, second = tokens
                at = both.meet(first, second)
                pairs, counts = np.unique((first[at[0]] << ID_BITS) | second[at[1]], return_counts=True)
                groups = hashlib.sha256(both.groups(first, second, *at).encode()).hexdigest()
                key = hashlib.sha256(text.encode()).digest()
                out.append((key, copies, len(first), len(second), len(at[0]), len(at[0]), groups, pairs, counts.astype(np.int32)))
            columns = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return distinct.mapInArrow(released(run), ALIGNED)


def links_of(aligned: DataFrame) -> DataFrame:
    """text_key, copies, pair, links: one row for each id pair that a distinct text links."""
    return aligned.select("text_key", "copies", F.inline(F.arrays_zip("pairs", "pair_links"))).withColumnsRenamed(
        {"pairs": "pair", "pair_links": "links"}
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, pair_count (links corpus-wide, every copy of a text counted), is_best (no pair of its second id has more)."""
    counts = keep(links_of(aligned).groupBy("pair").agg(F.sum(F.col("links") * F.col("copies")).alias("pair_count")), "pair-counts")
    second = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    # one row for each id of the second vocabulary, whatever the corpus
    highest = counts.groupBy(second.alias("second_id")).agg(F.max("pair_count").alias("highest"))
    priced = counts.withColumn("second_id", second).join(F.broadcast(highest), "second_id")
    return priced.select("pair", "pair_count", (F.col("pair_count") == F.col("highest")).alias("is_best"))


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """How the tokens of two tokenizers line up in each document, and how usual its links are in the corpus.

    Texts are shuffled by their full text, so each distinct one is tokenised and aligned once, whatever its copies. Both sides'
    tokens cover the same bytes, a space and the text; offsets where both sides end a token cut them into groups, and the
    two tokens that end there are linked. The links of an id pair are added up over all distinct texts, each weighted by
    its copies. A text's links are priced by these counts, and its measures go back to all of its documents by the text's digest.

    Up to BROADCAST_PAIRS id pairs (counted) meet the links by a broadcast, beyond that by a shuffle; a frequent pair
    is one row for each distinct text, and Spark splits what is skewed.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of its second id, ties included), count_sum (the
    counts of all links added up; all long), groups_sha256 (string).

    A text that is null or empty, or that a tokenizer does not give back byte for byte (spaces that the piece model folds, characters
    it normalises), has no tokens: zeros, and '' as groups_sha256. Texts of any length are used whole. Repeated rows come as often
    as they occur and count each; a null doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    aligned = keep(aligned_texts(docs, byte_path, piece_path), "aligned-texts")
    counts = keep(pair_counts(aligned), "priced-pairs")
    few = counts.count() <= BROADCAST_PAIRS
    priced = links_of(aligned).join(F.broadcast(counts) if few else counts, "pair")
    sums = priced.groupBy("text_key").agg(
        F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("links") * F.col("pair_count")).alias("count_sum"),
    )
    measures = keep(aligned.drop("copies", "pairs", "pair_links").join(sums, "text_key"), "measures")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("text_key"))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.join(measures, "text_key", "left").select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
