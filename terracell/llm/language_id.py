"""Language identification by cross-parsing against suffix automata (operator 4)."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import piece

#: labelled documents drawn per language, at most about
SAMPLE_DOCS = 160
#: characters used of each of them, in one piece from a place drawn by hash
SAMPLE_CHARS = 250
#: characters in all languages' automata together, and in one of them
MODEL_CHARS = 200_000
LANGUAGE_CHARS = 40_000
#: symbols of the common alphabet: gaps, unknown letters, the most frequent letters, and SHARED ones that all others share by code point.
#: A state is a row of so many 32-bit moves, and there are at most two states a character: 205 MB for all languages at the very most
ALPHABET, SHARED = 128, 30
#: characters parsed in one go; no phrase reaches over the edge of such a segment
SEGMENT = 1024
#: how sharply the score falls with the bits per character that a language loses to the best
SHARPNESS = 12.0

SCORED = "doc_id long, lang_pred string, score double"


class SuffixAutomaton:
    """All substrings of a symbol sequence, as a dense table of moves."""

    def __init__(self, symbols: list[int], alphabet: int):
        """Online construction: one new state a symbol, and a clone where a suffix gets a context of its own."""
        moves: list[dict[int, int]] = [{}]
        link, size = [-1], [0]
        last = 0
        for s in symbols:
            new = len(moves)
            moves.append({})
            size.append(size[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and s not in moves[at]:
                moves[at][s] = new
                at = link[at]
            if at >= 0:
                target = moves[at][s]
                if size[target] == size[at] + 1:
                    link[new] = target
                else:
                    clone = len(moves)
                    moves.append(dict(moves[target]))
                    size.append(size[at] + 1)
                    link.append(link[target])
                    while at >= 0 and moves[at].get(s) == target:
                        moves[at][s] = clone
                        at = link[at]
                    link[target] = link[new] = clone
            last = new
        start = np.array([moves[0].get(s, 0) for s in range(alphabet)], np.int32) * alphabet
        # a missing move ends the phrase (odd value) and goes on from the start
        self.table = np.tile(start * 2 + 1, (len(moves), 1))
        for state, to in enumerate(moves):
            for s, target in to.items():
                self.table[state, s] = target * alphabet * 2
        self.table = self.table.ravel()


class LanguageModel:
    """An automaton per language over a common alphabet of letters."""

    def __init__(self, samples: dict[str, list[str]], language_chars: int):
        self.languages = sorted(samples)
        seen = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        letters = sorted(seen, key=lambda c: (-seen[c], c))
        own = len(letters) if len(letters) <= ALPHABET - 2 else ALPHABET - 2 - SHARED
        #: 0 stands for everything between words, 1 for a letter that no sample has
        self.symbol = {c: k + 2 if k < own else own + 2 + ord(c) % SHARED for k, c in enumerate(letters)}
        self.alphabet = own + 2 + SHARED * (own < len(letters))
        self.codes = np.zeros(0x110000, np.uint16)
        self.letter = np.zeros(0x110000, bool)
        for k in range(0x110000):
            if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k))[0] in "LM":
                self.codes[k] = self.symbol.get(chr(k).lower(), 1)
                self.letter[k] = chr(k).isalpha()
        self.automata, self.bits = [], []
        for language in self.languages:
            symbols: list[int] = []
            for text in samples[language]:
                if len(symbols) >= language_chars:
                    break
                symbols += self.encode(text)[0].tolist()
            self.automata.append(SuffixAutomaton(symbols[:language_chars], self.alphabet))
            self.bits.append(np.log2(max(2, min(len(symbols), language_chars))))

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of a text, each gap between words as one 0 with one in front, and whether it has a letter."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        codes = self.codes[points]
        codes = np.concatenate([np.zeros(1, np.uint16), codes])
        use = np.ones(len(codes), bool)
        use[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        return codes[use], bool(self.letter[points].any())

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases that each language needs for each segment, all segments advancing side by side."""
        by = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[by], lengths[by]
        counts = np.ones((len(self.languages), len(by)), np.int32)
        states = np.zeros((len(self.languages), len(by)), np.int32)
        active = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")
        for k, width in enumerate(active):
            read = symbols[starts[:width] + k]
            for automaton, state, count in zip(self.automata, states, counts):
                moved = automaton.table[state[:width] + read]
                count[:width] += moved & 1
                state[:width] = moved >> 1
        out = np.empty_like(counts)
        out[:, by] = counts
        return out

    def score(self, batches: Iterator[pa.RecordBatch], sharpness: float) -> Iterator[pa.RecordBatch]:
        bits = np.array(self.bits)[:, None]
        for batch in batches:
            encoded = [self.encode(t) if t is not None else (np.zeros(0, np.uint16), False) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(e[0]) for e in encoded], np.int64)
            symbols = np.concatenate([np.zeros(0, np.uint16), *(e[0] for e in encoded)]).astype(np.int32)
            first = np.cumsum(sizes) - sizes
            parts = -(-sizes // SEGMENT)
            doc = np.repeat(np.arange(len(sizes)), parts)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            starts = first[doc] + k * SEGMENT
            lengths = np.minimum(SEGMENT, sizes[doc] - k * SEGMENT)
            counts = self.phrases(symbols, starts, lengths)
            total = np.zeros((len(self.languages), len(sizes)))
            for row, c in zip(total, counts):
                np.add.at(row, doc, c)
            cost = total * bits / np.maximum(sizes, 1)
            known = np.array([e[1] for e in encoded], bool) if self.languages else np.zeros(len(sizes), bool)
            if len(self.languages):
                best = np.argmin(cost, axis=0)
                score = 1 / np.exp2(-sharpness * (cost - cost.min(axis=0))).sum(axis=0)
            else:
                best, score = np.zeros(len(sizes), int), np.zeros(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([self.languages[b] if ok else "und" for b, ok in zip(best, known)], pa.string()),
                    pa.array(np.where(known, score, 0.0), pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, language_chars: int = LANGUAGE_CHARS, model_chars: int = MODEL_CHARS) -> LanguageModel:
    """Automata of a bounded sample: about sample_docs documents a language, chosen by hash and taken in its order, of each a
    piece of at most sample_chars characters from a place drawn by hash.

    labelled: doc_id, text, lang; rows with a null in one of them, or without a letter, take no part.
    """
    rows = labelled.filter("doc_id is not null and text is not null and lang is not null")
    per_language = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    samples: dict[str, list[str]] = {}
    if per_language:
        chance = F.create_map(*[F.lit(x) for lang, n in sorted(per_language.items()) for x in (lang, min(1.0, sample_docs / n))])
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
        drawn = rows.filter(draw < chance[F.col("lang")]).select("lang", "doc_id", draw.alias("draw"), piece("text", "doc_id", sample_chars).alias("text"))
        for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["draw"], r["doc_id"], r["text"])):
            if any(c.isalpha() for c in r["text"]):
                samples.setdefault(r["lang"], []).append(r["text"])
    return LanguageModel(samples, min(language_chars, model_chars // max(1, len(samples))))


def identify(docs: DataFrame, model: LanguageModel, sharpness: float = SHARPNESS) -> DataFrame:
    """Predict each document's language by cross-parsing entropy.

    A text is cut greedily into the longest phrases that a language's labelled text contains, found by walking its
    suffix automaton; phrases times the bits of a pointer into that text, per character, estimate the cross
    entropy, and the lowest wins (the first by name on a tie). Whole texts are parsed, in segments of SEGMENT
    characters; all segments of a batch advance together.

    Returns doc_id, lang_pred, score: the best language's share when each is weighted by 2^(-sharpness * bits above the best).

    Null text, text without a letter, or a model without languages: `und` with score 0. Repeated rows are each
    predicted. An empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: shared.value.score(batches, sharpness), SCORED)
