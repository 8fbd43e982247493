"""Byte-level BPE by a tokenization automaton (operator 11)."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, released

#: fixed value: how the byte-level pre-tokenizer splits a text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: up to here the letters, numbers and spaces of any Unicode version are the same; other texts are split by the tokenizer's library
LAST_PLAIN = 0x52F
#: words a task remembers; beyond that it starts anew, which costs time only
MEMO_WORDS = 200_000
#: arcs a worker process remembers; beyond that it starts anew
MEMO_ARCS = 400_000
#: bytes of text that are encoded together
STEP = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def plain_pattern() -> str:
    """PATTERN with its classes written out for texts up to LAST_PLAIN, for the faster regular expressions."""

    def members(name: str) -> str:
        found = [c for c in range(LAST_PLAIN + 1) if regex.match(name, chr(c))]
        ends = [(a, b) for a, b in zip([None, *found], [*found, None]) if a is None or b is None or b != a + 1]
        return "".join(f"\\u{start:04x}-\\u{stop:04x}" for (_, start), (stop, _) in zip(ends, ends[1:]))

    inside = {name: members(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    plain = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(inside.values())}]")
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        plain = plain.replace(name, f"[{inside[name]}]")
    return plain.replace(r"\S", f"[^{inside[r'\s']}]")


class TokenizationAutomaton:
    """A deterministic automaton over tokens that accepts, for every byte string, its BPE tokens and no other split of it.

    It starts as one state with a loop for each byte. Merges are compiled in order, each by one gadget: to merge (u, v), the
    state that u leads to gets a copy without the arc v, all arcs u are turned to that copy, and every state with an
    arc u gets an arc uv to where the lost v led. So "u v" is no longer a path where "uv" is one. All arcs of a token lead to
    one state. A state is kept as what it lost against the state it was copied from, (u, v) with the number of the merge; its
    states before are those of u's right parts, and an arc's earlier forms are its left parts.
    """

    def __init__(self, labels: list[bytes | None], merges: list[tuple[int, int, int]]):
        """labels: the bytes of each token id. merges: (u, v, uv) as ids, first merge first."""
        size = len(labels)
        self.labels, self.size = labels, size
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        self.lost: dict[int, int] = {}
        self.tokens = {label: k for k, label in enumerate(labels) if label is not None and len(label) == 1}
        if len(self.tokens) != 256:
            raise ValueError("the vocabulary has to hold every byte")
        for number, (u, v, uv) in enumerate(merges):
            if labels[u] + labels[v] != labels[uv] or self.tokens.get(labels[u]) != u or self.tokens.get(labels[v]) != v:
                raise ValueError(f"merge {number} is not of tokens made before it")
            if labels[uv] in self.tokens:
                raise ValueError(f"merge {number} makes a token a second time")
            if self.arc(u, v):
                self.lost[u * size + v] = number
                self.left[uv], self.right[uv], self.made[uv] = u, v, number
                self.tokens[labels[uv]] = uv
        self.longest = max(map(len, self.tokens))
        self.sizes = [len(label or b"") for label in labels]
        self.known: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}

    def arc(self, x: int, y: int) -> bool:
        """Whether the state that x leads to has an arc y."""
        u, copied = x, len(self.made)
        while u >= 0:
            v, formed = y, len(self.made)
            while v >= 0:
                number = self.lost.get(u * self.size + v)
                if number is not None and number < copied and number <= formed:
                    return False
                v, formed = self.left[v], self.made[v]
            u, copied = self.right[u], self.made[u]
        return True

    def longest_at(self, word: bytes, start: int, end: int) -> int:
        """The longest token that the bytes from start on begin with, up to end."""
        get = self.tokens.get
        for stop in range(min(end, start + self.longest), start, -1):
            found = get(word[start:stop])
            if found is not None:
                return found
        raise AssertionError("every byte is a token")

    def next_shorter(self, y: int) -> int:
        """The longest token that the token y begins with, y left aside; -1 for a byte."""
        found = self.shorter.get(y)
        if found is None:
            label = self.labels[y]
            self.shorter[y] = found = self.longest_at(label, 0, len(label) - 1) if len(label) > 1 else -1
        return found

    def encode(self, word: bytes) -> list[int]:
        """Labels of the accepted path over the word.

        Longer arcs first; a place from which no arc goes on is left for good, since one path at most leads to each place.
        The table of transitions holds the arcs looked at so far.
        """
        size, width, tokens, known = len(word), self.size, self.tokens, self.known
        whole = tokens.get(word)
        if whole is not None:  # an arc of the start, which has all
            return [whole]
        sizes, shorter, longest = self.sizes, self.next_shorter, self.longest
        path: list[int] = []
        dead: set[int] = set()
        at, x = 0, -1
        while at < size:
            stop = min(size, at + longest)
            y = tokens.get(word[at:stop], -1)
            while y < 0:
                stop -= 1
                y = tokens.get(word[at:stop], -1)
            while True:
                while y >= 0:
                    if at + sizes[y] not in dead:
                        if x < 0:
                            break
                        arc = known.get(x * width + y)
                        if arc is None:
                            if len(known) >= MEMO_ARCS:
                                known.clear()
                            known[x * width + y] = arc = self.arc(x, y)
                        if arc:
                            break
                    y = shorter(y)
                if y >= 0:
                    path.append(y)
                    at += sizes[y]
                    x = y
                    break
                dead.add(at)
                y = path.pop()
                x = path[-1] if path else -1
                at -= sizes[y]
                y = shorter(y)
        return path


class ByteTokenizer:
    """A byte-level BPE vocabulary file: added tokens, the split into words, and the automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, split, decoder = given["model"], given["pre_tokenizer"] or {}, given["decoder"] or {}
        plain = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")]
        if model["type"] != "BPE" or any(plain) or model.get("ignore_merges") or given["normalizer"] is not None:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or decoder.get("type") != "ByteLevel":
            raise ValueError(f"{path} splits or decodes in another way")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in given["added_tokens"]):
            raise ValueError(f"{path} has added tokens that look at their neighbours")
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        added = {t["content"]: t["id"] for t in given["added_tokens"]}
        labels: list[bytes | None] = [None] * (1 + max([*vocabulary.values(), *added.values()]))
        for token, k in vocabulary.items():
            labels[k] = bytes(alphabet[c] for c in token)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs]
        self.automaton = TokenizationAutomaton(labels.copy(), merges)
        for token, k in added.items():
            labels[k] = token.encode()
        # labels in one run of bytes; an empty one at the end stands for ids that are not there
        self.joined = np.frombuffer(b"".join(x or b"" for x in labels), np.uint8)
        self.sizes = np.array([*(len(x or b"") for x in labels), 0])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.added = added
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.words = re.compile(plain_pattern())
        self.plain = re.compile(f"[\\x00-\\u{LAST_PLAIN:04x}]*")
        self.library = Tokenizer.from_file(path).pre_tokenizer

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.plain.fullmatch(text):
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at added tokens, and whether a part is one."""
        if self.marks is None:
            yield text, False
            return
        for k, part in enumerate(self.marks.split(text)):
            if part:
                yield part, k % 2 == 1

    def memory(self) -> Words:
        return Words(self.automaton)

    def encode(self, text: str, words: Words) -> np.ndarray:
        found: list[bytes] = []
        for part, mark in self.parts(text):
            if mark:
                found.append(np.int32(self.added[part]).tobytes())
            else:
                found.append(self.encode_plain(part, words).tobytes())
        return np.frombuffer(b"".join(found), np.int32)

    def encode_plain(self, text: str, words: Words) -> np.ndarray:
        """Ids where added tokens in a text are ordinary text."""
        return np.frombuffer(b"".join(map(words.__getitem__, self.split(text))), np.int32)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The labels of each list in order; ids outside the vocabulary have none, and bytes that are no UTF-8 become U+FFFD."""
        values = ids.flatten().to_numpy(zero_copy_only=False)
        values = np.where((values >= 0) & (values < len(self.sizes)), values, len(self.sizes) - 1)
        sizes = self.sizes[values]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[values] - (ends - sizes), sizes)
        joined = self.joined[np.arange(len(shift)) + shift]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))]
        whole = joined.tobytes()
        return pa.array(
            [whole[a:b].decode("utf-8", "replace") if some else None for a, b, some in zip(bounds.tolist(), bounds[1:].tolist(), ids.is_valid().to_pylist())],
            pa.string(),
        )


class Words(dict):
    """Ids of words as 32-bit bytes, encoded when missing."""

    def __init__(self, automaton: TokenizationAutomaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = array("i", self.automaton.encode(word.encode())).tobytes()
        return found


@functools.cache
def byte_tokenizer(path: str) -> ByteTokenizer:
    """Compiled once a worker process: the automaton has one state a merge, whatever is encoded."""
    return ByteTokenizer(path)


def encode(docs: DataFrame, path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Token ids of whole texts, as the byte-level BPE vocabulary file at `path` (on every executor) gives them.

    The text is cut at added tokens, split into words, and every word goes through the automaton; a task
    remembers the words it has seen. One narrow pass, in steps of STEP bytes of text.

    Returns doc_id (long), ids (array<int>), the columns named in carry. Null and empty texts have no ids. Texts of any length are
    encoded whole. Repeated rows come as often as they occur; a null doc_id stays null. An empty table gives no rows. Other
    columns are ignored.
    """
    carried = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    kept = [(c, t) for c, t in given.dtypes if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(path)
        words = tokenizer.memory()
        for batch in by_bytes(batches, "text", STEP):
            ids = [tokenizer.encode(text or "", words) for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c, _ in kept), lists], names=[*(c for c, _ in kept), "ids"])

    found = given.mapInArrow(released(run), ", ".join(f"`{c}` {t}" for c, t in kept) + ", ids array<int>")
    return found.select("doc_id", "ids", *(F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds text, the arc labels of `ids` joined, to rows with a column ids (array<int>); null ids give null.

    The labels are the bytes of tokens, added tokens as they are written. Ids that the file does not have give nothing.
    """
    others = [c for c in encoded.columns if c != "text"]
    given = encoded.select(*others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(path)
        for batch in by_bytes(batches, "ids", STEP):
            yield pa.RecordBatch.from_arrays([*batch.columns, tokenizer.decode(batch.column("ids"))], names=[*others, "text"])

    return given.mapInArrow(released(run), ", ".join(f"`{c}` {t}" for c, t in given.dtypes) + ", text string")
