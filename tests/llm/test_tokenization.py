"""The tokenization automaton against the tokenizer library."""

import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terracell.llm import tokenization
from terracell.llm.queries import QUERIES, tokenizer_path

from .test_brute import MIDDLE, docs_of
from .test_edges import TEXTS, documents, rows_of, with_clashes

PATH = tokenizer_path("byte_bpe_50k.json")
POOL = ["a", "b", "aa", "the", "ing", " ", "  ", "\n", "'s", "'ll", "1", "22", "é", "ß", "你", "好", "🙂", "​", " ", "<|endoftext|>", "<|endof", "ion", "un", "--", "===", "!!", "\r\n", "\t", "\x00", "՘", "THE", "_"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_random_texts_round_trip(library):
    rng, own = random.Random(1), tokenization.ByteTokenizer(PATH)
    words = own.memory()
    for _ in range(4000):
        text = "".join(rng.choice(POOL) for _ in range(rng.randrange(0, 30)))
        ids = own.encode(text, words).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [library.decode(ids, skip_special_tokens=False)] == [text]


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "-" * 3000, "tion" * 1500, "é" * 999])
def test_long_words(library, text):
    assert tokenization.ByteTokenizer(PATH).automaton.encode(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_every_path_of_a_small_automaton():
    """Over all strings of a few letters: the accepted path is what merging by priority gives, and it is the only one."""
    labels = [bytes([k]) for k in range(256)] + [b"ab", b"aa", b"aab", b"ba", b"abab", b"bb"]
    merges = [(97, 98, 256), (97, 97, 257), (97, 256, 258), (98, 97, 259), (256, 256, 260), (98, 98, 261)]
    automaton = tokenization.TokenizationAutomaton(labels, merges)

    def merged(word):
        ids = list(word)
        for u, v, uv in merges:
            at = 0
            while at < len(ids) - 1:
                if ids[at : at + 2] == [u, v]:
                    ids[at : at + 2] = [uv]
                at += 1
        return ids

    def paths(word, before=None):
        if not word:
            yield []
        for k, label in enumerate(labels):
            if word.startswith(label) and (before is None or automaton.arc(before, k)):
                yield from ([k, *rest] for rest in paths(word[len(label) :], k))

    for n in range(1, 9):
        for k in range(2**n):
            word = bytes(97 + (k >> i & 1) for i in range(n))
            assert list(paths(word)) == [merged(word)] == [automaton.encode(word)]


def test_plain_texts_are_split_as_the_library_does(library):
    own = tokenization.ByteTokenizer(PATH)
    for c in map(chr, range(0x530)):
        for text in (f"a{c}a", f"1{c}1", f"!{c}!", f" {c}{c} a", f"a{c} {c}"):
            assert own.words.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_query_equals_the_library(spark, library):
    texts = {i: t or "" for i, t in docs_of(MIDDLE)}
    rows = QUERIES["op11_tokenization_automaton"](spark, MIDDLE).collect()
    assert len(rows) == pq.read_table(f"{MIDDLE}/documents.parquet").num_rows
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        wanted = len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == wanted


def test_edges(spark, library):
    both = lambda d: tokenization.decode(tokenization.encode(d, PATH, carry=("lang",)), PATH)
    found = rows_of(both(documents(spark)))
    assert rows_of(both(with_clashes(documents(spark)))) == found
    assert rows_of(both(documents(spark, TEXTS[::-1]).repartition(5))) == found
    wanted = [(i, library.encode(t or "", add_special_tokens=False).ids, lang, t or "") for i, t, lang, _ in TEXTS]
    assert found == sorted(wanted, key=str)
    assert both(documents(spark, [])).collect() == []
    odd = spark.createDataFrame([(None,), ([],), ([15496, 99999, -1, 50256],)], "ids array<int>").withColumn("text", F.lit("old"))
    assert [r["text"] for r in tokenization.decode(odd, PATH).collect()] == [None, "", "Hello<|endoftext|>"]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokenization.ByteTokenizer(tokenizer_path("word_bpe_49k.json"))
