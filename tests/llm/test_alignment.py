"""Aligned tokens against a plain walk over both token lists."""

import hashlib
from collections import Counter, defaultdict

import pytest

from terracell.llm import alignment
from terracell.llm.alignment import align_tokenizers
from terracell.llm.queries import QUERIES, tokenizer_path

from .test_brute import MIDDLE, docs_of
from .test_edges import TEXTS, documents, rows_of, with_clashes

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain(docs):
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    first, second = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    first.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    assert decoders.ByteLevel().decode(["Ġa"]) == " a"

    def piece_bytes(k):
        piece = second.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(k) else piece.replace("▁", " ").encode()

    def ends(pieces):
        at, out = 0, []
        for p in pieces:
            at += len(p)
            out.append(at)
        return out

    links, counts = [], Counter()
    for _, text in docs:
        found = None
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            bytes_a = [bytes(byte_of[c] for c in first.id_to_token(k)) for k in a]
            bytes_b = [piece_bytes(k) for k in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                at_a, at_b = dict(zip(ends(bytes_a), a)), dict(zip(ends(bytes_b), b))
                both = sorted(set(at_a) & set(at_b))
                linked = [(at_a[x], at_b[x]) for x in both]
                groups, left, right = [], [], []
                for x in sorted({*at_a, *at_b}):
                    left += [str(at_a[x])] if x in at_a else []
                    right += [str(at_b[x])] if x in at_b else []
                    if x in at_a and x in at_b:
                        groups.append(f"{','.join(left)}|{','.join(right)}")
                        left, right = [], []
                found = len(a), len(b), linked, hashlib.sha256(";".join(groups).encode()).hexdigest()
                counts.update(linked)
        links.append(found)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for (i, _), found in zip(docs, links):
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, linked, digest = found
            best = sum(counts[x] == highest[x[1]] for x in linked)
            out.append((i, n_a, n_b, len(linked), len(linked), best, sum(counts[x] for x in linked), digest))
    return sorted(out, key=str)


def test_query_equals_a_plain_walk(spark):
    short = [(i, t) for i, t in docs_of(MIDDLE) if not t or len(t) < 3000]
    frame = spark.createDataFrame(short, "doc_id long, text string").repartition(3)
    assert rows_of(align_tokenizers(frame, *PATHS)) == plain(short)


def test_whole_query(spark):
    found = QUERIES["op13_tokenizer_alignment"](spark, MIDDLE).toPandas()
    docs = docs_of(MIDDLE)
    assert sorted(found.doc_id) == sorted(i for i, _ in docs)
    some = found.set_index("doc_id").loc[[i for i, t in docs if t]]
    assert (some.n_groups == some.n_links).all() and (some.n_best <= some.n_links).all() and (some.n_a > 0).mean() > 0.9


@pytest.mark.parametrize("limit", [0, 2_000_000])
def test_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", limit)
    odd = [(20, "a <|endoftext|> b"), (21, "two  spaces\tand\n\nlines "), (22, "▁"), (23, "ﬁ ｆｕｌｌ ①"), (24, "\x00 nul"), (25, "﷽ 🙂🙂 ñandú é"), (26, " ")]
    rows = [*TEXTS, *((*x, "en", "s") for x in odd), *((*x, "en", "s") for x in odd)]
    found = rows_of(align_tokenizers(documents(spark, rows), *PATHS))
    assert found == plain([r[:2] for r in rows])
    assert rows_of(align_tokenizers(with_clashes(documents(spark, rows)), *PATHS)) == found
    assert rows_of(align_tokenizers(documents(spark, rows[::-1]).repartition(5), *PATHS)) == found
    assert align_tokenizers(documents(spark, []), *PATHS).collect() == []
    by_id = {r[0]: r for r in found}
    assert by_id[2][1:] == by_id[3][1:] == (0, 0, 0, 0, 0, 0, "") and by_id[20][1] > 0
