"""Operators against brute force, on the small tables and on made-up cases."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from terracell.llm import fm_index, language_id, near_duplicates, quality
from terracell.llm.components import components
from terracell.llm.decontamination import decontaminate
from terracell.llm.log_templates import drop_recurring_lines
from terracell.llm.near_duplicates import drop_near_duplicates
from terracell.llm.packing import cut_lengths, pack, word_ids
from terracell.llm.queries import QUERIES, tokenizer_path
from terracell.llm.shingles import Chunk
from terracell.llm.sharding import shard_by_bytes
from terracell.llm.url_templates import url_verdicts

from . import brute

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def docs_of(folder):
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def random_words(rng, n, vocabulary=40):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_fm_index_finds_every_phrase():
    rng = np.random.default_rng(5)
    for sigma in (1, 3, 40):
        runs = [rng.integers(1, sigma + 1, rng.integers(1, 60)) for _ in range(25)]
        runs += runs[:5]  # long repeats
        text = np.concatenate([x for r in runs for x in (r, [0])])
        index = fm_index.FMIndex(text, step=4)
        phrases = np.zeros((60, 6), np.int64)
        lengths = rng.integers(1, 7, 60)
        for k, n in enumerate(lengths):
            phrases[k, :n] = rng.integers(1, sigma + 2, n)  # one id the text lacks
        who, low, high = index.search(phrases, lengths)
        found = {(int(w), int(p)) for w, a, b in zip(who, low, high) for p in index.locate(np.arange(a, b))}
        wanted = {
            (k, p) for k, n in enumerate(lengths) for p in range(len(text) - n + 1) if (text[p : p + n] == phrases[k, :n]).all()
        }
        assert found == wanted


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontaminate_in_one_or_many_blocks(spark, block_bytes):
    rng = random.Random(3)
    items = [(k, " ".join(random_words(rng, rng.choice([1, 4, 9, 10, 11, 30])))) for k in range(12)] + [(50, None), (51, " ,;. ")]
    docs = []
    for k in range(60):
        words = random_words(rng, rng.randrange(0, 80))
        if k % 3 == 0:
            words[5:5] = items[rng.randrange(12)][1].upper().split()
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(words)))
    docs += [(100, None), (101, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(frame(spark, docs), benchmark, block_bytes=block_bytes, shard_words=500).collect()
    wanted = dict(zip([i for i, _ in docs], brute.contamination(docs, items)))
    texts = dict(docs)
    for r in rows:
        n_words, n_hit, n_items, _ = wanted[r["doc_id"]]
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"])) == (n_words, n_hit, n_items)
        words = brute.benchmark_words(texts[r["doc_id"]])
        for s in reversed(r["spans"]):
            del words[s["start"] : s["end"]]
        assert brute.benchmark_words(r["text"]) == words
        assert r["text"] == texts[r["doc_id"]] or r["spans"]


def test_byte_shards(spark):
    rows = QUERIES["op7_byte_shards"](spark, MIDDLE).toPandas()
    texts = dict(docs_of(MIDDLE))
    assert len(rows) == len(texts) and set(rows.doc_id) == set(texts)
    for r in rows.itertuples():
        body = texts[r.doc_id].encode()
        assert (r.text_crc32, rows.loc[r.Index, "size"]) == (zlib.crc32(body), len(body) + 1)
    per_shard = rows.groupby("shard")["size"].sum()
    assert sorted(per_shard.index) == list(range(16))
    assert (abs(per_shard - rows["size"].sum() / 16) <= rows["size"].max()).all()
    for _, shard in rows.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    assert rows.sort_values("doc_id").shard.is_monotonic_increasing


def test_shards_of_equal_rows(spark):
    rows = shard_by_bytes(spark.createDataFrame([(1, "x" * 9)] * 160 + [(None, None)], "doc_id long, text string"), 4).toPandas()
    assert sorted(rows.groupby("shard").size()) == [40, 40, 40, 41]


def test_cut_lengths():
    for n in range(1, 5000):
        lengths = cut_lengths(n, 2048, 32)
        assert sum(lengths) == n and all(1 <= x <= 2048 for x in lengths)
        assert all(x < 64 or x in {2048 // m for m in range(1, 33)} for x in lengths)


def check_packing(rows, texts, tokenizer):
    where = {}
    for doc_id, pieces in rows.groupby("doc_id"):
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in pieces.sort_values("start").itertuples():
            body = b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length])
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(body))
            at += p.length
        assert at == len(ids)
        where[doc_id] = True
    assert set(where) == set(texts)
    for _, sequence in rows.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert (sequence.offset == sequence.length.cumsum() - sequence.length).all()
        assert sequence.length.sum() <= 2048


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = dict(docs_of(MIDDLE))
    rows = QUERIES["op6_harmonic_packing"](spark, MIDDLE).toPandas()
    check_packing(rows, texts, Tokenizer.from_file(tokenizer_path()))
    assert rows.length.sum() >= 0.99 * 2048 * rows.sequence_id.nunique()


def test_word_ids_equal_the_tokenizers():
    rng = random.Random(1)
    parts = [*"aAbBéÉèß×÷ÿŸİıΣσς's tT.,;:!?*#$%&|<>()-_\"@ \t\n\x0b\x0c\ŕ̈…  0 19²½ñÑ你好🙂"]
    parts += ["'s", "'re", "<|endoftext|>", "<|ENDOFTEXT|>", "don't ", "word. "]
    words = word_ids(tokenizer_path())
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        ids = words.whole.encode(text, add_special_tokens=False).ids
        assert words.of(text.encode()) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {x: root(x) for p in links if p[0] != p[1] for x in p}


def near_copies(rng):
    """Groups around the threshold, chains, copies, contained texts and very short texts."""
    docs = []
    for size in (4, 5, 6, 9, 12, 20, 60, 150):
        for _ in range(6):
            base = random_words(rng, size, 5000)
            for edits in (0, 0, 1, 1, 2, 3):
                words = list(base)
                for _ in range(edits):
                    words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
                docs.append(" ".join(words + random_words(rng, rng.randrange(0, 1 + size // 6), 5000)))
    docs += ["", None, "  \n", "one", "One", "one two", "one two three four five", "ONE two three four five"]
    rng.shuffle(docs)
    return list(enumerate(docs, 10))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_lose_no_link(spark, seed):
    docs = near_copies(random.Random(seed))
    rows = near_duplicates.near_duplicates(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.duplicate_groups(docs)


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    """A passage in all documents, which are alike only in pairs and never in the star round."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    rng = random.Random(4)
    passage = random_words(rng, 60, 5000)
    docs = []
    for k in range(60):
        own = random_words(random.Random(k // 2), 16, 5000) + [f"y{k}"]
        docs.append((k, " ".join(passage + own)))
    rows = near_duplicates.near_duplicates(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.duplicate_groups(docs)


def test_rows_of_one_id_keep_the_links_of_all_their_texts(spark):
    rng = random.Random(12)
    one, two = random_words(rng, 30, 5000), random_words(rng, 200, 5000)
    rows = [(5, " ".join(one)), (5, " ".join(two)), (6, " ".join([*one, "x"])), (7, " ".join([*two, "y"])), (4, " ".join(one)), (3, "a b c d e f")]
    found = near_duplicates.near_duplicates(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(5, 4), (6, 4), (7, 4), (4, 4), (3, 3)}


def test_hot_keys_are_spread(spark, monkeypatch):
    """Near copies of one text in most documents: every key of theirs is hot, with the same result."""
    rng = random.Random(9)
    base = random_words(rng, 80, 5000)
    docs = []
    for k in range(120):
        words = list(base) if k % 4 else random_words(rng, 80, 5000)
        for _ in range(k % 7):
            words[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    rows = frame(spark, docs)
    monkeypatch.setattr(near_duplicates, "SAMPLE", 2)
    monkeypatch.setattr(near_duplicates, "HOT", 5)
    monkeypatch.setattr(near_duplicates, "SALTS", 3)
    assert len(near_duplicates.hot_keys(rows, near_duplicates.Bands(80))) > 20
    found = near_duplicates.near_duplicates(rows).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.duplicate_groups(docs)


def test_block_pairs_finds_each_open_pair_once(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    same, far = bytearray(8), bytearray(b"\xff" * 16)
    members = [(1, k, k % 4, 100 + k, same) for k in range(11)] + [(1, 20, 20, 105, far)]
    members += [(2, 50, 50, 10, same), (2, 51, 51, 12, bytearray(16)), (2, 52, 52, 100, same)]
    given = spark.createDataFrame(members, "bucket long, node long, root long, n_shingles long, bits binary")
    rows = near_duplicates.block_pairs(given, 80).collect()
    wanted = {(a, b) for a in range(11) for b in range(a + 1, 11) if a % 4 != b % 4} | {(50, 51)}
    wanted |= {(k, 20) for k in range(11)}  # far folds to nothing: equal parities allow similarity
    assert sorted((r["a"], r["b"]) for r in rows) == sorted(wanted)


def test_sketch_levels_cover_sets_with_empty_blocks():
    """Similar sets always share a key, at whatever level."""
    bands = near_duplicates.Bands(80)
    rng = np.random.default_rng(7)
    for n in [4, 5, 6, 7, 9, 10, 14, 20, 33, 50]:
        for _ in range(150):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a.copy()
            while True:  # as far apart as the threshold allows
                c = np.unique(np.append(b[1:] if rng.random() < 0.5 else b, rng.integers(0, 2**63, 1).astype(np.uint64)))
                if 100 * len(np.intersect1d(a, c)) < 80 * len(np.union1d(a, c)):
                    break
                b = c
            if len(a) == len(np.intersect1d(a, b)) == len(b):
                continue
            rows = [near_duplicates.sketch_rows(Chunk([0], [s]), np.array([0]), bands) for s in (a, b)]
            keys = [{k for _, _, _, ks, _ in r for k in ks.tolist()} for r in rows]
            assert keys[0] & keys[1], (n, len(b))


def test_one_document_of_each_group_stays(spark):
    docs = [*near_copies(random.Random(3)), (10, "one two three four five six"), (None, "a b c d e f"), (None, "a b c d e f")]
    rows = drop_near_duplicates(frame(spark, docs)).collect()
    ids = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    groups = brute.duplicate_groups([d for d in docs[:-3]])
    assert ids == sorted({root for _, root in groups.values()})
    assert sum(r["doc_id"] is None for r in rows) == 2


def test_recurring_lines(spark):
    docs = docs_of(MIDDLE)
    rows = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in QUERIES["op8_log_templates"](spark, MIDDLE).collect()}
    wanted = brute.recurring_lines(docs)
    assert rows == wanted and sum(n for _, n in wanted.values()) > 100


def test_variable_fields_are_generalised(spark):
    docs = [(k, f"user u{k} logged in from host h{k} on {d} at noon\nown line of {'abcdefgh'[k]} here") for k, d in enumerate(["monday", "sunday"] * 4)]
    rows = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in drop_recurring_lines(frame(spark, docs)).collect()}
    assert rows == brute.recurring_lines(docs)
    assert [n for _, n in rows.values()].count(1) == 7  # the first document keeps its line


def test_cross_parsing_counts_phrases():
    rng = random.Random(6)
    sample = "".join(rng.choice("abcd ") for _ in range(300))
    model = language_id.LanguageModel({"x": [sample]}, 10_000)
    encoded = model.encode(sample)[0].tolist()
    as_text = "".join(chr(97 + s) for s in encoded)
    for n in (1, 2, 30, 500):
        text = "".join(rng.choice("abcde ") for _ in range(n))
        symbols = model.encode(text)[0]
        counts = model.phrases(symbols.astype(np.int32), np.array([0]), np.array([len(symbols)]))
        assert counts[0, 0] == brute.phrases_needed("".join(chr(97 + s) for s in symbols), as_text)


def test_language_accuracy_on_held_out_documents(spark):
    rows = QUERIES["op4_cross_parsing_language"](spark, MIDDLE).toPandas()
    docs = pq.read_table(f"{MIDDLE}/documents.parquet", columns=["doc_id", "lang"]).to_pandas()
    both = rows.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    held_out = both[both.held_out]
    assert (held_out.lang == held_out.lang_pred).mean() > 0.97


def test_quality_accuracy_on_held_out_documents(spark):
    rows = QUERIES["op3_compression_quality"](spark, MIDDLE).toPandas()
    labels = pq.read_table(f"{MIDDLE}/labels.parquet").to_pandas()
    both = rows.merge(labels, on="doc_id")
    held_out = both[both.held_out]
    assert (held_out.predicted == held_out.quality).mean() > 0.95
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_quality_without_labels_of_both_classes(spark):
    docs = frame(spark, [(k, "some text here") for k in range(5)])
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert {round(r["score"], 6) for r in quality.score_quality(docs, model).collect()} == {0.75}


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return rest[:cut].translate(brute.FOLD), path[:end]


def longest_rule(host, path):
    best = None
    for verdict, h, p in [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return best


def test_url_rules(spark):
    rows = QUERIES["op5_path_templates"](spark, MIDDLE).collect()
    urls = {r["page_id"]: r["url"] for r in pq.read_table(f"{MIDDLE}/pages.parquet", columns=["page_id", "url"]).to_pylist()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path = host_and_path(urls[r["page_id"]])
        rule = longest_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        if rule:
            assert r["verdict"] == rule[1]


def test_url_templates(spark):
    """Ids become wildcards, look-alike branches merge, and labelled bad templates are rejected."""
    urls = [f"http://a.com/item/{k}" for k in range(30)] + [f"http://a.com/shop/{w}x/buy" for w in "abcdefghijklmnopqrstuvwxyz"]
    urls += [f"http://a.com/spam/{k}" for k in range(20)] + ["http://a.com/item/x?q=1", "HTTP://A.COM", None, "nothing"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("block", "a.com", "/spam/1"), ("allow", "a.com", "/item/")]
    rows = {r["page_id"]: r for r in url_verdicts(pages, rules, gap=0.5).collect()}
    assert rows[0]["template"] == rows[76]["template"] == "/item/*|<n>" and rows[0]["verdict"] == "allow"
    assert {rows[k]["template"] for k in range(30, 56)} == {"/shop/*/buy"}
    spam = [rows[k] for k in range(56, 76)]
    assert {r["verdict"] for r in spam} == {"block"}  # also those no rule reaches
    assert sum(r["rule"] is None for r in spam) == 9
    assert [rows[k]["host"] for k in range(77, 80)] == ["a.com", "", ""]
    assert [rows[k]["verdict"] for k in range(77, 80)] == ["allow"] * 3


def test_pack_small_classes(spark):
    docs = frame(spark, [(k, "word " * k) for k in range(0, 90, 7)] + [(500, None), (501, "")])
    rows = pack(docs, tokenizer_path(), capacity=64, shares=8).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 64
    assert rows.groupby("doc_id").length.sum().to_dict()[500] == 1
