"""Cases of the second round of advice."""

from collections import defaultdict

from terracell.llm.log_templates import drop_recurring_lines
from terracell.llm.packing import pack
from terracell.llm.queries import QUERIES, tokenizer_path
from terracell.llm.url_templates import url_verdicts

from . import brute
from .test_brute import MIDDLE, docs_of, frame

PASSAGE = "this passage of sixteen words stands in two documents that share nothing else at all today"


def long_copies(docs, words=13):
    """doc_id -> numbers of the lines of enough words that a document with a smaller id has too."""
    lines, first, gone = [], {}, defaultdict(set)
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            tokens = ["<*>" if any(c in "0123456789" for c in t) else t for t in brute.re.findall("[^\x20\x09-\x0d]+", line)]
            if sum(t != "<*>" for t in tokens) >= words:
                lines.append((i, n, tuple(tokens)))
                first[lines[-1][2]] = min(i, first.get(lines[-1][2], i))
    for i, n, line in lines:
        if i != first[line]:
            gone[i].add(n)
    return gone


def test_passage_in_two_unlike_documents(spark):
    docs = [(1, f"alpha beta gamma\n{PASSAGE} 17\nomega"), (2, f"one more text\nof its own\n{PASSAGE} 99"), (3, "short line\nthird"), (4, "short line\nfourth")]
    rows = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in drop_recurring_lines(frame(spark, docs)).collect()}
    assert rows == {1: (docs[0][1], 0), 2: ("one more text\nof its own", 1), 3: (docs[2][1], 0), 4: (docs[3][1], 0)}


def test_passage_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr("terracell.llm.log_templates.BROADCAST_LEAVES", -1)
    docs = [(k, f"own line of {'abcdefgh'[k]}\nuser u{k} logged in from h{k} at noon") for k in range(8)]
    docs += [(8, f"x\n{PASSAGE}"), (9, f"{PASSAGE}\ny")]
    rows = {r["doc_id"]: r["n_dropped"] for r in drop_recurring_lines(frame(spark, docs)).collect()}
    assert rows == {0: 0, **dict.fromkeys(range(1, 8), 1), 8: 0, 9: 1}


def test_lines_with_long_copies(spark):
    """The lines that brute.recurring_lines drops, and the copies of long ones."""
    docs = docs_of(MIDDLE)
    copies = long_copies(docs)
    rows = {r["doc_id"]: r for r in QUERIES["op8_log_templates"](spark, MIDDLE).collect()}
    for i, (text, _) in brute.recurring_lines(docs).items():
        left, given = (text or "").split("\n"), (dict(docs)[i] or "").split("\n")
        kept = [x for k, x in enumerate(given) if x in left and k not in copies[i]]
        assert ((rows[i]["text"] or "").split("\n"), rows[i]["n_dropped"]) == (kept or [""], len(given) - len(kept))
    assert sum(map(len, copies.values())) > 100


def verdicts(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r["page_id"]]: r for r in url_verdicts(pages, rules).collect()}


def words(n):
    """n different words without digits."""
    return ["".join("abcdefghij"[int(d)] for d in f"{k:04d}") for k in range(n)]


def test_sections_below_a_twentieth(spark):
    """40 sections: the blocked one neither blocks the others nor hides among them."""
    urls = [f"http://a.com/{w}/{v}" for w in words(40) for v in words(50)]
    rows = verdicts(spark, urls, [("block", "a.com", "/aaaa/aaa"), ("block", "a.com", "/aaaa/aab"), ("allow", "a.com", "/aaab/")])
    assert all(r["verdict"] == ("block" if "/aaaa/" in u else "allow") for u, r in rows.items())
    assert rows["http://a.com/aaaa/aaej"]["rule"] is None  # decided by its section


def test_values_of_a_variable_field(spark):
    """300 users of 4 pages are one field; the labelled bad ones among them stay apart."""
    urls = [f"http://a.com/u/{w}/{v}" for w in words(300) for v in ("a", "b", "c", "d", "z")]
    rows = verdicts(spark, urls, [("block", "a.com", "/u/aaa%s/%s" % (c, v)) for c in "bc" for v in "abcd"])
    bad = ("/u/aaab/", "/u/aaac/")
    assert all((r["verdict"] == "block") == any(b in u and not u.endswith("z") for b in bad) for u, r in rows.items() if r["rule"])
    assert {r["verdict"] for u, r in rows.items() if not any(b in u for b in bad)} == {"allow"}
    assert len({r["template"] for u, r in rows.items() if not any(b in u for b in bad)}) <= 5


def test_segments_beyond_the_fourth(spark):
    urls = [f"http://a.com/a/b/c/{s}/{v}/x" for s in ("spam", "good") for v in words(60)]
    rows = verdicts(spark, urls, [("block", "a.com", f"/a/b/c/spam/{w}/") for w in words(30)])
    assert all(r["verdict"] == ("block" if "/spam/" in u else "allow") for u, r in rows.items())
    assert {r["template"] for r in rows.values()} == {"/a/b/c/spam/*/x", "/a/b/c/good/*/x"}


def test_hosts_too_large_to_merge(spark, monkeypatch):
    monkeypatch.setattr("terracell.llm.url_templates.MERGED_PATHS", 0)
    test_segments_beyond_the_fourth(spark)


def test_leftovers_are_found_on_all_partitions(spark):
    docs = frame(spark, [(k, "word " * k) for k in range(0, 90, 7)])
    plan = pack(docs, tokenizer_path(), capacity=64, shares=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 1, true" in plan and "Repartition 1, false" not in plan
