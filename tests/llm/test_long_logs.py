"""Documents of very many lines: dropped lines cost time in proportion to their number."""

import time

from terracell.llm.log_templates import drop_recurring_lines


def log(doc, n):
    # every other line is shared by both documents, the rest is the document's own
    lines = []
    for k in range(n):
        word = "".join(chr(97 + int(d)) for d in str(k))
        lines.append(" ".join([word, *"the job on this host has come to its end and all is well now".split(), *([] if k % 2 else [f"own{'x' * doc}"])]))
    return "\n".join(lines)


def test_dropped_lines_of_a_long_document(spark):
    took = {}
    for n in (2_000, 60_000):
        docs = spark.createDataFrame([(1, log(1, n)), (2, log(2, n))], "doc_id long, text string")
        start = time.time()
        rows = {r["doc_id"]: r for r in drop_recurring_lines(docs).collect()}
        took[n] = time.time() - start
        assert (rows[1]["n_lines"], rows[1]["n_dropped"], rows[2]["n_dropped"]) == (n, 0, n // 2)
        assert rows[1]["text"] == log(1, n)
        assert rows[2]["text"].split("\n") == log(2, n).split("\n")[::2]
    assert took[60_000] < 10 * took[2_000]


def test_every_line_dropped_and_blank_lines_kept(spark):
    line = " ".join(["some", "words", "that", "stand", "in", "both", "texts", "as", "one", "long", "line", "of", "fourteen", "words"])
    docs = [(1, line), (2, line), (3, f"\n{line}\n\n"), (4, None), (5, "")]
    rows = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: (line, 0), 2: ("", 1), 3: ("\n\n", 1), 4: (None, 0), 5: ("", 0)}
