"""Lines that recur across documents, found by a log-template tree (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, released

#: hot leaves that are broadcast to pick lines early; beyond that all lines are joined with the leaves
BROADCAST_LEAVES = 2_000_000
#: tokens whose hashes a task remembers; beyond that it starts anew, which costs time only
MEMO_TOKENS = 150_000
#: words besides wildcards from which two equal lines are a copy and not chance
LONG_WORDS = 13
WILD = b"<*>"
DIGITS = frozenset(b"0123456789")

LINES = (
    "doc_id long, print long, line_no int, leaf long, line long, n_tokens int, n_lead int, first boolean, tokens array<long>, long boolean"
)


def signed(data: bytes) -> int:
    value = xxhash.xxh64_intdigest(data)
    return value - (1 << 64) if value >> 63 else value


def masked(line: bytes) -> list[bytes]:
    """White-space separated tokens, those with a digit as a wildcard."""
    tokens = line.split()
    if DIGITS.isdisjoint(line):
        return tokens
    return [t if DIGITS.isdisjoint(t) else WILD for t in tokens]


def leaf_of(tokens: list[bytes], depth: int) -> int:
    """Place in the tree: the token count, then the leading tokens."""
    return signed(b" ".join([str(len(tokens)).encode(), *tokens[:depth]]))


def parsed(batch: pa.RecordBatch, depth: int) -> Iterator[tuple[int, int, int, list[bytes], int]]:
    """Row of the batch, line number, position of the line among those with words, tokens and leaf."""
    for k, text in enumerate(batch.column("text").cast(pa.binary())):
        for number, line in enumerate((text.as_py() or b"").split(b"\n")):
            tokens = masked(line)
            if tokens:
                yield k, number, tokens, leaf_of(tokens, depth)


def leaves(rows: DataFrame, depth: int) -> DataFrame:
    """leaf, once per document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(k, leaf) for k, _, _, leaf in parsed(batch, depth)}
            yield pa.RecordBatch.from_arrays([pa.array([leaf for _, leaf in sorted(found)], pa.int64())], names=["leaf"])

    return rows.select("text").mapInArrow(released(run), "leaf long")


def lines_in(rows: DataFrame, hot: np.ndarray | None, depth: int, long_words: int) -> DataFrame:
    """Every line in one of the hot leaves (any leaf, if they are not given), with hashed tokens behind the leading ones.

    A wildcard's hash is 0. `first` marks a line's first occurrence in its document. A line of long_words words besides
    wildcards is given wherever it stands, in a row of its own marked `long`: without tokens, and with its own hash as leaf.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared.value is None else set(shared.value.tolist())
        hashes: dict[bytes, int] = {WILD: 0}
        names = [c.split()[0] for c in LINES.split(", ")]
        for batch in batches:
            ids, prints = batch.column("doc_id").to_pylist(), batch.column("print").to_pylist()
            out: list[tuple] = []
            seen: set[tuple[int, int]] = set()
            for k, number, tokens, leaf in parsed(batch, depth):
                long = len(tokens) >= long_words and len(tokens) - tokens.count(WILD) >= long_words
                within = wanted is None or leaf in wanted
                if not (long or within):
                    continue
                line = signed(b" ".join(tokens))
                new = (k, line) not in seen
                seen.add((k, line))
                if long:
                    out.append((ids[k], prints[k], number, line, line, len(tokens), 0, new, None, True))
                if not within:
                    continue
                rest = [hashes[t] if t in hashes else hashes.setdefault(t, signed(t)) for t in tokens[depth:]]
                lead = sum(t != WILD for t in tokens[:depth])
                out.append((ids[k], prints[k], number, leaf, line, len(tokens), lead, new, rest, False))
                if len(hashes) > MEMO_TOKENS:
                    hashes = {WILD: 0}
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.bool_()]
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(released(run), LINES)


def drop_recurring_lines(
    docs: DataFrame,
    depth: int = 4,
    min_docs: int = 5,
    min_constant: float = 0.6,
    keep_first: bool = True,
    long_words: int = LONG_WORDS,
    long_docs: int = 2,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Drop lines whose template recurs in at least min_docs documents, and long lines that long_docs documents have.

    The tree has a fixed depth: a line goes down by its token count and its first `depth` tokens, tokens with a digit
    being wildcards. In a leaf that min_docs documents reach, a later token is constant where at least min_docs documents have
    it at that place, and a variable field elsewhere. The leaf's main template has the most frequent constant of each place, and
    takes every line that agrees with it in a share of min_constant of its tokens, leading ones included; other lines with that
    share of constants form templates by equal constants. All lines of a recurring template are dropped, but for those of the document with the smallest id (keep_first),
    so a text that was copied is not lost altogether.

    A line of at least long_words words besides wildcards is also dropped, template or not, where long_docs documents have it
    (equal but for wildcards); of these, again, the document with the smallest id keeps it. Shorter lines need min_docs.

    Leaves, lines, tokens and templates are only counted, with partial sums, so a very common line costs one row a task.
    Token hashes are made only for lines in leaves that recur. Long lines are narrow rows, counted with partial sums. They meet those that
    recur, and the lines of leaves meet the templates that recur, by a broadcast up to BROADCAST_LEAVES of them (counted). Texts are shuffled once, to meet their line numbers.

    Returns doc_id, text (the lines kept), the columns named in carry, n_lines, n_dropped (lines with a token, and those dropped).

    Null and empty texts have no lines and stay as they are; lines without a token are kept and not counted. Lines of any length
    and number are used whole. Rows with equal doc_id and text are treated alike and count each; a null doc_id comes last
    for keep_first. An empty table gives no rows. Other columns are ignored.
    """
    carried = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    given = given.withColumn("print", F.xxhash64("text"))
    rows = given.select("doc_id", "text", "print")
    hot = keep(leaves(rows, depth).groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs).select("leaf"), "hot-leaves")
    few = hot.count() <= BROADCAST_LEAVES
    picked = np.array([r["leaf"] for r in hot.toLocalIterator()], np.int64) if few else None
    lines = lines_in(rows, picked, depth, long_words)
    if not few:
        lines = lines.join(hot.withColumn("hot", F.lit(True)), "leaf", "left").filter("long or hot").select(*lines.columns)
    found = keep(lines, "lines")
    lines, long = found.filter("not long"), found.filter("long").select("doc_id", "print", "line_no", "line", "first")

    # distinct lines, and of their tokens those that are part of a template
    distinct = keep(
        lines.groupBy("leaf", "line").agg(
            F.count_if("first").alias("docs"), F.first("tokens").alias("tokens"), F.first("n_tokens").alias("n_tokens"), F.first("n_lead").alias("n_lead")
        ),
        "distinct-lines",
    )
    tokens = distinct.select("leaf", "line", "docs", F.posexplode("tokens").alias("at", "token")).filter("token <> 0")
    constant = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    most = constant.groupBy("leaf", "at").agg(F.max(F.struct("docs", "token")).alias("top")).select("leaf", "at", "top.token", F.lit(True).alias("main"))
    constant = keep(constant.select("leaf", "at", "token").join(most, ["leaf", "at", "token"], "left"), "constant-tokens")
    fixed = tokens.select("leaf", "line", "at", "token").join(constant, ["leaf", "at", "token"])
    fixed = fixed.groupBy("leaf", "line").agg(
        F.expr("bit_xor(xxhash64(at, token))").alias("fields"), F.count(F.lit(1)).alias("n_fixed"), F.count("main").alias("n_main")
    )
    templates = distinct.select("leaf", "line", "n_tokens", "n_lead").join(fixed, ["leaf", "line"], "left")
    n_fixed, n_main = F.coalesce("n_fixed", F.lit(0)), F.coalesce("n_main", F.lit(0))
    enough = min_constant * F.col("n_tokens")
    own = F.xxhash64("leaf", F.coalesce("fields", F.lit(0)), n_fixed)
    templates = templates.filter(F.col("n_lead") + n_fixed >= enough).select(
        "leaf", "line", F.when(F.col("n_lead") + n_main >= enough, F.xxhash64("leaf")).otherwise(own).alias("template")
    )

    places = lines.select("doc_id", "print", "line_no", "leaf", "line").join(templates, ["leaf", "line"])
    seen = places.select("template", "doc_id", "print").distinct().groupBy("template")
    recurring = seen.agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))
    recurring = keep(recurring.filter(F.col("docs") >= min_docs).select("template", "first_doc"), "recurring-templates")
    copied = long.groupBy("line").agg(F.count_if("first").alias("docs"), F.min("doc_id").alias("first_doc"))
    copied = keep(copied.filter(F.col("docs") >= long_docs).select("line", "first_doc"), "long-lines")
    copies = long.join(F.broadcast(copied) if copied.count() <= BROADCAST_LEAVES else copied, "line")
    gone = places.join(F.broadcast(recurring) if recurring.count() <= BROADCAST_LEAVES else recurring, "template").select("doc_id", "print", "line_no", "first_doc")
    gone = gone.unionByName(copies.select(*gone.columns))
    if keep_first:
        gone = gone.filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = gone.groupBy(F.col("doc_id").alias("d"), F.col("print").alias("p")).agg(F.collect_set("line_no").alias("gone"))

    joined = given.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    # the lines are bound to a variable, so that they are cut once and taken by number: linear in their count
    left = F.get(F.transform(F.array(parts), lambda lines: F.transform(kept, lambda k: F.get(lines, k))), F.lit(0))
    has_token = F.filter(parts, lambda line: F.translate(line, " \t\x0b\x0c\r", "") != "")
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        *(F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)),
        F.coalesce(F.size(has_token), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
